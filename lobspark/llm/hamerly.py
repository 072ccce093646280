"""Centroid clustering by Hamerly's bounds, exact in whole numbers.

A vector carries its cluster, an upper bound on the distance to its own centroid and a lower bound on that to the
second nearest. When centroids move, the bounds are loosened by how far; a vector whose bounds still keep the two
apart (or whose own centroid is nearer than half way to any other) stays without a look at its components. The others
are measured against their own centroid, and only those that are still in doubt are scanned against all, in 64-bit
integers. Bounds are doubles and are held apart by more than their rounding, so a vector that stays is strictly
nearest, and ties are always scanned.

Each assignment is one pass without a shuffle that writes its vectors and bounds as Parquet to the shared folder; the next
reads it, so a lost executor costs its tasks alone. Centroids follow from the sums of what joined and left each
cluster: a row a cluster and task, summed by Spark. The driver holds k centroids and nothing that grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import fresh_dir, in_batches

#: Components of a kept vector, centroids, rounds of moving them, and steps a unit.
COMPONENTS, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Squared distances of whole components up to this size fit 64 bits.
LARGEST = 1 << 27
#: What bounds must be apart, against their rounding.
MARGIN = 1e-9
BATCH = 8192
SCHEMA = "vec_id bigint, x array<int>, cluster int, was int, upper double, lower double, distance bigint"


def whole_vectors(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with exactly so many components, all finite. Others are left out;
    a component beyond 2^27 steps stops the job, as squared distances would not fit 64 bits."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    steps = lambda v: F.floor(v.cast("double") * scale)
    fits = lambda v: F.when(F.abs(steps(v)) <= LARGEST, steps(v)).otherwise(F.raise_error(F.lit("a component is too large for exact 64-bit distances")))
    return table.where(e.isNotNull() & (F.size(e) == components) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, lambda v: fits(v).cast("int")).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest sha256 of `1:<vec_id>`; null ids come last, equal ids by their components."""
    first = vectors.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in first], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def between(c: np.ndarray) -> np.ndarray:
    """For each centroid half the distance to its nearest other; infinite where there is none."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    d = squared(c, c).astype(float)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(axis=1)) / 2


def scanned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), its distance, and that of the second nearest."""
    d = squared(x, c)
    near = d.argmin(axis=1)
    own = np.take_along_axis(d, near[:, None], axis=1)[:, 0]
    second = np.partition(d, 1, axis=1)[:, 1].astype(float) if len(c) > 1 else np.full(len(x), np.inf)
    return near, np.sqrt(own.astype(float)), np.sqrt(second)


def reassigned(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """near, upper and lower after the centroids moved to c by `drift`, and how many rows were scanned against all."""
    others = np.array([max((d for j, d in enumerate(drift) if j != i), default=0.0) for i in range(len(c))])
    near, upper, lower = near.copy(), upper + drift[near], lower - others[near]
    bound = np.maximum(lower, between(c)[near]) * (1 - MARGIN)
    doubt = np.flatnonzero(~(upper * (1 + MARGIN) < bound))
    if len(doubt):
        off = x[doubt] - c[near[doubt]]
        upper[doubt] = np.sqrt((off * off).sum(axis=1).astype(float))
        doubt = doubt[~(upper[doubt] * (1 + MARGIN) < bound[doubt])]
        if len(doubt):
            near[doubt], upper[doubt], lower[doubt] = scanned(x[doubt], c)
    return near, upper, lower, len(doubt)


def assigned(state: DataFrame, c: np.ndarray, drift: np.ndarray | None = None, last: bool = False) -> DataFrame:
    """state (vec_id, x, and from the second time on cluster, upper, lower) by the centroids c; with last also exact distances."""
    first = drift is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, c.shape[1])
            if first:
                was = np.full(len(x), -1)
                near, upper, lower = scanned(x, c)
            else:
                was, upper, lower = (b.column(n).to_numpy() for n in ("cluster", "upper", "lower"))
                near, upper, lower, _ = reassigned(x, was, upper, lower, c, drift)
            off = x - c[near]
            distance = pa.array((off * off).sum(axis=1)) if last else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(near, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), distance], ["vec_id", "x", "cluster", "was", "upper", "lower", "distance"])

    need = ["vec_id", "x"] if first else ["vec_id", "x", "cluster", "upper", "lower"]
    return in_batches(state.select(*need), run, SCHEMA, BATCH)


def moved(state: DataFrame, k: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) by cluster of the vectors that joined, less those that left: k rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, components), np.int64)
        for b in batches:
            x = b.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, components)
            for sign, to in ((1, b.column("cluster").to_numpy()), (-1, b.column("was").to_numpy())):
                for j in np.unique(to[to >= 0]):
                    n[j] += sign * int((to == j).sum())
                    sums[j] += sign * x[to == j].sum(axis=0)
        at = np.flatnonzero(n | sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = in_batches(state.where("cluster <> was").select("x", "cluster", "was"), run, "cluster int, n bigint, sums array<bigint>", BATCH)
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(components)]).alias("sums")).collect()
    n, sums = np.zeros(k, np.int64), np.zeros((k, components), np.int64)
    for r in rows:
        n[r["cluster"]], sums[r["cluster"]] = r["n"], r["sums"]
    return n, sums


def clustered(table: DataFrame, k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance, and the bounds) of every kept vector, and the final centroids.

    Centroids start as first_centroids; each round assigns all vectors to the nearest (ties: the smaller number) and
    moves every centroid that has any to the componentwise floor of their mean; then vectors are assigned once more.
    Repeated rows count each; fewer than k vectors give as many centroids; an empty table gives an empty result. Columns
    besides vec_id and embedding are left out.
    """
    spark, vectors = table.sparkSession, whole_vectors(table, components, scale)
    c = first_centroids(vectors, k)
    if not len(c):
        return spark.createDataFrame([], SCHEMA), c
    counts, sums, state, drift = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), vectors, None
    for turn in range(rounds + 1):
        out = fresh_dir(spark, f"clusters-{turn}")
        assigned(state, c, drift, turn == rounds).write.parquet(out)
        state = spark.read.parquet(out)
        if turn < rounds:
            n, s = moved(state, len(c), components)
            counts, sums = counts + n, sums + s
            new = c.copy()
            full = counts > 0
            new[full] = sums[full] // counts[full][:, None]
            drift = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)) * (1 + 1e-12)
            c = new
    return state, c


def digest(table: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    state, c = clustered(table)
    by = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    hashes = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]

    def of(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>"), F.col("cluster") + 1)

    sums = [by.get(j, 0) for j in range(len(c))]
    return state.select("vec_id", "cluster", "distance", of(sums, "bigint").alias("cluster_inertia"), F.lit(sum(sums)).cast("bigint").alias("inertia"), of(hashes, "string").alias("centroid_sha256"))

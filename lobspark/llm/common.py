"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but these six characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows of a table that may be broadcast once counted.
SMALL_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    on a single machine (tests), a new temporary one, which then becomes the checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lobspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = 512) -> DataFrame:
    """df.mapInArrow with at most `rows` rows a batch, so that long texts fit; the session's settings stay as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(cut, schema)


def joined_small(df: DataFrame, side: DataFrame, on: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """df joined with a table that is as a rule small. It is broadcast if its counted rows are
    few (SMALL_ROWS), and otherwise left to a shuffled join, whose skewed partitions AQE splits."""
    side = settled(side)
    return df.join(F.broadcast(side) if side.count() <= (SMALL_ROWS if rows is None else rows) else side, on, how)


def min_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (u, v), both long.

    Contraction: in each round every node takes its least neighbour, if that is below itself; chains of such
    choices are shortened by pointer jumping, and the edges are renamed to their new ends. Odd rounds go by the
    ids, so that stars about their smallest node, as tasks make them, end at once; even rounds go by hashes that
    are new in each: a node's hash is above that of some neighbour in half of all cases at least, so two rounds are
    expected to halve the nodes that still have edges, whatever the graph. Minima are map-side combined, so
    that a hub node shuffles one row a task; nothing is gathered on the driver but counts.
    """
    edges = settled(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parents, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        drawn = lambda c: F.struct((F.lit(0).cast("long") if turn % 2 else F.xxhash64(F.lit(turn), c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        least = both.groupBy(F.col("u").alias("node")).agg(F.min(drawn("v")).alias("m"))
        step = _jumped(settled(least.select("node", F.least(drawn("node"), "m")["n"].alias("up"))))
        # Named by two joins whose right side has one row a node; AQE splits a hub's edges.
        name_u = step.select(F.col("node").alias("u"), F.col("up").alias("cu"))
        name_v = step.select(F.col("node").alias("v"), F.col("up").alias("cv"))
        edges = settled(
            edges.join(name_u, "u").join(name_v, "v").where("cu != cv")
            .select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct()
        )
        if parents is None:
            parents = step
        else:
            above = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parents = settled(parents.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
    if parents is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = parents.groupBy("up").agg(F.min("node").alias("component"))
    return parents.join(least, "up").select("node", "component")


def _jumped(step: DataFrame) -> DataFrame:
    """step (node, up) with every up replaced by the end of its chain."""
    while True:
        above = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        nxt = settled(step.join(above, "up", "left").select("node", "up", F.coalesce("top", "up").alias("top")))
        done = nxt.where("top != up").isEmpty()
        step = nxt.select("node", F.col("top").alias("up"))
        if done:
            return step

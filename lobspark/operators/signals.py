"""Signals from features: rolling z-scores weighed by a fit's betas, smoothed in time, and how well they hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.operators import stats
from lobspark.operators.folds import affine
from lobspark.operators.stats import finite

ORDER = ["ts_us", "seq"]


def zscore(x: str, window: int, keys: list[str], order: list[str]) -> Column:
    """Rolling z-score: null until the window is full, 0 without deviation."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(window - 1), 0)
    sd = F.stddev_pop(x).over(w)
    return F.when(F.count(x).over(w) == window, F.when(sd < 2.2e-16, 0.0).otherwise(F.try_divide(F.col(x) - F.avg(x).over(w), sd)))


def position(signal: Column, k: Column, sigma: Column) -> Column:
    """1, -1 or 0: long above k sigma, short below minus that."""
    return F.when(signal > k * sigma, 1).when(signal < -k * sigma, -1).otherwise(0)


def weights(df: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """(keys, constant, weights): betas of a least-squares fit over the sum of their sizes, the constant's apart. Keys
    whose fit is singular or all zero are left out."""
    fits = stats.ols(df, keys, target, features).where("beta is not null")
    total = F.aggregate("beta", F.lit(0.0), lambda a, b: a + F.abs(b))
    return fits.where(total > 2.2e-16).select(*keys, (F.element_at("beta", 1) / total).alias("constant"), F.transform(F.slice("beta", 2, len(features)), lambda b: b / total).alias("weights"))


def combined(df: DataFrame, fitted: DataFrame, keys: list[str], features: list[str], window: int = 300, name: str = "signal") -> DataFrame:
    """df with the weighed sum of the features' rolling z-scores over each feature's last `window` finite values; a
    feature that is missing or whose window is not full adds nothing."""
    rows = df.join(fitted.select(*keys, "weights"), keys)
    for i, c in enumerate(features):
        rows = rows.withColumns({f"__x{i}": finite(c), f"__has{i}": finite(c).isNotNull()})
    z = [F.coalesce(F.when(F.col(f"__has{i}"), zscore(f"__x{i}", window, [*keys, f"__has{i}"], ORDER)), F.lit(0.0)) * F.element_at("weights", i + 1) for i in range(len(features))]
    rows = rows.withColumn(name, sum(z, F.lit(0.0)))
    return rows.drop("weights", *[f"__{p}{i}" for i in range(len(features)) for p in ("x", "has")])


#: What mapInArrow runs.
Fold = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def runs(b: pa.RecordBatch, keys: list[str]) -> list[tuple[tuple, int, int]]:
    """(key, start, end) of the stretches of a batch that share their key."""
    if not b.num_rows:
        return []
    codes = [b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
    cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist(), b.num_rows]
    return [(tuple(b.column(k)[s].as_py() for k in keys), s, e) for s, e in zip(cuts, cuts[1:], strict=False)]


def numbers(b: pa.RecordBatch, column: str) -> np.ndarray:
    return b.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False)


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along the last axis, the mean of the values so far and the sum of their squared distances from it."""
    means, squares = np.empty_like(x), np.empty_like(x)
    mean, square = np.zeros(x.shape[:-1]), np.zeros(x.shape[:-1])
    for j in range(x.shape[-1]):
        off = x[..., j] - mean
        mean = mean + off / (j + 1)
        square = square + off * (x[..., j] - mean)
        means[..., j], squares[..., j] = mean, square
    return means, squares


def rolling_moments(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every w neighbours along the last axis. A frame is the end of one block of w values and the beginning of the
    next, so the cost does not depend on w; equal values have no deviation, and values outside a frame do not touch it."""
    n = x.shape[-1] - w + 1
    blocks = np.concatenate([x, np.zeros((*x.shape[:-1], -x.shape[-1] % w))], axis=-1).reshape(*x.shape[:-1], -1, w)
    flat = (*x.shape[:-1], -1)
    head, head2 = (m.reshape(flat) for m in moments(blocks))
    tail, tail2 = (m[..., ::-1].reshape(flat)[..., :n] for m in moments(blocks[..., ::-1]))
    begun = np.arange(n) % w  # how much of a frame is in the next block
    head, head2 = (np.where(begun > 0, m[..., w - 1 : w - 1 + n], 0.0) for m in (head, head2))
    gap = np.where(begun > 0, head - tail, 0.0)
    return tail + gap * (begun / w), np.sqrt((tail2 + head2 + gap * gap * (begun * (w - begun) / w)) / w)


def scored(keys: list[str], xs: list[str], weights: str, size: str, name: str) -> Fold:
    """For rows sorted by keys, a fold that puts `name` in the place of xs, weights and size: the weighed sum of the xs' z-scores over the key's
    last `size` rows that have all of them. Null until there are as many, and in rows where one is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, w, by = None, np.empty((len(xs), 0)), 1, np.empty(0)
        for b in batches:
            values, out = np.stack([numbers(b, x) for x in xs]), np.full(b.num_rows, np.nan)
            for key, s, e in runs(b, keys):
                if key != last:
                    last, before, w = key, np.empty((len(xs), 0)), b.column(size)[s].as_py()
                    by = np.array(b.column(weights)[s].as_py(), dtype=float)
                at = s + np.flatnonzero(~np.isnan(values[:, s:e]).any(axis=0))
                x = np.concatenate([before, values[:, at]], axis=1)
                if len(at) and x.shape[1] >= w:
                    with np.errstate(all="ignore"):
                        mean, sd = rolling_moments(x, w)
                        z = np.where(sd < 2.2e-16, 0.0, (x[:, w - 1 :] - mean) / sd)
                    out[at[len(at) - z.shape[1] :]] = (by[:, None] * z).sum(axis=0)
                before = x[:, max(0, x.shape[1] - w + 1) :]
            rest = b.drop_columns([*xs, weights, size])
            yield rest.append_column(name, pa.array(out, pa.float64(), from_pandas=True))

    return run


def fading(keys: list[str], signal: str, tau_s: float, dt_s: float | str, name: str) -> Fold:
    """For rows sorted by keys, the fold of `decayed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y, a = None, None, 0.0
        for b in batches:
            x = numbers(b, signal)
            out = np.full(len(x), np.nan)
            for key, s, e in runs(b, keys):
                if key != last:
                    last, y = key, None
                    a = 1 - float(np.exp(-(b.column(dt_s)[s].as_py() if isinstance(dt_s, str) else dt_s) / tau_s))
                at = s + np.flatnonzero(~np.isnan(x[s:e]))
                if len(at) and y is None:
                    out[at[0]] = y = x[at[0]]
                    at = at[1:]
                if len(at):
                    out[at] = affine(a * x[at], 1 - a, y)
                    y = out[at[-1]]
            yield b.append_column(name, pa.array(out, pa.float64(), from_pandas=True))

    return run


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by keys, in order of time: what the folds here read."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *ORDER)


def schema_of(df: DataFrame, without: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without), *(f"{n} double" for n in more)])


def decayed(df: DataFrame, keys: list[str], signal: str, tau_s: float, dt_s: float | str, name: str = "filtered") -> DataFrame:
    """df with the signal smoothed exponentially, from its first value on; rows without a signal have none and change nothing. dt_s
    is the time between rows, or a column that holds it for each key."""
    return dealt(df, keys).mapInArrow(fading(keys, signal, tau_s, dt_s, name), schema_of(df, more=(name,)))


def positions(df: DataFrame, keys: list[str], signal: str, k: float, name: str = "position") -> DataFrame:
    """df with 1, -1 or 0 by k deviations of the key's signal."""
    return df.withColumn(name, position(F.col(signal), F.lit(k), F.stddev_pop(signal).over(W.partitionBy(*keys))))


def walk_forward_ic(df: DataFrame, keys: list[str], features: list[str], target: str, train: int, test: int) -> DataFrame:
    """(keys, step, feature, ic): rank correlation in the test rows after each `train` rows, moving on by `test`; whole steps only."""
    by = W.partitionBy(*keys)
    rows = df.select(*keys, *ORDER, *[finite(c).alias(c) for c in dict.fromkeys([*features, target])])
    rows = rows.withColumns({"__i": F.row_number().over(by.orderBy(*ORDER)) - 1 - train, "__n": F.count(F.lit(1)).over(by) - train})
    rows = rows.where("__i >= 0").withColumn("step", F.floor(F.col("__i") / test).cast("int")).where((F.col("step") + 1) * test <= F.col("__n"))
    long = rows.unpivot([*keys, "step", target], features, "feature", "x")
    return stats.spearman(long, [*keys, "step", "feature"], "x", target).where("ic is not null").drop("n")


def halflife(ic: DataFrame, keys: list[str], least_r2: float = 0.9) -> DataFrame:
    """(keys, tau_star) of (keys, tau, ic): the fitted decay's time, null where the fit is poor or there is none."""
    fits = stats.ic_decay(ic, keys).select(*keys, F.when(F.col("r2") >= least_r2, F.col("tau_star")).alias("tau_star"))
    return ic.select(*keys).distinct().join(fits, keys, "left")

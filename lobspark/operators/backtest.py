"""Signals and walk-forward backtests, for all instruments in one job."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.operators.segments import placed
from lobspark.operators.signals import dealt, fading, position, schema_of, scored
from lobspark.operators.stats import average_rank, correlation, finite, middle, solved_sums
from lobspark.sources.shared import settled

FEATURES = ("ofi_1", "depth_imb", "microprice_dev", "queue_imb", "trade_intensity")
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Config:
    train_days: float = 14.0
    test_days: float = 7.0
    resample_s: float = 300.0
    tau_star_s: float = 300.0
    fee: float = 0.0004
    thresholds: tuple[float, ...] = (0.5, 1.0, 1.5)
    max_spread_multiple: float = 5.0
    features: tuple[str, ...] = FEATURES
    target: str = "r_300s"
    least_train: int = 20
    least_test: int = 10


def spans(features: DataFrame, c: Config) -> DataFrame:
    """(symbol, skip, bar_s, max_spread, median_spread, t0, t1): what holds for an instrument."""
    by = features.groupBy("symbol").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"), F.count(F.lit(1)).alias("n"))
    dt = F.when(F.col("n") > 1, (F.col("t1") - F.col("t0")) / 1e6 / (F.col("n") - 1))
    by = by.withColumn("dt", dt).where(F.col("t1") - F.col("t0") >= (c.train_days + c.test_days) * DAY_US)
    by = by.withColumn("skip", F.when(F.col("dt") > 0, F.greatest(F.round(c.resample_s / F.col("dt")), F.lit(1.0))).otherwise(1.0).cast("long"))
    # The upper median of the positive spreads.
    s = features.select("symbol", finite("spread").alias("s")).where("s > 0")
    s = middle(s, ["symbol"], "s").select("symbol", F.col("s").alias("median_spread"))
    out = by.join(s, "symbol", "left").withColumn("median_spread", F.coalesce("median_spread", F.lit(float("inf"))))
    return out.select("symbol", "t0", "t1", "skip", (F.col("dt") * F.col("skip")).alias("bar_s"), "median_spread", (c.max_spread_multiple * F.col("median_spread")).alias("max_spread"))


def windows(features: DataFrame, c: Config) -> DataFrame:
    """Test rows, thinned to bars: symbol, window_idx, ts_us, seq, bar_s, max_spread, train_rows, test_rows, beta, and the rest.

    Every row is in one test window at most, and training windows are sums: time is cut into slots that both lengths are
    whole numbers of, products of the regressors are summed by slot and by the place a row has in a bar, and a window adds up its
    slots at the place where its first row stands. No row is copied. A window whose fit is singular has no beta.
    """
    train, test = int(c.train_days * DAY_US), int(c.test_days * DAY_US)
    g = math.gcd(train, test)
    features = settled(features.select("symbol", "ts_us", "seq", *dict.fromkeys([*c.features, "spread", c.target])))
    facts = spans(features, c).withColumn("last", F.floor((F.col("t1") - F.col("t0") - train - test) / F.lit(test)).cast("int"))  # the last window that ends by t1
    rows = placed(features, ["symbol"], ["ts_us", "seq"], {"__place": F.lit(True)}).join(facts, "symbol")
    at = F.col("ts_us") - F.col("t0")
    rows = settled(rows.withColumn("slot", F.floor(at / F.lit(g))))
    firsts = rows.groupBy("symbol", "slot").agg(F.min("__place").alias("first"))
    of = facts.select("symbol", "skip", F.explode(F.sequence(F.lit(0), "last")).alias("window_idx"))
    of = of.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit((train + test) // g - 1)))).withColumns({"slot": F.col("window_idx").cast("bigint") * (test // g) + F.col("k"), "is_train": F.col("k") < train // g})
    starts = of.join(firsts, ["symbol", "slot"]).groupBy("symbol", "window_idx").agg(*[F.min(F.when(F.col("is_train") == t, F.col("first"))).alias(n) for n, t in (("train0", True), ("test0", False))])

    names = ["__one", *c.features]
    xs = {n: finite(n) if n != "__one" else F.lit(1.0) for n in names}
    y = finite(c.target)
    whole = y.isNotNull()
    for x in xs.values():
        whole = whole & x.isNotNull()
    products = [xs[a] * xs[b] for a in names for b in names] + [x * y for x in xs.values()] + [y * y]
    sums = rows.groupBy("symbol", "slot", (F.col("__place") % F.col("skip")).alias("phase")).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(whole, 1)).alias("n"), *[F.sum(F.when(whole, p)).alias(f"m{i}") for i, p in enumerate(products)])
    own = of.where("is_train").join(starts, ["symbol", "window_idx"]).withColumn("phase", F.col("train0") % F.col("skip")).join(sums, ["symbol", "slot", "phase"])
    total, k = [F.sum(f"m{i}") for i in range(len(products))], len(names)
    fits = own.groupBy("symbol", "window_idx").agg(F.sum("rows").alias("train_rows"), F.sum("n").alias("n"), F.array(*total[: k * k]).alias("xtx"), F.array(*total[k * k : k * k + k]).alias("xty"), total[-1].alias("yy"))
    known = fits.where(F.col("n") >= c.least_train)
    solved = solved_sums(known.select("symbol", "window_idx", "n", "xtx", "xty", "yy"), ["symbol", "window_idx"], k).select("symbol", "window_idx", F.slice("beta", 2, k - 1).alias("beta"))
    each = fits.select("symbol", "window_idx", "train_rows").where(F.col("train_rows") >= c.least_train).join(starts.select("symbol", "window_idx", "test0"), ["symbol", "window_idx"]).join(solved, ["symbol", "window_idx"], "left")

    tests = rows.where(at >= train).withColumn("window_idx", F.floor((at - train) / F.lit(test)).cast("int")).where("window_idx <= last").join(each, ["symbol", "window_idx"]).where("(__place - test0) % skip = 0")
    tests = tests.withColumn("test_rows", F.count(F.lit(1)).over(W.partitionBy("symbol", "window_idx"))).where(F.col("test_rows") >= c.least_test)
    return tests.drop("__place", "slot", "t0", "t1", "last", "test0")


def signals(rows: DataFrame, c: Config) -> DataFrame:
    """Test rows with `signal`: rolling z-scores of the features over half an hour (10 to 300 bars), weighted by the window's betas (equally
    where there are none), smoothed. Rows with a feature missing have none and leave the others' alone. A window's rows are sorted once
    and read batch by batch; of its rows before, the fold keeps as many as a z-score reaches back."""
    keys, k = ["symbol", "window_idx"], len(c.features)
    xs = [f"__x{i}" for i in range(k)]
    size = F.greatest(F.lit(10), F.least(F.lit(300), F.floor(F.try_divide(F.lit(1800.0), "bar_s")))).cast("int")
    total = F.aggregate("beta", F.lit(0.0), lambda a, b: a + F.abs(b))
    weights = F.when(total >= 1e-12, F.transform("beta", lambda b: F.try_divide(b, total))).otherwise(F.array(*[F.lit(1.0 / k)] * k))
    kept = [*keys, "ts_us", "seq", "bar_s", *[F.col(x).cast("double").alias(x) for x in ("spread", "max_spread", c.target)], "train_rows", "test_rows"]
    need = rows.select(*kept, *[finite(f).alias(x) for f, x in zip(c.features, xs, strict=True)], weights.alias("__w"), size.alias("__size"))
    score, fade = scored(keys, xs, "__w", "__size", "raw"), fading(keys, "raw", c.tau_star_s, "bar_s", "signal")
    schema = schema_of(need, (*xs, "__w", "__size"), ("raw", "signal"))
    return dealt(need, keys).mapInArrow(lambda batches: fade(score(batches)), schema).drop("raw")


def evaluated(sig: DataFrame, c: Config) -> DataFrame:
    """One row a (symbol, window_idx, k): oos_ic, sigma, trades, pnl, period_sharpe, drawdown, turnover."""
    keys, sig = ["symbol", "window_idx"], settled(sig)
    pairs = sig.where(F.col("signal").isNotNull()).select(*keys, "signal", finite(c.target).alias("y")).where("y is not null")
    ranked = pairs.withColumns({"rx": average_rank("signal", keys), "ry": average_rank("y", keys)})
    ic = ranked.groupBy(*keys).agg(F.coalesce(correlation("rx", "ry"), F.lit(0.0)).alias("oos_ic"))
    sd = sig.groupBy(*keys).agg(F.when(F.count("signal") > 1, F.greatest(F.stddev_pop("signal"), F.lit(1e-10))).otherwise(1.0).alias("sigma"), F.max("train_rows").alias("train_rows"), F.max("test_rows").alias("test_rows"))
    rows = sig.drop("train_rows", "test_rows").join(sd, keys).withColumn("k", F.explode(F.array(*map(F.lit, c.thresholds))))
    pos = F.when(F.coalesce(F.col("spread"), F.lit(0.0)) > F.col("max_spread"), 0).otherwise(position(F.col("signal"), F.col("k"), F.col("sigma")))
    rows = rows.withColumn("pos", pos)
    w = W.partitionBy(*keys, "k").orderBy("ts_us", "seq")
    rows = rows.withColumn("prev", F.lag("pos", 1, 0).over(w))
    change = F.abs(F.col("pos") - F.col("prev"))
    pnl = F.col("prev") * F.coalesce(F.col(c.target), F.lit(0.0)) - change * (F.coalesce(F.col("spread"), F.lit(0.0)) / 2 + c.fee)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"pnl": pnl, "moved": (change > 0).cast("int")}).withColumn("cum", F.sum("pnl").over(so_far))
    rows = rows.withColumn("down", F.greatest(F.max("cum").over(so_far), F.lit(0.0)) - F.col("cum"))
    sdp = F.stddev_pop("pnl")
    out = rows.groupBy(*keys, "k").agg(
        F.first("sigma").alias("sigma"), F.first("train_rows").alias("train_rows"), F.first("test_rows").alias("test_rows"), F.sum("moved").alias("n_trades"), F.sum("pnl").alias("total_pnl_net"),
        F.when((F.count(F.lit(1)) > 1) & (sdp >= 1e-15), F.avg("pnl") / sdp * F.sqrt(F.count(F.lit(1)))).otherwise(0.0).alias("period_sharpe"), F.max("down").alias("max_drawdown"), F.avg("moved").alias("turnover"),
    )
    return out.join(ic, keys, "left").withColumn("oos_ic", F.coalesce("oos_ic", F.lit(0.0)))


def backtested(features: DataFrame, c: Config = Config()) -> DataFrame:
    """A row a (symbol, window_idx, k)."""
    return evaluated(signals(windows(features, c), c), c)


def summarised(results: DataFrame) -> DataFrame:
    """A row a (symbol, k): sums and means over the windows."""
    return results.groupBy("symbol", "k").agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("oos_ic").alias("avg_oos_ic"), F.sum("total_pnl_net").alias("total_pnl_net"), F.avg("period_sharpe").alias("avg_sharpe"),
        F.max("max_drawdown").alias("max_drawdown"), F.avg("turnover").alias("avg_turnover"), F.sum("n_trades").alias("n_trades"),
    )

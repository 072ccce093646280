"""What users call: read feeds, make feature tables, analyse, backtest, rank indicators, simulate.

    python -m lobspark.app techanalysis --data FEATURES_DIR --out OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.functions.indicators import FOLDED, FRAME, NAMES, REACH, SUMS, block_sums_sql, framed_sql
from lobspark.operators import backtest as bt
from lobspark.operators import simulate as sim
from lobspark.operators import stats
from lobspark.operators.asof import HORIZONS, labelled
from lobspark.operators.book import reconstructed
from lobspark.operators.features import extracted
from lobspark.operators.folds import BLOCK_ROWS, WHOLE, folded
from lobspark.operators.segments import before_segment, in_blocks, lagged, placed, segmented
from lobspark.plans import report
from lobspark.sources import files, sinks
from lobspark.sources.feeds import FEEDS, OF_ONE_SYMBOL
from lobspark.sources.shared import settled

RETURNS = [f"r_{h}" for h in HORIZONS]


def replay(spark: SparkSession, feed: str, path: str, symbol: str | None = None) -> DataFrame:
    """Events of recorded messages, one a line."""
    raw = spark.read.text(path)
    return FEEDS[feed](raw, symbol) if feed in OF_ONE_SYMBOL else FEEDS[feed](raw)


def features(events: DataFrame, mode: str = "delta") -> DataFrame:
    """The labelled feature table of events: one row a book event."""
    books = reconstructed(events, 10, mode).where("kind in ('delta', 'snapshot') and dq_error is null")
    table = extracted(books, events.where("kind = 'trade'").select("symbol", "ts_us", "seq", "price", "qty")).drop("top_bids", "top_asks")
    flags = events.select("symbol", "ts_us", "seq", "exchange", "is_imputed", "gap_flag")
    return labelled(table.where("mid is not null").join(flags, ["symbol", "ts_us", "seq"]))


def ingest(spark: SparkSession, feed: str, path: str, out: str, symbol: str | None = None, mode: str = "delta") -> None:
    sinks.write_parquet(features(replay(spark, feed, path, symbol), mode), out)


def read_features(spark: SparkSession, path: str, recursive: bool = True, most: int | None = None) -> DataFrame:
    """Feature CSVs as a table with an order of rows, by file and place in it, read once; files without a symbol take it from their
    name. With `most` a symbol with more rows is thinned to about so many."""
    f = files.feature_files(spark, path, recursive)
    # Below a folder that is read as a tree, equal file names are told apart by their folders.
    name = files.relative_symbol(path) if recursive else files.file_symbol()
    f = settled(f.withColumns({"symbol": F.coalesce("symbol", name), "seq": F.struct("file", F.monotonically_increasing_id().alias("row"))}))
    return f if most is None else files.thinned(f, most)


def price_bars(f: DataFrame) -> DataFrame:
    """Inputs of the indicators from a feature table: the mid, or, where it has none, an index of the 1 s returns, a tenth of each a row.
    That index is made of forward returns: it looks ahead where rows lie closer than a second."""
    from pyspark.sql import Window as W

    keys, order = ["symbol"], ["ts_us", "seq"]
    sp = F.coalesce(F.abs("spread"), F.lit(0.0))
    if "mid" in f.columns:
        f = lagged(f.withColumn("p", F.col("mid")), keys, order, {"__p1": "p"})
    else:
        # The index runs up within segments of time, and on from the segments before.
        step = F.log1p(F.greatest(0.1 * F.coalesce("r_1s", F.lit(0.0)), F.lit(-0.9999999999)))
        rows = segmented(f, keys).withColumn("__step", step)
        before = before_segment(rows, keys, {"__before": F.sum("__step")})
        run = W.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("__run", F.sum("__step").over(run)).join(before, [*keys, "__seg"], "left")
        level = F.coalesce("__run", F.lit(0.0)) + F.coalesce("__before", F.lit(0.0))
        f = rows.withColumn("p", F.greatest(F.exp(level), F.lit(1e-10))).drop("__seg", "__run", "__before", "__step")
        f = lagged(settled(f), keys, order, {"__p1": "p"})
    b = f.withColumns({"sp": sp, "v": F.coalesce(F.abs("trade_intensity"), F.lit(0.0)), "ofi": F.coalesce("ofi_1", F.lit(0.0))})
    return b.select("symbol", "ts_us", "seq", "p", (F.col("p") + sp / 2).alias("h"), F.greatest(F.col("p") - sp / 2, F.lit(1e-10)).alias("l"), F.coalesce("__p1", "p").alias("o"), "v", "sp", "ofi")


def indicators(bars: DataFrame) -> DataFrame:
    """All 87 indicators for every row."""
    bars = settled(bars)  # for frames and folds
    frames = framed(bars, list(FRAME), [])
    return frames.join(folded(bars, FOLDED), ["symbol", "ts_us", "seq"]).select("symbol", "ts_us", "seq", *NAMES)


def framed(bars: DataFrame, names: list[str], keep: list[str], rows: int | None = None) -> DataFrame:
    """symbol, ts_us, seq, the columns of bars in `keep` and the named frame indicators. Instruments of more than `rows` rows are dealt in blocks of
    so many, each with the rows before it that frames reach, and running sums go on from the blocks before."""
    spark, rows = bars.sparkSession, rows or BLOCK_ROWS
    if bars.groupBy("symbol").count().where(F.col("count") > rows).isEmpty():
        return spark.sql(framed_sql("select * from {bars}", names, keep=keep), bars=bars)
    cut = in_blocks(placed(bars, ["symbol"], ["ts_us", "seq"], {"place": F.lit(True)}), "place", rows, REACH)
    cut = settled(cut.withColumn("own", F.floor(F.col("place") / rows) == F.col("block")))
    sums = spark.sql(block_sums_sql("select * from {cut}"), cut=cut)
    before = W.partitionBy("symbol").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("symbol").alias("__s"), F.col("block").alias("__b"), *[F.sum(c).over(before).alias(f"off_{c}") for c in SUMS])  # a row a block
    cut = cut.join(F.broadcast(settled(sums)), F.col("symbol").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left").drop("__s", "__b")
    return spark.sql(framed_sql("select * from {cut}", names, keep=keep, blocks=True), cut=cut).where("own").drop("own")


def indicator_ic(bars: DataFrame, names: list[str], returns: list[str]) -> DataFrame:
    """(symbol, indicator, horizon, ic, n) of the named indicators of bars that have returns. Frames, folds by block and folds by instrument
    are each ranked by themselves, beside the returns that pass through them: no indicators are joined."""
    groups = [[n for n in names if n in FRAME], [n for n in names if n in FOLDED and n not in WHOLE], [n for n in names if n in WHOLE]]
    groups = [g for g in groups if g]
    bars = settled(bars) if len(groups) > 1 else bars
    large, out = stats.large_keys(bars, ["symbol"]), None
    for g in groups:
        if g[0] in FRAME:
            table = framed(bars, g, returns)
        else:
            table = folded(bars, tuple(g), keep=tuple(returns))
        found = stats.ic_table(table, ["symbol"], g, returns, large=large)
        out = found if out is None else out.unionByName(found)
    return out


def techanalysis(f: DataFrame) -> DataFrame:
    """(symbol, indicator, horizon, ic, n) of a feature table."""
    bars = price_bars(f).join(f.select("symbol", "ts_us", "seq", *RETURNS), ["symbol", "ts_us", "seq"])
    return indicator_ic(bars, list(NAMES), RETURNS)


def ic_summary(ic: DataFrame) -> DataFrame:
    """Means over symbols, the largest by size at 5 s first."""
    mean = ic.groupBy("indicator").agg(*[F.avg(F.when(F.col("horizon") == r, F.col("ic"))).alias(r.replace("r_", "avg_")) for r in RETURNS])
    return mean.orderBy(F.abs("avg_5s").desc_nulls_last(), "indicator")


def analyze(f: DataFrame) -> dict[str, DataFrame]:
    return report.sections(f)


def backtest(f: DataFrame, config: bt.Config = bt.Config()) -> DataFrame:
    return bt.backtested(f, config)


def simulate(spark: SparkSession, paths: int, params: sim.Params = sim.Params()) -> DataFrame:
    return sim.feature_table(spark, paths, params)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lobspark")
    p.add_argument("command", choices=["ingest", "analyze", "backtest", "techanalysis", "simulate"])
    p.add_argument("--data")
    p.add_argument("--out", required=True)
    p.add_argument("--feed", choices=sorted(FEEDS))
    p.add_argument("--symbol")
    p.add_argument("--mode", default="delta", choices=["delta", "l1_replace"])
    p.add_argument("--paths", type=int, default=10)
    p.add_argument("--most", type=int, help="rows of a symbol beyond which it is thinned")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lobspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "ingest":
        ingest(spark, a.feed, a.data, a.out, a.symbol, a.mode)
    elif a.command == "simulate":
        sinks.write_csv(simulate(spark, a.paths), a.out)
    else:
        f = read_features(spark, a.data, most=a.most)
        if a.command == "techanalysis":
            ic = techanalysis(f).persist()
            sinks.write_ic(ic, f"{a.out}/by_symbol")
            ic_summary(ic).write.mode("overwrite").option("header", True).csv(f"{a.out}/summary")
        elif a.command == "backtest":
            results = backtest(f).persist()
            results.write.mode("overwrite").option("header", True).csv(f"{a.out}/windows")
            lines = report.backtest_text(results, bt.summarised(results))
            sinks.write_lines(spark, lines, f"{a.out}/report.txt")
        else:
            parts = analyze(f)
            for name, df in parts.items():
                df.write.mode("overwrite").json(f"{a.out}/{name}")
            sinks.write_lines(spark, report.text(parts), f"{a.out}/report.txt")


if __name__ == "__main__":
    main()

"""Order-flow features of every book event, as expressions over its levels and the instrument's rows before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.operators.book import EPS, depth_qty, first

NAMES = ("ofi_1", "ofi_5", "ofi_10", "depth_imb", "microprice_dev", "queue_imb", "spread", "trade_intensity", "price_impact", "level_drain", "weighted_mid_slope")
#: Base rate, jump and decay of the trade intensity, and the seconds of trades kept.
MU, ALPHA, BETA, BUFFER_S = 1.0, 0.5, 1.0, 60


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) >= EPS, F.try_divide(top, bottom))


def weighted_slope(n: int = 5) -> Column:
    """Half spreads of the first n level pairs, weighted by 1 / (place * mean quantity)."""
    pairs = F.filter(F.slice(F.arrays_zip("top_bids", "top_asks"), 1, n), lambda x: x["top_bids"].isNotNull() & x["top_asks"].isNotNull())
    w = F.transform(pairs, lambda x, i: F.struct((x["top_asks"]["price"] - x["top_bids"]["price"]).alias("s"), ((x["top_bids"]["qty"] + x["top_asks"]["qty"]) / 2).alias("q"), (i + 1).alias("k")))
    w = F.transform(F.filter(w, lambda x: x["q"] >= EPS), lambda x: F.struct((1 / (x["k"] * x["q"])).alias("w"), (x["s"] / 2).alias("s")))
    return ratio(F.aggregate(w, F.lit(0.0), lambda a, x: a + x["w"] * x["s"]), F.aggregate(w, F.lit(0.0), lambda a, x: a + x["w"]))


def prepared(books: DataFrame, bids: str = "top_bids", asks: str = "top_asks", prefix: str = "") -> DataFrame:
    """books with what a row's features and those of the row after it need of its levels, named after `prefix`."""
    b = books.withColumns({f"{prefix}bid": first(bids, "price"), f"{prefix}bq": first(bids, "qty"), f"{prefix}ask": first(asks, "price"), f"{prefix}aq": first(asks, "qty")})
    full = F.coalesce((F.size(bids) > 0) & (F.size(asks) > 0), F.lit(False))
    return b.withColumns({f"{prefix}net{n}": F.when(full, depth_qty(bids, n) - depth_qty(asks, n)) for n in (1, 5, 10)})


def drain(lost: Column, dt: Column, at_once: bool = False) -> Column:
    """What the best bid lost in a second. Between rows of one time there is none; with at_once it is what a division by zero
    gives: infinite by the sign of the loss, NaN if nothing was lost, with the sign bit that the processor gives it, as the SQL's has."""
    rate = F.when(dt >= EPS, F.try_divide(lost, dt))
    return rate.when(dt == 0, lost * float("inf")) if at_once else rate


def measured(b: DataFrame, before: dict[str, Column], at_once: bool = False) -> DataFrame:
    """b (from prepared, no prefix) with mid and the features that need no trades; `before` has ts_us, bq and net1, 5, 10 of the
    instrument's row before, null after a gap. at_once: see drain."""
    full = F.coalesce((F.size("top_bids") > 0) & (F.size("top_asks") > 0), F.lit(False))
    bids, asks = depth_qty("top_bids", 5), depth_qty("top_asks", 5)
    b = b.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    dt = (F.col("ts_us") - before["ts_us"]) * 1e-6
    return b.withColumns(
        {
            **{f"ofi_{n}": F.col(f"net{n}") - before[f"net{n}"] for n in (1, 5, 10)},
            "depth_imb": F.when(full, ratio(bids - asks, bids + asks)),
            "microprice_dev": ratio(F.col("aq") * F.col("bid") + F.col("bq") * F.col("ask"), F.col("aq") + F.col("bq")) - F.col("mid"),
            "queue_imb": ratio(F.col("bq"), F.col("bq") + F.col("aq")),
            "spread": F.col("ask") - F.col("bid"),
            "relative_spread": ratio(F.col("ask") - F.col("bid"), F.col("mid")),
            "level_drain": drain(before["bq"] - F.col("bq"), dt, at_once),
            "weighted_mid_slope": F.when(full, weighted_slope()),
        }
    )


def impact(price: Column, qty: Column) -> Column:
    """How far the last trade was from mid, for each unit of it."""
    return F.when((qty >= EPS) & (F.col("mid") >= EPS), (price - F.col("mid")) / qty)


WORK = ["bid", "bq", "ask", "aq", "net1", "net5", "net10"]


def extracted(books: DataFrame, trades: DataFrame | None = None, mu: float = MU, alpha: float = ALPHA, beta: float = BETA, at_once: bool = False) -> DataFrame:
    """The eleven features and mid for every row of books (symbol, ts_us, seq, top_bids, top_asks, gap_id).

    Lags do not cross gaps; trades do. at_once: see drain. trades: symbol, ts_us, seq, price, qty; those up to a row, by (ts_us, seq), count.
    """
    if not 0 <= alpha < beta:
        raise ValueError("the intensity needs alpha < beta")
    if "gap_id" not in books.columns:
        books = books.withColumn("gap_id", F.lit(0))
    w = W.partitionBy("symbol", "gap_id").orderBy("ts_us", "seq")
    b = measured(prepared(books), {c: F.lag(c).over(w) for c in ("ts_us", "bq", "net1", "net5", "net10")}, at_once)
    if trades is None:
        b = b.withColumns({"trade_intensity": F.lit(mu), "price_impact": F.lit(None).cast("double")})
    else:
        b = _with_trades(b, trades, mu, alpha, beta)
    return b.drop(*WORK)


def kept_us(beta: float) -> int:
    """How long a trade counts: a minute, or until nothing is left of it in a double."""
    return int(min(BUFFER_S, 600 / beta) * 1_000_000)


def near_trades(rows: DataFrame, trades: DataFrame, beta: float) -> DataFrame:
    """(symbol, ts_us, seq, near): for each row the trades up to it that are at most kept_us old, each faded by its age.

    Time is cut into buckets as long as trades count. A trade weighs more the later it is in its bucket, so that weights of a
    bucket add up as running sums. A row takes the running sum at its place, and of the bucket before the sum less what had
    run up at the moment that far back: it asks there, in the same sort. Every bucket of an instrument is dealt apart, and the cost does
    not depend on how many trades a bucket has.
    """
    span = kept_us(beta)
    at = lambda ts: F.floor(ts / F.lit(span))
    none = F.lit(None).cast("bigint")
    # Kinds at equal times: those that ask for what came before a time, then trades and rows by their seq.
    ask = F.struct(F.lit(0).alias("kind"), (F.col("ts_us") - span).alias("t"), F.col("ts_us").alias("own_ts"))
    own = F.struct(F.lit(1).alias("kind"), F.col("ts_us").alias("t"), F.col("ts_us").alias("own_ts"))
    asked = rows.select("symbol", "seq", F.explode(F.array(ask, own)).alias("r")).select("symbol", "seq", "r.*", F.lit(1).alias("q"))
    deals = trades.select("symbol", "seq", F.lit(1).alias("kind"), F.col("ts_us").alias("t"), none.alias("own_ts"), F.lit(0).alias("q"))
    both = asked.unionByName(deals).withColumns({"bucket": at(F.col("t"))})
    both = both.withColumn("weight", F.when(F.col("q") == 0, F.exp(beta * 1e-6 * (F.col("t") - F.col("bucket") * span))).otherwise(0.0))
    by = W.partitionBy("symbol", "bucket")
    run = by.orderBy("t", "kind", "seq", "q").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumns({"sofar": F.sum("weight").over(run), "all": F.sum("weight").over(by)}).where("q = 1")
    sums = F.when(F.col("kind") == 1, F.col("sofar")).otherwise(F.col("all") - F.col("sofar"))
    faded = sums * F.exp(-beta * 1e-6 * (F.col("own_ts") - F.col("bucket") * span))
    return both.groupBy("symbol", F.col("own_ts").alias("ts_us"), "seq").agg(F.sum(faded).alias("near"))


def _with_trades(b: DataFrame, trades: DataFrame, mu: float, alpha: float, beta: float) -> DataFrame:
    """b with the intensity of the trades near each row, and the impact of the last trade by (ts_us, seq)."""
    deal = F.struct(F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"))
    both = b.select("symbol", "ts_us", "seq", F.lit(1).alias("__q"), F.lit(None).cast("struct<price:double,qty:double>").alias("__t")).unionByName(trades.select("symbol", "ts_us", "seq", F.lit(0).alias("__q"), deal.alias("__t")))
    run = W.partitionBy("symbol").orderBy("ts_us", "seq", "__q").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = both.withColumn("__t", F.last("__t", ignorenulls=True).over(run)).where("__q = 1").drop("__q")
    out = b.join(last, ["symbol", "ts_us", "seq"], "left").join(near_trades(b.select("symbol", "ts_us", "seq"), trades, beta), ["symbol", "ts_us", "seq"], "left")
    out = out.withColumns({"trade_intensity": mu + alpha * F.coalesce("near", F.lit(0.0)), "price_impact": impact(F.col("__t.price"), F.col("__t.qty"))})
    return out.drop("__t", "near")

"""Order books from level changes and snapshots.

`reconstructed` folds events in order: dealt by instrument, or by instrument and segment of time, sorted, read batch by batch
with one book as the state. `intervals` is the same for level changes alone as joins and windows, for
checks and for books of few levels. Both give one row for each event with the best `depth` levels.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.operators.segments import segmented

EPS = 2.220446049250313e-16
LEVELS = "array<struct<price:double,qty:double>>"
STRETCH = 64
_LEVELS = pa.list_(pa.struct([("price", pa.float64()), ("qty", pa.float64())]))


class Side:
    """Levels by distance from the best: prices sorted, quantities by price."""

    def __init__(self, bid: bool) -> None:
        self.sign, self.keys, self.qty = -1.0 if bid else 1.0, [], {}

    def put(self, price: float, qty: float) -> None:
        key = self.sign * price
        if qty < EPS:
            if key in self.qty:
                del self.qty[key]
                del self.keys[bisect_left(self.keys, key)]
        else:
            if key not in self.qty:
                insort(self.keys, key)
            self.qty[key] = qty

    def top(self, n: int) -> list[dict[str, float]]:
        return [{"price": self.sign * k, "qty": self.qty[k]} for k in self.keys[:n]]


class Book:
    """One instrument's book. apply() gives the reason why an event is refused, or None."""

    def __init__(self) -> None:
        self.bids, self.asks, self.ts = Side(True), Side(False), None

    def apply(self, kind: str, side: str | None, price: float | None, qty: float | None, ts: int, bids: list | None, asks: list | None, replace: bool = False) -> str | None:
        if kind == "snapshot":
            self.bids, self.asks, self.ts = Side(True), Side(False), ts
            for own, levels in ((self.bids, bids), (self.asks, asks)):
                for x in levels or []:
                    own.put(x["price"], x["qty"])
            return None
        if kind != "delta":
            return None
        if price is None or price != price or abs(price) == float("inf"):
            return "non_finite_price"
        if qty is None or qty < 0:
            return "negative_qty"
        own = self.bids if side == "bid" else self.asks
        if replace:  # feeds of best prices only: an old best does not linger
            own.keys, own.qty = [], {}
        own.put(price, qty)
        self.ts = ts if self.ts is None else max(self.ts, ts)
        return None

    def crossed(self) -> bool:
        return bool(self.bids.keys and self.asks.keys and -self.bids.keys[0] >= self.asks.keys[0])

    def market_order(self, buy: bool, qty: float) -> tuple[float, float]:
        """Takes from the opposite side, best first: mean price (0 if none) and quantity filled."""
        own, cost, filled = (self.asks if buy else self.bids), 0.0, 0.0
        while own.keys and qty - filled > EPS:
            key = own.keys[0]
            take = min(own.qty[key], qty - filled)
            cost, filled = cost + take * own.sign * key, filled + take
            own.put(own.sign * key, own.qty[key] - take)
        return (cost / filled if filled else 0.0), filled


def reconstructed(events: DataFrame, depth: int = 10, mode: str = "delta", parts: int | None = None) -> DataFrame:
    """events (symbol, ts_us, seq, kind, side, price, qty, bids, asks) with the book after each: book_ts,
    top_bids, top_asks, dq_error (why the event was refused), crossed, gap_id (gaps so far). mode l1_replace is for feeds of best prices.
    With `conn`, the number of an event's connection, a change of it counts as a gap: a cut feed starts the features of all instruments anew.
    With `parts` each instrument is cut into about so many segments of time, which are folded apart; see _starts. Not for l1_replace."""
    need = {"kind": F.lit("delta"), "bids": F.lit(None).cast(LEVELS), "asks": F.lit(None).cast(LEVELS), "conn": F.lit(0)}
    fields = ["kind", "side", "price", "qty", "bids", "asks", "conn"]
    base = events.withColumns({c: v for c, v in need.items() if c not in events.columns}).select("symbol", "ts_us", "seq", *fields)
    replace, start = mode == "l1_replace", F.lit(None).cast("struct<gaps:bigint,book_ts:bigint>")
    if parts is None:
        base = base.withColumns({"__seg": F.lit(0), "start": start})
    elif replace:
        raise ValueError("a book of best prices alone is not cut into segments")
    else:
        base = segmented(base, ["symbol"], parts=parts, least=0).withColumn("start", start)
        base = base.unionByName(_starts(base, fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = book = last = None
        gaps = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                out: list[list] = [[] for _ in range(6)]
                real = []
                for at, (s, ts, _, kind, side, price, qty, bids, asks, conn, seg, begin) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                    if book is None or (s, seg) != part:
                        part, book, gaps, last = (s, seg), Book(), 0, conn
                    if begin is not None:  # what the segments before leave
                        book.apply("snapshot", None, None, None, ts, bids, asks)
                        book.ts, gaps, last = begin["book_ts"], begin["gaps"], None
                        continue
                    gaps += kind in ("gap", "disconnected") or (last is not None and conn != last)
                    last = conn
                    error = book.apply(kind, side, price, qty, ts, bids, asks, replace)
                    real.append(at)
                    for c, v in zip(out, (book.ts, book.bids.top(depth), book.asks.top(depth), error, book.crossed(), gaps), strict=True):
                        c.append(v)
                kinds = [pa.int64(), _LEVELS, _LEVELS, pa.string(), pa.bool_(), pa.int64()]
                own = b.take(pa.array(real, pa.int64())) if len(real) < b.num_rows else b
                yield pa.RecordBatch.from_arrays([*own.columns[:4], *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)

    names = ["symbol", "ts_us", "seq", "kind", "book_ts", "top_bids", "top_asks", "dq_error", "crossed", "gap_id"]
    schema = f"symbol string, ts_us long, seq {base.schema['seq'].dataType.simpleString()}, kind string, book_ts long, top_bids {LEVELS}, top_asks {LEVELS}, dq_error string, crossed boolean, gap_id long"
    by = ["symbol", "__seg"]
    order = [*by, F.col("start").isNull(), "ts_us", "seq"] if parts is not None else ["symbol", "ts_us", "seq"]
    dealt = base.repartition(*by) if parts is not None else base.repartition("symbol")
    return dealt.sortWithinPartitions(*order).select("symbol", "ts_us", "seq", *fields, "__seg", "start").mapInArrow(run, schema)


def _starts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each segment of an instrument (but the first): the book, gaps and book_ts that the segments before leave.

    Of every level and segment the last quantity counts, of those since the segment's last snapshot, if it has one. It
    stands at the start of the later segments up to the next one that changes the level or has a snapshot, itself included.
    """
    at = F.struct("ts_us", "seq")
    price, qty = F.col("price"), F.col("qty")
    valid = (F.col("kind") == "delta") & price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf")) & (qty >= 0)
    facts = rows.withColumn("__was", F.lag("conn").over(W.partitionBy("symbol", "__seg").orderBy("ts_us", "seq")))
    lost = F.col("kind").isin("gap", "disconnected") | F.coalesce(F.col("conn") != F.col("__was"), F.lit(False))
    whole = F.col("kind") == "snapshot"
    segs = facts.groupBy("symbol", "__seg").agg(F.count(F.when(lost, 1)).alias("lost"), F.max(F.when(valid | whole, F.col("ts_us"))).alias("ts"), F.min_by("conn", at).alias("c0"), F.max_by("conn", at).alias("c1"), F.min_by("kind", at).alias("k0"), F.max(F.when(whole, at)).alias("reset"))
    order = W.partitionBy("symbol").orderBy("__seg")
    before, later = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    # A cut between two segments counts with the later one, unless its first event is a gap itself, which counts there.
    cut = F.coalesce((F.col("c0") != F.lag("c1").over(order)) & ~F.col("k0").isin("gap", "disconnected"), F.lit(False)).cast("int")
    segs = segs.withColumn("cut", cut)
    segs = segs.select("symbol", "__seg", "reset", (F.coalesce(F.sum("lost").over(before), F.lit(0)) + F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, 0))).alias("gaps"), F.max("ts").over(before).alias("book_ts"), F.min(F.when(F.col("reset").isNotNull(), F.col("__seg"))).over(later).alias("void"), F.max("__seg").over(W.partitionBy("symbol")).alias("last"))
    levels = lambda side: F.transform(F.coalesce(f"{side}s", F.array().cast(LEVELS)), lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["qty"].alias("qty")))
    one = F.array(F.struct("side", price.cast("double").alias("price"), qty.cast("double").alias("qty")))
    changes = rows.where(valid | whole).select("symbol", "__seg", at.alias("at"), F.posexplode(F.when(whole, F.concat(levels("bid"), levels("ask"))).otherwise(one)).alias("pos", "l")).select("symbol", "__seg", "at", "pos", "l.*")
    changes = changes.withColumn("side", F.when(F.col("side") == "bid", "bid").otherwise("ask")).join(segs.select("symbol", "__seg", "reset", "void", "last"), ["symbol", "__seg"]).where("reset is null or at >= reset")
    ends = changes.groupBy("symbol", "side", "price", "__seg").agg(F.max_by("qty", F.struct("at", "pos")).alias("qty"), F.first("void").alias("void"), F.first("last").alias("last"))
    upto = F.least(F.coalesce(F.lead("__seg").over(W.partitionBy("symbol", "side", "price").orderBy("__seg")), F.col("last")), F.coalesce("void", "last"))
    held = ends.withColumn("upto", upto).where((F.col("qty") >= EPS) & (F.col("upto") > F.col("__seg"))).select("symbol", "side", "price", "qty", F.explode(F.sequence(F.col("__seg") + 1, "upto")).alias("__seg"))
    books = held.groupBy("symbol", "__seg").agg(*[F.collect_list(F.when(F.col("side") == s, F.struct("price", "qty"))).alias(f"{s}s") for s in ("bid", "ask")])
    begun = segs.where("__seg > 0").join(books, ["symbol", "__seg"], "left")
    none = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema if f.name in ("ts_us", "seq", *fields)}
    return begun.select("symbol", "__seg", *[v.alias(n) for n, v in none.items() if n not in ("bids", "asks")], "bids", "asks", F.struct("gaps", "book_ts").alias("start"))


def intervals(deltas: DataFrame, depth: int = 10) -> DataFrame:
    """top_bids and top_asks after each level change, from the intervals in which each level holds a quantity."""
    w = W.partitionBy("symbol").orderBy("ts_us", "seq")
    placed = deltas.withColumns({"__at": F.row_number().over(w), "__n": F.count(F.lit(1)).over(W.partitionBy("symbol"))})
    until = F.coalesce(F.lead("__at").over(W.partitionBy("symbol", "side", "price").orderBy("__at")), F.col("__n") + 1)
    spans = placed.withColumn("__to", until).where(F.col("qty") >= EPS)
    # Events meet the levels held by stretches of STRETCH events, not by instrument, which would be quadratic in its events.
    spans = spans.select("symbol", "side", "price", "qty", F.col("__at").alias("__from"), "__to", F.explode(F.sequence(F.floor(F.col("__at") / STRETCH), F.floor((F.col("__to") - 1) / STRETCH))).alias("__s"))
    held = placed.select("symbol", "ts_us", "seq", "__at", F.floor(F.col("__at") / STRETCH).alias("__s")).join(spans, ["symbol", "__s"]).where("__from <= __at and __at < __to")
    key = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    sides = [F.slice(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct(key.alias("k"), F.col("price").alias("price"), F.col("qty").alias("qty"))))), 1, depth) for s in ("bid", "ask")]
    tops = held.groupBy("symbol", "ts_us", "seq").agg(*[F.transform(x, lambda v: F.struct(v["price"].alias("price"), v["qty"].alias("qty"))).alias(n) for x, n in zip(sides, ("top_bids", "top_asks"), strict=True)])
    return deltas.select("symbol", "ts_us", "seq").join(tops, ["symbol", "ts_us", "seq"], "left")


def first(levels: str, field: str) -> Column:
    return F.get(F.col(levels), F.lit(0))[field]


def depth_qty(levels: str, n: int) -> Column:
    return F.aggregate(F.slice(F.col(levels), 1, n), F.lit(0.0), lambda a, x: a + x["qty"])


def filled(levels: str, qty: Column) -> Column:
    """struct(avg_price, filled): what a market order of qty gets from levels, best first."""

    def take(a: Column, x: Column) -> Column:
        t = F.least(x["qty"], qty - a["filled"])
        return F.struct((a["cost"] + t * x["price"]).alias("cost"), (a["filled"] + t).alias("filled"))

    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("filled"))
    return F.aggregate(F.col(levels), start, take, lambda a: F.struct(F.when(a["filled"] > 0, a["cost"] / a["filled"]).otherwise(0.0).alias("avg_price"), a["filled"].alias("filled")))

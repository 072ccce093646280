"""The one event model that all feeds are read into."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lobspark.operators.segments import segmented

LEVELS = "array<struct<price:double,qty:double>>"
EVENT = f"struct<symbol:string,kind:string,ts_us:bigint,side:string,price:double,qty:double,is_buy:boolean,bids:{LEVELS},asks:{LEVELS},is_imputed:boolean,gap_flag:boolean>"
FIELDS = ("symbol", "kind", "ts_us", "side", "price", "qty", "is_buy", "bids", "asks", "is_imputed", "gap_flag")

def _event(kind: str, symbol: Column, ts_us: Column, **fields: Column) -> Column:
    lost = kind in ("gap", "disconnected")
    every = {"symbol": symbol, "kind": F.lit(kind), "ts_us": ts_us, "is_imputed": F.lit(lost), "gap_flag": F.lit(lost)} | fields
    return F.struct(*[every.get(n, F.lit(None)).alias(n) for n in FIELDS]).cast(EVENT)


def delta(symbol: Column, ts_us: Column, side: str | Column, price: Column, qty: Column) -> Column:
    return _event("delta", symbol, ts_us, side=F.lit(side) if isinstance(side, str) else side, price=price, qty=qty)


def trade(symbol: Column, ts_us: Column, price: Column, qty: Column, is_buy: Column | bool) -> Column:
    return _event("trade", symbol, ts_us, price=price, qty=qty, is_buy=F.lit(is_buy) if isinstance(is_buy, bool) else is_buy)


def snapshot(symbol: Column, ts_us: Column, bids: Column, asks: Column) -> Column:
    return _event("snapshot", symbol, ts_us, bids=bids, asks=asks)


def gap(symbol: Column, ts_us: Column) -> Column:
    return _event("gap", symbol, ts_us)


def lost_connection(symbol: Column, ts_us: Column) -> Column:
    """What an instrument knows of a cut of its feed."""
    return _event("disconnected", symbol, ts_us)


def level(price: Column, qty: Column) -> Column:
    return F.struct(price.cast("double").alias("price"), qty.cast("double").alias("qty"))


def number(x: Column) -> Column:
    """A double; null for anything that is none, and for NaN and infinities."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def none() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def deltas_of(levels: Column, symbol: Column, ts_us: Column, side: str) -> Column:
    """Level changes from array<struct<price,qty>>; prices must be positive."""
    return F.transform(F.filter(levels, lambda x: (x["price"] > 0) & x["qty"].isNotNull()), lambda x: delta(symbol, ts_us, side, x["price"], x["qty"]))


def pairs(levels: Column) -> Column:
    """array<struct<price,qty>> from [["price", "qty", ...], ...]."""
    return F.transform(F.coalesce(levels, F.array().cast("array<array<string>>")), lambda x: level(number(F.get(x, F.lit(0))), number(F.get(x, F.lit(1)))))


def held(levels: Column, empty: bool = False) -> Column:
    """Levels fit for a snapshot; with empty, also those of no quantity."""
    return F.filter(levels, lambda x: (x["price"] > 0) & ((x["qty"] >= 0) if empty else (x["qty"] > 0)))


def with_line(raw: DataFrame) -> DataFrame:
    """raw with `line`, the order of its messages; kept if it has one. Of files it is (path, start of the block, row in it),
    as Spark packs files into partitions by size. Rows from elsewhere are in the order of their partitions; a stream must bring its own."""
    if "line" in raw.columns:
        return raw
    if raw.isStreaming:
        raise ValueError("a stream of messages needs `line`, their order: read it as captures")
    row = F.monotonically_increasing_id()
    try:
        return raw.withColumn("line", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), row.alias("row")))
    except AnalysisException:
        return raw.withColumn("line", row)


def flat(groups: Column) -> Column:
    """The events of array<array<event>>, in order; of null none."""
    return F.coalesce(F.flatten(groups), none())


def emitted(raw: DataFrame, events: Column, exchange: str) -> DataFrame:
    """One row for each event of each message: exchange, the event's fields, and seq: the message's line and the
    event's place in it. Neither is packed into the other, so neither has a limit."""
    line = F.col("line") if isinstance(raw.schema["line"].dataType, T.StructType) else F.col("line").cast("bigint")
    out = raw.select(line.alias("line"), F.posexplode(events).alias("__pos", "e"))
    return out.select(F.lit(exchange).alias("exchange"), "e.*", F.struct("line", F.col("__pos").alias("pos")).alias("seq"))


def sequenced(m: DataFrame, key: str) -> DataFrame:
    """m (line, value, first, since, until, and key) with `before`: the largest `until` of earlier messages with the key,
    for feeds whose numbers only grow, or the last one. Batches look back by a window over a block of one key's messages, and by a row
    a block at the blocks before; streams keep the number in a state for each key, so a message that comes after later ones is held against those."""
    if m.isStreaming:
        return _stateful(m, key)
    # Messages without a key are one key's.
    m = m.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\0")))
    key = "__key"
    part = _parts(m, key)
    own = W.partitionBy(key, "__seg").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    rows = part.withColumn("before", F.when(F.col("grows"), F.max("until").over(own)).otherwise(F.last("until", ignorenulls=True).over(own)))
    # What the parts before leave: a row a part.
    at = F.col("line.row") if isinstance(m.schema["line"].dataType, T.StructType) else F.col("line")
    ends = part.groupBy(key, "__seg").agg(F.max("until").alias("__most"), F.max_by("until", F.when(F.col("until").isNotNull(), at)).alias("__last"))
    earlier = W.partitionBy(key).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    parts = ends.select(key, "__seg", F.max("__most").over(earlier).alias("__most"), F.last("__last", ignorenulls=True).over(earlier).alias("__last"))
    parts = parts.where("__most is not null")
    out = rows.join(parts, [key, "__seg"], "left")
    return out.withColumn("before", F.when(F.col("grows"), F.greatest("before", "__most")).otherwise(F.coalesce("before", "__last"))).drop("__key", "__seg", "__most", "__last")


def _parts(m: DataFrame, key: str) -> DataFrame:
    """m with __seg, parts of a key's messages that follow each other: blocks of files, or segments of line numbers."""
    if isinstance(m.schema["line"].dataType, T.StructType):
        return m.withColumn("__seg", F.struct("line.file", "line.start"))
    return segmented(m, [key], "line")


def _stateful(m: DataFrame, key: str) -> DataFrame:
    need = m.select("line", "value", F.col(key).alias("__key"), "until", "grows")

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("line", kind="stable")
        last, before = state.get[0] if state.exists else None, []
        for until, grows in zip(rows["until"], rows["grows"], strict=True):
            before.append(last)
            if not pd.isna(until):
                last = int(until) if last is None or not grows else max(last, int(until))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"line": rows["line"], "value": rows["value"], "before": pd.array(before, dtype="Int64")})

    return need.groupBy("__key").applyInPandasWithState(fold, "line long, value string, before long", "last long", "append", GroupStateTimeout.NoTimeout)

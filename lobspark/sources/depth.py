"""Depth synchronisation: updates wait for a snapshot, and each is accepted, kept waiting, dropped as old, or a gap.

A venue's depth updates say which ids they span (U to u); a snapshot says which id it holds. Updates wait until a
snapshot comes; then those that end at or before its id are old, the first that spans the id after it is accepted, and from
then on each must begin right after the last. What does not is a gap: from there updates wait for the next snapshot. A new
connection starts anew. The rules are one small class; batches fold it over an instrument's sorted messages, streams keep it
as a state by instrument.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lobspark.sources.captures import BYTE_BITS, LIVE
from lobspark.sources.events import deltas_of, emitted, gap, held, lost_connection, none, number, pairs, snapshot, trade, with_line

#: Updates that wait at most; the oldest go first. A fixed value of the protocol followed here.
WAITING = 500
OUT = "line bigint, at bigint, nth int, outcome string, ms bigint, value string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Sync:
    """One instrument's state. `waiting` holds (line, first, until, ms, value)."""

    def __init__(self, last: int | None = None, synced: bool = False, conn: int = -1, ms: int = 0, waiting: list[tuple] | None = None) -> None:
        self.last, self.synced, self.conn, self.ms, self.waiting = last, synced, conn, ms, waiting or []

    def judged(self, first: int, until: int) -> str:
        """accept, buffer, old or gap, and the state after it."""
        if self.last is None:
            return "buffer"
        if not self.synced and until <= self.last:
            return "old"
        if first == self.last + 1 if self.synced else first <= self.last + 1:
            self.last, self.synced = until, True
            return "accept"
        self.last, self.synced = None, False
        return "gap"

    def take(self, line: int, kind: str, first: int | None, until: int | None, ms: int, value: str | None, most: int = WAITING) -> Iterator[tuple]:
        """Rows (line, at, nth, outcome, ms, value): what a message sets free, each with the line from which it holds and its place there."""
        nth = 0
        self.ms = ms or self.ms
        if kind == "snapshot":
            free, self.waiting, self.last, self.synced = self.waiting, [], until, False
            # A snapshot has no time of its own: it holds from the first update that follows it.
            since = next((w[3] for w in free if w[2] > until), self.ms)
            yield line, line, 0, "snapshot", since, value
            todo, nth = free, 1
        elif kind == "update":
            todo = [(line, first, until, ms, value)]
        else:
            yield line, line, 0, kind, ms, value
            return
        for w in todo:
            outcome = self.judged(w[1], w[2])
            if outcome == "buffer":
                self.waiting = [*self.waiting, w][-most:]
                if nth == 0:
                    yield w[0], line, 0, "buffer", w[3], None
            else:
                yield w[0], line, nth, outcome, w[3], w[4] if outcome == "accept" else None
                nth += 1


def depth_messages(raw: DataFrame) -> DataFrame:
    """(symbol, line, kind, first, until, ms, value): snapshots (lastUpdateId), updates (U, u) and trades of a combined stream."""
    m = with_line(raw)
    if isinstance(m.schema["line"].dataType, T.StructType):
        raise ValueError("depth synchronisation needs `line` as a number: read messages as captures")
    m = m.withColumns({"d": F.coalesce(F.get_json_object("value", "$.data"), "value"), "stream": F.get_json_object("value", "$.stream")})
    paths = {"s": "s", "held_id": "lastUpdateId", "first": "U", "until": "u", "event_ms": "E", "trade_ms": "T", "p": "p", "b": "b", "a": "a"}
    m = m.withColumns({n: F.get_json_object("d", f"$.{p}") for n, p in paths.items()})
    m = m.withColumns({c: F.col(c).try_cast("bigint") for c in ("held_id", "first", "until", "event_ms", "trade_ms")})
    book = F.col("b").isNotNull() | F.col("a").isNotNull()
    kind = F.when(F.col("held_id").isNotNull(), "snapshot").when(book & F.col("first").isNotNull() & F.col("until").isNotNull(), "update").when(F.col("p").isNotNull() & ~book, "trade")
    symbol = F.upper(F.coalesce("s", F.split("stream", "@")[0]))
    ms = F.coalesce("event_ms", "trade_ms", F.lit(0))
    out = m.select(symbol.alias("symbol"), F.col("line").cast("bigint").alias("line"), kind.alias("kind"), "first", F.coalesce("held_id", "until").alias("until"), ms.alias("ms"), F.col("d").alias("value"))
    return out.where("symbol is not null and kind is not null")


def _folded(sync: Sync, rows: pd.DataFrame, most: int) -> Iterator[tuple]:
    for line, kind, first, until, ms, value in rows.itertuples(index=False):
        conn = line >> BYTE_BITS
        if sync.conn >= 0 and conn != sync.conn and conn > LIVE:  # files of history are pages, not connections
            ms_before = sync.ms
            sync.__init__(None, False, conn, ms_before)
            yield line, line, -1, "disconnected", ms_before, None
        sync.conn = conn
        yield from sync.take(line, kind, None if pd.isna(first) else int(first), None if pd.isna(until) else int(until), int(ms), value, most)


_NEED = ["line", "kind", "first", "until", "ms", "value"]


class _Keeper(StatefulProcessor):
    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sync", "last bigint, synced boolean, conn bigint, ms bigint")
        self.waiting = handle.getListState("waiting", "line bigint, first bigint, until bigint, ms bigint, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sync = Sync(*self.state.get(), [tuple(r) for r in self.waiting.get()]) if self.state.exists() else Sync()
        before = len(sync.waiting)
        found = list(_folded(sync, pd.concat(list(rows))[_NEED].sort_values("line", kind="stable"), self.most))
        self.state.update((sync.last, sync.synced, sync.conn, sync.ms))
        if sync.waiting:
            self.waiting.put(sync.waiting)
        elif before:
            self.waiting.clear()
        yield pd.DataFrame([(key[0], *r) for r in found], columns=["symbol", *_COLUMNS])

    def close(self) -> None:
        pass


def outcomes(raw: DataFrame, most: int = WAITING) -> DataFrame:
    """(symbol, line, at, nth, outcome, ms, value): what became of every depth message (snapshot, accept, buffer, old, gap), trades,
    and cuts of the connection. A message that waited has a second row when a snapshot sets it free: `at` is that snapshot's line."""
    need, schema = depth_messages(raw).select("symbol", *_NEED), f"symbol string, {OUT}"
    if raw.isStreaming:
        return need.groupBy("symbol").transformWithStateInPandas(_Keeper(most), schema, "append", "none")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, sync = None, Sync()
        for b in batches:
            for s, rows in b.groupby("symbol", sort=False):
                if s != symbol:
                    symbol, sync = s, Sync()
                yield pd.DataFrame([(s, *r) for r in _folded(sync, rows[_NEED], most)], columns=["symbol", *_COLUMNS])

    return need.repartition("symbol").sortWithinPartitions("symbol", "line").mapInPandas(run, schema)


def synced(raw: DataFrame, most: int = WAITING) -> DataFrame:
    """Events of a combined stream of depth and trades whose books are right from the snapshot on; seq.line says from which message
    an event holds and its place there. A snapshot has the time of the first update after it."""
    m = outcomes(raw, most).where("outcome not in ('buffer', 'old')")
    at = lambda p: F.get_json_object("value", f"$.{p}")
    levels = lambda p: pairs(F.from_json(at(p), "array<array<string>>"))
    s, ts = F.col("symbol"), F.col("ms") * 1000
    whole = F.array(snapshot(s, ts, held(levels("bids")), held(levels("asks"))))
    change = F.concat(deltas_of(levels("b"), s, ts, "bid"), deltas_of(levels("a"), s, ts, "ask"))
    price, qty = number(at("p")), number(at("q"))
    deal: Column = F.when((price > 0) & (qty > 0), F.array(trade(s, ts, price, qty, ~F.coalesce(at("m") == "true", F.lit(False)))))
    kind = F.col("outcome")
    events = F.when(kind == "snapshot", whole).when(kind == "accept", change).when(kind == "trade", F.coalesce(deal, none())).when(kind == "gap", F.array(gap(s, ts))).otherwise(F.array(lost_connection(s, ts)))
    return emitted(m.select("symbol", "outcome", "ms", "value", F.struct("at", "nth").alias("line")), events, "binance")


"""Books, features and labels on streams: the same results as in batches, in event time.

Events of an instrument wait in its state until the watermark has passed them and are then taken in order of
time and sequence, whatever order they came in; an event that comes later than `delay` is late, and Spark drops
it. So a book or label never has to be taken back. State is kept by instrument in RocksDB, as maps: waiting events by
their place, a book's levels by side and price, recent trades, and rows whose labels are open. A batch reads an
instrument's maps and writes only the entries that changed. Operators can stand behind each other in one query: what one
gives carries the watermark as its event time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lobspark.operators import features as feats
from lobspark.operators.asof import HORIZONS
from lobspark.operators.book import Book

LEVELS = "array<struct<price:double,qty:double>>"
PLACE = "ts bigint, line bigint, nth int, pos int"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def replayed(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Raw messages (value, line) from text files of a folder, a few files a micro-batch; `line` is given by the files, as `line<tab>message`."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return raw.selectExpr("cast(split(value, '\t', 2)[0] as bigint) as line", "split(value, '\t', 2)[1] as value")


def _number(x: object) -> object:
    """A value for a state: missing as None, numbers as Python's."""
    if x is None or isinstance(x, str):
        return x
    return None if pd.isna(x) else x.item() if hasattr(x, "item") else x


class InOrder(StatefulProcessor):
    """An instrument's rows in order of event time: those that the watermark has passed go to take(), the others wait.

    take() gets rows (ts, line, nth, pos, fields...) and whether no more will come, and gives rows (ts, line, nth, pos, out...).
    With idle_us an instrument whose last row the watermark has passed by so much ends, and its state goes."""

    def __init__(self, fields: str, out: str, idle_us: int | None = None) -> None:
        self.fields, self.out, self.idle_us = fields, out, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", PLACE, self.fields)
        self.clock = handle.getValueState("clock", "last bigint, taken bigint, timer bigint")
        self.states = [self.waiting, self.clock, *self.opened(handle)]

    def opened(self, handle: StatefulProcessorHandle) -> list:
        raise NotImplementedError

    def take(self, rows: list[tuple], ends: bool) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["ts_us", "line", "nth", "pos", *[f.split()[0] for f in self.fields.split(", ")]]
        new = [tuple(map(_number, r)) for b in rows for r in b[names].itertuples(index=False)]
        yield self._advanced(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advanced(key[0], [], timerValues.getCurrentWatermarkInMs())

    def _advanced(self, symbol: str, new: list[tuple], watermark: int) -> pd.DataFrame:
        last, taken, timer = self.clock.get() if self.clock.exists() else (0, 0, -1)
        passed = watermark * 1000
        new = [r for r in new if r[0] > taken]  # Spark lets events pass that are late since the batch before
        ready = [r for r in new if r[0] <= passed]
        old = [(tuple(k), tuple(v)) for k, v in self.waiting.iterator()]
        for k, v in old:
            if k[0] <= passed:
                ready.append((*k, *v))
                self.waiting.removeKey(k)
        still = [r for r in new if r[0] > passed]
        for r in still:
            self.waiting.updateValue(r[:4], r[4:])
        ready.sort(key=lambda r: r[:4])
        last = max([last, *(r[0] for r in ready)])
        times = [r[0] for r in still] + [k[0] for k, _ in old if k[0] > passed]
        ends = self.idle_us is not None and not times and last + self.idle_us <= passed
        found = self.take(ready, ends)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        wake = min(times, default=None if self.idle_us is None else last + self.idle_us)
        if ends:
            for state in self.states:
                state.clear()
        else:
            timer = -1 if wake is None else max(-(-wake // 1000), watermark + 1)
            if timer >= 0:
                self.handle.registerTimer(timer)
            self.clock.update((last, max(passed, taken), timer))
        names = ["symbol", "ts_us", "line", "nth", "pos", *[c.split()[0] for c in self.out.split(", ")], "event_time"]
        # What leaves must not be older than the watermark, so it has that as its event time.
        now = datetime.fromtimestamp(max(watermark, 0) / 1000, timezone.utc).replace(tzinfo=None)
        return pd.DataFrame([(symbol, *r, now) for r in found], columns=names)

    def close(self) -> None:
        pass


def _place(rows: DataFrame) -> tuple[list[Column], Column]:
    """Columns line, nth and pos of seq, and seq from them again."""
    kind = rows.schema["seq"].dataType
    if not isinstance(kind, T.StructType):
        return [F.col("seq").alias("line"), F.lit(0).alias("nth"), F.lit(0).alias("pos")], F.col("line")
    if isinstance(kind["line"].dataType, T.StructType):
        return [F.col("seq.line.at").alias("line"), F.col("seq.line.nth").alias("nth"), F.col("seq.pos").alias("pos")], F.struct(F.struct(F.col("line").alias("at"), "nth").alias("line"), "pos")
    return [F.col("seq.line").alias("line"), F.lit(0).alias("nth"), F.col("seq.pos").alias("pos")], F.struct("line", "pos")


def in_order(rows: DataFrame, fields: list[Column], processor: InOrder, delay: str) -> DataFrame:
    """symbol, ts_us, seq, what the processor gives, and event_time. Rows that already carry a watermark keep it."""
    if "RocksDB" not in rows.sparkSession.conf.get(_STORE, ""):
        raise ValueError(f"set {_STORE} to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider: states here are maps")
    place, seq = _place(rows)
    timed = rows.where("symbol is not null and ts_us is not null")
    if "event_time" not in rows.columns:
        timed = timed.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    schema = f"symbol string, ts_us bigint, line bigint, nth int, pos int, {processor.out}, event_time timestamp"
    need = timed.select("symbol", "event_time", "ts_us", *place, *fields)
    done = need.groupBy("symbol").transformWithStateInPandas(processor, schema, "append", "eventTime", eventTimeColumnName="event_time")
    return done.select("symbol", "ts_us", seq.alias("seq"), *[c.split()[0] for c in processor.out.split(", ")], "event_time")


def _levels(text: str | None) -> list[dict] | None:
    return None if text is None else json.loads(text)


class _Books(InOrder):
    """Levels by side and price; of trades those that still count, where asked for."""

    def __init__(self, depth: int, replace: bool, cuts: int | None, beta: float | None) -> None:
        out = f"top_bids {LEVELS}, top_asks {LEVELS}, gap_id bigint"
        if beta is not None:
            out += f", before_bids {LEVELS}, before_asks {LEVELS}, before_ts bigint, near double, last_price double, last_qty double"
        super().__init__("kind string, side string, price double, qty double, bids string, asks string", out)
        self.depth, self.replace, self.cuts, self.beta = depth, replace, cuts, beta

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")
        self.facts = handle.getValueState("facts", "ts bigint, gaps bigint, conn bigint, before bigint, last_price double, last_qty double")
        self.trades = handle.getMapState("trades", PLACE, "n int")
        return [self.levels, self.facts, self.trades]

    def take(self, rows: list[tuple], ends: bool) -> list[tuple]:
        if not rows:
            return []
        book = Book()
        ts, gaps, conn, before, *deal = self.facts.get() if self.facts.exists() else (None, 0, None, None, None, None)
        was = {tuple(k): v[0] for k, v in self.levels.iterator()}
        for (side, price), qty in was.items():
            (book.bids if side == "bid" else book.asks).put(price, qty)
        book.ts = ts
        span = 0 if self.beta is None else feats.kept_us(self.beta)
        recent = sorted(tuple(k) for k, _ in self.trades.iterator()) if span else []
        known, top = set(recent), lambda: (book.bids.top(self.depth), book.asks.top(self.depth))
        tops, out = top() if before is not None else None, []
        for ts, line, nth, pos, kind, side, price, qty, bids, asks in rows:
            now = None if self.cuts is None else line >> self.cuts
            lost = kind in ("gap", "disconnected") or (conn is not None and now != conn)
            conn = now
            if lost:
                gaps, tops, before = gaps + 1, None, None
            if kind == "trade" and span:
                recent.append((ts, line, nth, pos))
                deal = [price, qty]
            if kind not in ("delta", "snapshot") or book.apply(kind, side, price, qty, ts, _levels(bids), _levels(asks), self.replace) is not None:
                continue
            own = top()
            row = (ts, line, nth, pos, *own, gaps)
            if span:
                while recent and recent[0][0] < ts - span:
                    recent.pop(0)
                near = sum(math.exp(-self.beta * 1e-6 * (ts - t[0])) for t in recent)
                row += (*(tops or (None, None)), before, near, *deal)
            out.append(row)
            tops, before = own, ts
        held = {("bid" if s is book.bids else "ask", s.sign * k): s.qty[k] for s in (book.bids, book.asks) for k in s.keys}
        for k in was.keys() - held.keys():
            self.levels.removeKey(k)
        for k, q in held.items():
            if was.get(k) != q:
                self.levels.updateValue(k, (q,))
        for k in known - set(recent):
            self.trades.removeKey(k)
        for k in recent:
            if k not in known:
                self.trades.updateValue(k, (1,))
        self.facts.update((book.ts, gaps, conn, before, *deal))
        return out


_BOOK_FIELDS = ["kind", "side", "price", "qty"]


def _book_stream(events: DataFrame, depth: int, delay: str, mode: str, cuts: int | None, beta: float | None) -> DataFrame:
    fields = [*map(F.col, _BOOK_FIELDS), *[F.to_json(c).alias(c) for c in ("bids", "asks")]]
    return in_order(events, fields, _Books(depth, mode == "l1_replace", cuts, beta), delay)


def books(events: DataFrame, depth: int = 10, delay: str = "0 seconds", mode: str = "delta", cuts: int | None = None) -> DataFrame:
    """symbol, ts_us, seq, top_bids, top_asks, gap_id (gaps so far), event_time after each book event; a gap empties nothing but
    starts features anew, a snapshot replaces. cuts: bits of seq.line below the number of the connection; where that changes, the
    feed was cut, and every instrument's features start anew with its next event."""
    return _book_stream(events, depth, delay, mode, cuts, None)


def features(events: DataFrame, delay: str = "0 seconds", mode: str = "delta", cuts: int | None = None, mu: float = feats.MU, alpha: float = feats.ALPHA, beta: float = feats.BETA) -> DataFrame:
    """symbol, ts_us, seq, gap_id, mid, the eleven features and event_time after each book event, as features.extracted gives for a batch.
    The state gives each row the levels before it and what trades are near; the features themselves are the batch's expressions."""
    rows = feats.prepared(feats.prepared(_book_stream(events, 10, delay, mode, cuts, beta)), "before_bids", "before_asks", "before_")
    out = feats.measured(rows, {"ts_us": F.col("before_ts"), **{c: F.col(f"before_{c}") for c in ("bq", "net1", "net5", "net10")}})
    out = out.withColumns({"trade_intensity": mu + alpha * F.col("near"), "price_impact": feats.impact(F.col("last_price"), F.col("last_qty"))})
    return out.select("symbol", "ts_us", "seq", "gap_id", "mid", *feats.NAMES, "relative_spread", "event_time")


class _Labels(InOrder):
    """Open rows by place, with what they have so far."""

    def __init__(self, order: list[tuple[str, int]], carry: list[str], idle_us: int | None) -> None:
        kept = "".join(f", {c} double" for c in carry)
        super().__init__(f"mid double{kept}", f"mid double{kept}, " + ", ".join(f"r_{h} double" for h, _ in order), idle_us)
        self.order, self.carry = order, carry

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.open = handle.getMapState("open", PLACE, self.out)
        return [self.open]

    def take(self, rows: list[tuple], ends: bool) -> list[tuple]:
        n, longest = 1 + len(self.carry), self.order[-1][1]
        was = {tuple(k): tuple(v) for k, v in self.open.iterator()}
        waiting = [[k, list(v[:n]), list(v[n:])] for k, v in sorted(was.items())]
        # Rows are in order of time, so each horizon's open rows start where its last ones ended.
        done = [sum(w[2][i] is not None for w in waiting) for i in range(len(self.order))]
        out = []
        for *place, mid, _ in ((*r[:5], r[5:]) for r in rows):
            if mid is None:
                continue
            if mid > 0:
                waiting.append([tuple(place), [mid, *_], [None] * len(self.order)])
            for i, (_h, us) in enumerate(self.order):
                while done[i] < len(waiting) and waiting[done[i]][0][0] + us <= place[0]:
                    row = waiting[done[i]]
                    row[2][i] = (mid - row[1][0]) / row[1][0]
                    done[i] += 1
            ready = 0
            while ready < len(waiting) and waiting[ready][0][0] + longest <= place[0]:
                ready += 1
            out += [(*k, *v, *r) for k, v, r in waiting[:ready]]
            del waiting[:ready]
            done = [d - ready for d in done]
        if ends:
            out += [(*k, *v, *r) for k, v, r in waiting]
            waiting = []
        held = {k: (*v, *r) for k, v, r in waiting}
        for k in was.keys() - held.keys():
            self.open.removeKey(k)
        for k, v in held.items():
            if was.get(k) != v:
                self.open.updateValue(k, v)
        return out


def labels(rows: DataFrame, horizons: dict[str, int] = HORIZONS, delay: str = "0 seconds", idle_us: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """symbol, ts_us, seq, mid, the doubles to carry, forward returns and event_time, each row once a later row of its instrument is past
    its longest horizon. Open rows leave with what they have once the instrument is idle for idle_us; else they wait."""
    order = sorted(horizons.items(), key=lambda x: x[1])
    return in_order(rows, [F.col(c).cast("double").alias(c) for c in ("mid", *carry)], _Labels(order, list(carry), idle_us), delay)

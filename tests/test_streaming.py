"""Streams give what batches give."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lobspark.operators import book
from lobspark.operators import features as feats
from lobspark.operators.asof import HORIZONS, labelled
from lobspark.sources import captures, feeds
from lobspark.sources import depth as feed_depth
from lobspark.streaming import bars
from lobspark.streaming import books as streams


@pytest.fixture(autouse=True)
def one_partition(spark):
    """A stream's states are kept by as many workers as there are partitions, which these few rows do not need."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def messages(n=120):
    rng, out = random.Random(9), []
    for i in range(n):
        lv = lambda: [{"price": round(rng.uniform(99, 100) if s else rng.uniform(100.01, 101), 1), "qty": rng.choice([0, 1, 2, 3])} for _ in range(2)]
        s = True
        bids = lv()
        s = False
        asks = lv()
        out.append({"channel": "book", "type": "snapshot" if i in (0, 70) else "update", "data": [{"symbol": rng.choice(["A", "B"]), "timestamp_ms": 1_000_000 + i * 7000, "bids": bids, "asks": asks, "checksum": 0}]})
    return [json.dumps(m) for m in out]


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return query.sparkSession.table(name)


def replay(tmp_path, lines, order, end=10**9):
    """Files of messages that a stream reads in this order, and last one far ahead in time, so that the watermark passes all."""
    parts = [[*enumerate(lines)][k * 40 : (k + 1) * 40] for k in range(3)]
    last = json.dumps({"channel": "book", "type": "update", "data": [{"symbol": "END", "timestamp_ms": end, "bids": [{"price": 1, "qty": 1}], "asks": [], "checksum": 0}]})
    for at, rows in enumerate([*(parts[k] for k in order), [(len(lines), last)]]):
        path = tmp_path / f"{at}.txt"
        path.write_text("".join(f"{i}\t{m}\n" for i, m in rows))
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_books_in_any_order(spark, tmp_path, order):
    lines = messages()
    batch = feeds.kraken(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    want = book.reconstructed(batch).where("kind in ('delta', 'snapshot') and dq_error is null").select("symbol", "ts_us", "seq", "top_bids", "top_asks", "gap_id")
    replay(tmp_path, lines, order)
    got = run(streams.books(feeds.kraken(streams.replayed(spark, str(tmp_path))), delay="1 hour"), f"books_{order[0]}").where("symbol != 'END'").drop("event_time")
    key = ["symbol", "ts_us", "seq"]
    want = [r.asDict(True) for r in want.orderBy(*key).collect()]
    assert [r.asDict(True) for r in got.orderBy(*key).collect()] == want and len(want) > 100


def test_late_events_are_dropped(spark, tmp_path):
    """The watermark of the first file is known in the third batch: the file there is late, and changes no book."""
    lines = messages()
    replay(tmp_path, lines, (2, 0, 1))
    got = run(streams.books(feeds.kraken(streams.replayed(spark, str(tmp_path))), delay="0 seconds"), "books_late").where("symbol != 'END'").drop("event_time")
    batch = feeds.kraken(spark.createDataFrame([(i, m) for i, m in enumerate(lines) if not 40 <= i < 80], "line long, value string"))
    want = book.reconstructed(batch).where("kind in ('delta', 'snapshot') and dq_error is null").select("symbol", "ts_us", "seq", "top_bids", "top_asks", "gap_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_labels(spark, tmp_path):
    batch = feeds.kraken(spark.createDataFrame(list(enumerate(messages())), "line long, value string"))
    key = ["symbol", "ts_us", "seq"]
    whole = book.reconstructed(batch).where("kind in ('delta', 'snapshot') and dq_error is null")
    rows = whole.withColumn("mid", F.get("top_bids", F.lit(0))["price"] + F.get("top_asks", F.lit(0))["price"]).where("mid is not null").select(*key, "mid")
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    rows.limit(1).selectExpr("'END' as symbol", "1000000000000 as ts_us", "seq", "mid").coalesce(1).write.parquet(str(tmp_path / "end"))
    for name, at in (("rows", 0), ("end", 1)):
        for f in (tmp_path / name).glob("*.parquet"):
            (tmp_path / "all").mkdir(exist_ok=True)
            shutil.copy(f, tmp_path / "all" / f"{name}.parquet")
            os.utime(tmp_path / "all" / f"{name}.parquet", (1_700_000_000 + at,) * 2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    names = [f"r_{h}" for h in HORIZONS]
    want = {tuple(r[c] for c in key): [r[n] for n in names] for r in labelled(rows, spread=None).collect()}
    for idle, name in ((None, "labels_open"), (1_000_000, "labels_flushed")):
        got = {tuple(r[c] for c in key): [r[n] for n in names] for r in run(streams.labels(stream, delay="1 hour", idle_us=idle), name).where("symbol != 'END'").collect()}
        assert got == {k: v for k, v in want.items() if idle or v[-1] is not None} and len(got) > 50


def test_sequence_rules_on_streams(spark, tmp_path):
    """Feeds with rules, and some without, start as streams, and gaps are found as in batches."""
    m = lambda a, s, p: json.dumps({"action": a, "arg": {"channel": "books", "instId": "BTC-USDT"}, "data": [{"bids": [["1", "2"]], "asks": [], "ts": "5", "seqId": s, "prevSeqId": p}]})
    lines = [m("snapshot", 1, -1), m("update", 2, 1), m("update", 9, 7), m("update", 10, 9)]
    for k, line in enumerate(lines):
        (tmp_path / f"{k}.txt").write_text(f"{k}\t{line}\n")
        os.utime(tmp_path / f"{k}.txt", (1_700_000_000 + k,) * 2)
    batch = feeds.okx(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    got = run(feeds.okx(streams.replayed(spark, str(tmp_path))), "okx_out")
    assert [r.kind for r in got.orderBy("seq").collect()] == [r.kind for r in batch.orderBy("seq").collect()] == ["snapshot", "delta", "gap", "delta"]
    for name, parser in feeds.FEEDS.items():
        if name in ("okx", "bybit", "binance", "gemini", "dukascopy", "iex", "alpaca"):
            out = run(parser(streams.replayed(spark, str(tmp_path)), *(["X"] if name in feeds.OF_ONE_SYMBOL else [])), f"start_{name}")
            assert (out.count() > 0) == (name == "okx")
    # One query holds one stateful operator, so books of such a feed read what a first query wrote.
    q = feeds.okx(streams.replayed(spark, str(tmp_path))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "events"))
    q.awaitTermination(120)
    events = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    rows = run(streams.books(events), "okx_books")
    assert [r.gap_id for r in rows.orderBy("seq").collect()] == [0, 0, 1]


# --- Captures -------------------------------------------------------------------------------------------

def write(folder, name, lines, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"{m}\n" for m in lines[:-1]) + (f"{lines[-1]}{end}" if lines else ""))


def drained(df, sink, checkpoint):
    q = df.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


@pytest.mark.parametrize("split", [1, 37, 1 << 20])
def test_captures_give_every_line_once_in_order(spark, tmp_path, split):
    lines = [f"{i} é " + "x" * (i % 50) for i in range(300)]
    for k, (a, z) in enumerate([(0, 7), (7, 7), (7, 290), (290, 300)]):
        write(tmp_path, f"{k}.txt", lines[a:z], end="" if k == 3 else "\n")
    (tmp_path / "_ignored").write_text("no\n")
    got = captures.recorded(spark, str(tmp_path), split=split).orderBy("line").collect()
    assert [r.value for r in got] == lines and len({r.line for r in got}) == 300
    assert [r.c - captures.LIVE for r in captures.recorded(spark, str(tmp_path)).select(captures.connection(F.col("line")).alias("c")).distinct().orderBy("c").collect()] == [0, 2, 3]


def test_a_stream_of_captures_goes_on_where_it_was(spark, tmp_path):
    """Stopped between batches: whole lines alone, no loss, no repeat; a file that grows and new files are taken up."""
    at, sink, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    lines = [f"m{i}" for i in range(50)]
    write(at, "a", lines[:10], end="")  # its last line has no end yet
    drained(captures.recorded(spark, str(at), stream=True), sink, cp)
    assert spark.read.parquet(str(sink)).count() == 9
    write(at, "a", lines[:20])
    write(at, "b", lines[20:30])
    drained(captures.recorded(spark, str(at), stream=True), sink, cp)
    drained(captures.recorded(spark, str(at), stream=True), sink, cp)
    assert [r.value for r in spark.read.parquet(str(sink)).orderBy("line").collect()] == lines[:30]
    write(at, "c", lines[30:])
    drained(captures.recorded(spark, str(at), stream=True), sink, cp)
    assert [r.value for r in spark.read.parquet(str(sink)).orderBy("line").collect()] == lines
    write(at, "aa", ["late"])
    with pytest.raises(Exception, match="named in order"):
        drained(captures.recorded(spark, str(at), stream=True), sink, cp)


def test_streams_need_an_order(spark, tmp_path):
    write(tmp_path, "a.txt", ["x"])
    with pytest.raises(ValueError, match="line"):
        feeds.kraken(spark.readStream.text(str(tmp_path)))


# --- Backfill, then live ------------------------------------------------------------------------------------

def kline(minute, close):
    return [minute * 60_000, "10", "12", "9", str(close), "5000", minute * 60_000 + 59_999, "0"]


def test_backfill_then_live_gives_every_bar_once(spark, tmp_path):
    past, live, sink, cp = (tmp_path / n for n in ("past", "live", "out", "cp"))
    # Pages were fetched newest first and overlap; polls give the last two bars, and some twice.
    for page, (a, z) in enumerate([(20, 30), (10, 21), (0, 11)]):
        write(past, f"{page}.json", [json.dumps([kline(m, 10 + m) for m in range(a, z)])])
    read = lambda: bars.once(feeds.binance_klines(captures.recorded(spark, str(live), stream=True, backfill=str(past), newest_first=True), "btc"))
    live.mkdir()
    drained(read(), sink, cp)
    assert spark.read.parquet(str(sink)).count() == 60
    for poll, minutes in enumerate([(28, 29), (29, 30), (30, 31), (30, 31), (33, 34)]):
        write(live, f"{poll}.json", [json.dumps([kline(m, 10 + m) for m in minutes])])
        if poll in (1, 4):
            drained(read(), sink, cp)
    got = spark.read.parquet(str(sink)).where("kind = 'trade'").orderBy("seq").select("ts_us", "price").collect()
    want = [m for m in range(35) if m != 32]
    assert [(r.ts_us, r.price) for r in got] == [((m * 60_000 + 59_999) * 1000, 10.0 + m) for m in want]
    # A batch over both phases gives the same.
    whole = bars.once(feeds.binance_klines(captures.recorded(spark, str(live), backfill=str(past), newest_first=True), "btc"))
    assert sorted((r.kind, r.ts_us) for r in whole.collect()) == sorted((r.kind, r.ts_us) for r in spark.read.parquet(str(sink)).collect())


# --- Depth --------------------------------------------------------------------------------------------------

def depth(first, until, s="BTC", price=100):
    return json.dumps({"stream": f"{s.lower()}@depth", "data": {"e": "depthUpdate", "E": 1000 + until, "s": s, "U": first, "u": until, "b": [[str(price), "1"]], "a": []}})


def whole(last, s="BTC"):
    return json.dumps({"stream": f"{s.lower()}@snapshot", "data": {"lastUpdateId": last, "bids": [["99", "5"], ["98", "0"]], "asks": [["101", "4"]]}})


DEAL = json.dumps({"stream": "btc@aggTrade", "data": {"e": "aggTrade", "T": 5, "p": "100", "q": "2", "m": True}})
#: Messages, and what becomes of each in turn (waiting ones twice).
DEPTH = {
    "late snapshot": ([depth(1, 4), depth(5, 8), depth(9, 12), whole(6), depth(13, 14)], ["buffer"] * 3 + ["snapshot", "old", "accept", "accept", "accept"]),
    "missed update": ([whole(10), depth(11, 12), depth(15, 16), depth(17, 18), whole(17), depth(19, 20)], ["snapshot", "accept", "gap", "buffer", "snapshot", "accept", "accept"]),
    "old update": ([whole(10), depth(3, 5), depth(6, 11), DEAL, depth(12, 12)], ["snapshot", "old", "accept", "trade", "accept"]),
    "snapshot too old": ([depth(20, 22), whole(10), depth(23, 24), whole(23), depth(25, 25)], ["buffer", "snapshot", "gap", "buffer", "snapshot", "accept", "accept"]),
    "repeated update": ([whole(1), depth(2, 3), depth(2, 3), depth(4, 4)], ["snapshot", "accept", "gap", "buffer"]),
    "none": ([depth(1, 2), depth(3, 4)], ["buffer", "buffer"]),
}


@pytest.mark.parametrize("name", DEPTH)
def test_depth_outcomes(spark, tmp_path, name):
    messages, want = DEPTH[name]
    at = tmp_path / "in"
    write(at, "a", [*messages, depth(1, 2, "ETH")])
    order = ["symbol", "at", "nth", "line"]
    batch = [tuple(r) for r in feed_depth.outcomes(captures.recorded(spark, str(at))).orderBy(*order).collect()]
    assert [r[4] for r in batch if r[0] == "BTC"] == want
    # As a stream of two batches.
    grown, sink, cp = tmp_path / "grown", tmp_path / "out", tmp_path / "cp"
    lines = [*messages, depth(1, 2, "ETH")]
    for n in (3, len(lines)):
        write(grown, "a", lines[:n])
        drained(feed_depth.outcomes(captures.recorded(spark, str(grown), stream=True)), sink, cp)
    assert [tuple(r) for r in spark.read.parquet(str(sink)).orderBy(*order).collect()] == batch


def test_synced_books(spark, tmp_path):
    write(tmp_path, "a", [depth(1, 4, price=97), depth(5, 8, price=96), whole(6), depth(9, 9, price=99.5), depth(12, 12)])
    write(tmp_path, "b", [depth(13, 14), whole(13), depth(15, 15)])
    events = feed_depth.synced(captures.recorded(spark, str(tmp_path))).orderBy("seq")
    got = [(r.kind, r.ts_us, r.price) for r in events.collect()]
    assert got == [("snapshot", 1_008_000, None), ("delta", 1_008_000, 96), ("delta", 1_009_000, 99.5), ("gap", 1_012_000, None), ("disconnected", 1_012_000, None), ("snapshot", 1_014_000, None), ("delta", 1_014_000, 100), ("delta", 1_015_000, 100)]
    top = book.reconstructed(events).orderBy("ts_us", "seq").collect()
    assert [[(x.price, x.qty) for x in r.top_bids] for r in top if r.kind == "delta"][0] == [(99, 5), (96, 1)] and top[-1].gap_id == 2


# --- Features -------------------------------------------------------------------------------------------------

def test_features_over_gaps_and_cuts(spark, tmp_path):
    """A stream's features equal the batch's, over gaps, trades and connections."""
    rng, lines = random.Random(11), []
    for i in range(240):
        lv = lambda lo, hi: [[str(round(rng.uniform(lo, hi), 1)), str(rng.choice([0, 1, 2, 3]))] for _ in range(2)]
        s, ms = rng.choice(["AA", "BB"]), 1_000_000 + i * 700
        lines.append(json.dumps({"e": "depthUpdate", "E": ms, "s": s, "U": 10_000 + 2 * i - (40 if i % 9 else 0), "u": 10_000 + 2 * i, "b": lv(99, 100), "a": lv(100.1, 101)}))
        if i % 3 == 0:
            lines.append(json.dumps({"e": "aggTrade", "T": ms, "s": s, "p": "100", "q": "2", "m": False}))
    end = json.dumps({"e": "depthUpdate", "E": 10**9, "s": "END", "U": 1, "u": 2, "b": [["1", "1"]], "a": []})
    at = tmp_path / "in"
    for k in range(3):
        write(at, f"{k}", lines[k * 107 : (k + 1) * 107])
    batch = feeds.binance(captures.recorded(spark, str(at)))
    cut = book.reconstructed(batch.withColumn("conn", captures.connection(F.col("seq.line")))).where("kind in ('delta', 'snapshot') and dq_error is null")
    names = ["gap_id", "mid", *feats.NAMES, "relative_spread"]
    want = {(r.symbol, r.ts_us, r.seq.line, r.seq.pos): [r[n] for n in names] for r in feats.extracted(cut, batch.where("kind = 'trade'")).collect()}
    # A feed with rules keeps a state of its own, so its events are written first.
    events, sink, cp = tmp_path / "events", tmp_path / "out", tmp_path / "cp"
    for last in (None, "3"):
        if last:
            write(at, last, [end])
        drained(feeds.binance(captures.recorded(spark, str(at), stream=True)), events, tmp_path / "cp0")
        drained(streams.features(spark.readStream.schema(batch.schema).parquet(str(events)), cuts=captures.BYTE_BITS), sink, cp)
    got = {(r.symbol, r.ts_us, r.seq.line, r.seq.pos): [r[n] for n in names] for r in spark.read.parquet(str(sink)).where("symbol <> 'END'").collect()}
    assert got.keys() == want.keys() and len(got) > 400 and len({v[0] for v in got.values()}) > 10
    for k, v in want.items():
        assert got[k] == [x if x is None else pytest.approx(x, rel=1e-9, abs=1e-12) for x in v], k


def test_labels_behind_features_in_one_query(spark, tmp_path):
    rng, lines = random.Random(12), []
    for i in range(120):
        up = {"symbol": rng.choice("AB"), "timestamp_ms": 1_000_000 + i * 700, "bids": [{"price": round(rng.uniform(99, 100), 1), "qty": 2}], "asks": [{"price": round(rng.uniform(100.1, 101), 1), "qty": 1}], "checksum": 0}
        lines.append(json.dumps({"channel": "book", "type": "update", "data": [up]}))
    ends = [json.dumps({"channel": "book", "type": "update", "data": [{"symbol": "END", "timestamp_ms": t, "bids": [{"price": 1, "qty": 1}], "asks": [], "checksum": 0}]}) for t in (10**8, 10**9, 10**10)]
    at, sink, cp, horizons = tmp_path / "in", tmp_path / "out", tmp_path / "cp", {"1s": 1_000_000, "5s": 5_000_000}
    write(at, "0", lines[:70])
    read = lambda: streams.labels(streams.features(feeds.kraken(captures.recorded(spark, str(at), stream=True))), horizons, carry=("ofi_1", "spread"))
    drained(read(), sink, cp)
    for k, more in enumerate([lines[70:], *([e] for e in ends)]):
        write(at, str(k + 1), more)
        drained(read(), sink, cp)
    batch = feeds.kraken(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    whole = labelled(feats.extracted(book.reconstructed(batch)).where("mid is not null"), horizons=horizons, signs=())
    names = ["mid", "ofi_1", "spread", "r_1s", "r_5s"]
    want = sorted((r.symbol, r.ts_us, r.seq.pos, *(r[n] for n in names)) for r in whole.where("r_5s is not null").collect())
    got = sorted((r.symbol, r.ts_us, r.seq.pos, *(r[n] for n in names)) for r in spark.read.parquet(str(sink)).collect())
    assert len(want) > 150 and str(got) == str(want)

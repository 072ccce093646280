"""Feed parsers on literal messages."""

import json
import lzma
import struct

import pytest

from lobspark.sources.feeds import FEEDS, OF_ONE_SYMBOL


def read(spark, feed, *messages, **options):
    rows = [(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages)]
    args = ["X"] if feed in OF_ONE_SYMBOL else []
    df = FEEDS[feed](spark.createDataFrame(rows, "line long, value string"), *args, **options)
    return [r.asDict(recursive=True) for r in df.orderBy("seq").collect()]


def test_any_number_of_partitions_and_events(spark, tmp_path):
    """Messages come from many files without a line, and one has thousands of events."""
    rows = [[{"T": "t", "S": f"S{k}", "p": 1 + i, "s": 2, "t": "2023-01-01T15:00:00Z"} for i in range(5000 if k == 3 else 2)] for k in range(8)]
    for k, m in enumerate(rows):
        (tmp_path / f"{k}.txt").write_text(json.dumps(m))
    raw = spark.read.text(str(tmp_path)).repartition(8)
    got = FEEDS["alpaca"](raw).groupBy("symbol").agg({"*": "count", "price": "sum"}).collect()
    assert {r["symbol"]: (r["count(1)"], r["sum(price)"]) for r in got} == {f"S{k}": (len(m), sum(e["p"] for e in m)) for k, m in enumerate(rows)}
    assert FEEDS["alpaca"](raw).select("seq").distinct().count() == sum(map(len, rows))
    for feed in FEEDS:
        if feed != "lobster_book":
            FEEDS[feed](raw, *(["X"] if feed in OF_ONE_SYMBOL else [])).count()
    up = {"side": "bid", "price_level": "1", "new_quantity": "2"}
    many = {"channel": "l2_data", "timestamp": "2023-01-01T15:00:00Z", "events": [{"type": "update", "product_id": f"P{i}", "updates": [up] * 20} for i in range(400)]}
    assert len(read(spark, "coinbase", many)) == 8000
    bars = [[i, "10", "12", "9", "11", "5000", 60_000 * i, "0"] for i in range(5000)]
    assert len(read(spark, "binance_klines", bars)) == 10_000


def brief(events):
    return [(e["kind"], e["symbol"], e["ts_us"], e["side"], e["price"], e["qty"]) for e in events]


def test_lobster(spark):
    got = read(spark, "lobster", "34200.017459617,1,11885113,21,1234567,1", "34200.1,3,1,5,1000000,-1", "34200.2,4,1,7,1000000,1", "34200.3,7,0,0,0,-1", "garbage", "1,2,3")
    assert brief(got) == [("delta", "X", 34200017459, "bid", 123.4567, 21), ("delta", "X", 34200100000, "ask", 100, 0), ("trade", "X", 34200200000, None, 100, 7), ("gap", "X", 34200300000, None, None, None)]
    assert got[2]["is_buy"] is False and got[3]["gap_flag"] and got[3]["is_imputed"]


def test_lobster_book(spark):
    got = read(spark, "lobster_book", "", "1010000,5,1000000,7,1020000,0,990000,3", "1,1,1,1,1,1,1,1", levels=2)
    assert len(got) == 1 and got[0]["bids"] == [{"price": 100.0, "qty": 7.0}, {"price": 99.0, "qty": 3.0}] and got[0]["asks"] == [{"price": 101.0, "qty": 5.0}]
    with pytest.raises(Exception, match="columns"):
        read(spark, "lobster_book", "1,2,3", levels=2)


def test_iex(spark):
    q = {"messageType": "Q", "symbol": "A", "bidSize": 0, "bidPrice": 10.0, "askPrice": 10.1, "askSize": 3, "lastUpdated": 1_000_000_000}
    t = {"type": "T", "symbol": "A", "price": 10.05, "size": 5, "flags": 1, "timestamp": 2_000_000_000}
    got = read(spark, "iex", "# comment", q, "data: " + json.dumps(t), {"messageType": "H"}, "")
    assert brief(got) == [("delta", "A", 1_000_000, "bid", 10.0, 0), ("delta", "A", 1_000_000, "ask", 10.1, 3), ("trade", "A", 2_000_000, None, 10.05, 5)] and got[2]["is_buy"]
    assert brief(read(spark, "iex", "data: " + json.dumps([q, t]), "data: []", "data: [1, null]")) == brief(got)


def test_order_over_files(spark, tmp_path):
    """A small early file and a large later one: Spark packs the large one first, but lines follow files."""
    for name, lines in {
        "binance": [json.dumps({"e": "depthUpdate", "E": i, "s": "A", "U": i + 1, "u": i + 1, "b": [["1", "1"]], "a": [["2", "1"]]}) for i in range(1000)],
        "dukascopy": [f"2023-01-{1 + (i >= 100):02d} 00:{i // 60 % 60:02d}:{i % 60:02d}.000,1.2,1.1,1,1" for i in range(1000)],
        "gemini": [json.dumps({"type": "update", "timestampms": i, "socket_sequence": i, "events": [{"type": "change", "reason": "place", "price": "1", "remaining": "1", "side": "bid"}] * 2}) for i in range(1000)],
        "okx": [json.dumps({"action": "update" if i else "snapshot", "arg": {"instId": "A"}, "data": [{"bids": [["1", "1"], ["2", "2"]], "asks": [], "ts": str(i), "seqId": i, "prevSeqId": i - 1}]}) for i in range(1000)],
        "bybit": [json.dumps({"topic": "x", "type": "delta" if i else "snapshot", "ts": i, "data": {"s": "A", "b": [["1", "1"], ["2", "2"]], "a": [], "u": i}}) for i in range(1000)],
    }.items():
        at = tmp_path / name
        at.mkdir()
        (at / "1.txt").write_text("".join(f"{m}\n" for m in lines[:100]))
        (at / "2.txt").write_text("".join(f"{m}\n" for m in lines[100:]))
        events = FEEDS[name](spark.read.text(str(at)), *(["A"] if name in OF_ONE_SYMBOL else []))
        kinds = {r.kind: r["count"] for r in events.groupBy("kind").count().collect()}
        assert kinds == ({"delta": 2000} if name in ("binance", "dukascopy", "gemini") else {"snapshot": 1, "delta": 1998}), name
        assert name != "dukascopy" or events.where("ts_us < 1672617600000000").count() == 200


def test_dukascopy(spark):
    got = read(spark, "dukascopy", "DateTime,Ask,Bid,AskVolume,BidVolume", "1970.01.01 00:00:00.000,1.2,1.1,3,4", "1970-01-01T00:00:02.500,1.3,1.2,2", "1970-01-01 00:00:01,1.3,1.2,2,2", "1970-01-01 00:00:03,1.0,1.2,1,1")
    assert brief(got)[:4] == [("delta", "X", 0, "bid", 1.1, 4), ("delta", "X", 0, "ask", 1.2, 3), ("delta", "X", 2_500_000, "bid", 1.2, 2), ("delta", "X", 2_500_000, "ask", 1.3, 2)]
    assert [e["ts_us"] for e in got[4:]] == [2_500_000] * 2  # time does not run back


def test_binance(spark):
    d = lambda U, u: {"e": "depthUpdate", "E": 5, "s": "btcusdt", "U": U, "u": u, "b": [["100.5", "1"], ["0", "1"]], "a": [["101", "0"], ["x", "1"]]}
    got = read(spark, "binance", d(1, 3), d(4, 5), d(2, 3), d(9, 9), {"stream": "btcusdt@aggTrade", "data": {"e": "aggTrade", "T": 7, "p": "100", "q": "2", "m": False}})
    assert [e["kind"] for e in got] == ["delta", "delta", "delta", "delta", "gap", "delta", "delta", "trade"]
    assert brief(got)[:2] == [("delta", "BTCUSDT", 5000, "bid", 100.5, 1), ("delta", "BTCUSDT", 5000, "ask", 101, 0)] and got[-1]["is_buy"]


def test_klines(spark):
    got = read(spark, "binance_klines", [[1, "10", "12", "9", "11", "5000", 60_000, "0"]])
    assert brief(got)[0] == ("trade", "X", 60_000_000, None, 11, 5000) and got[0]["is_buy"] and got[1]["bids"] == [{"price": 10.99, "qty": 5.0}]


def test_coinbase(spark):
    up = lambda s, p, q: {"side": s, "price_level": p, "new_quantity": q}
    m = lambda t, *u: {"channel": "l2_data", "timestamp": "2023-01-01T15:00:00Z", "events": [{"type": t, "product_id": "BTC-USD", "updates": list(u)}]}
    got = read(spark, "coinbase", m("snapshot", up("bid", "1", "2"), up("offer", "3", "4")), m("update", up("bid", "1", "0"), up("offer", "3", "5")), {"channel": "heartbeats"})
    assert got[0]["bids"] == [{"price": 1.0, "qty": 2.0}] and got[0]["ts_us"] == 1672585200000000
    assert brief(got)[1:] == [("delta", "BTC-USD", 1672585200000000, "bid", 1, 0), ("delta", "BTC-USD", 1672585200000000, "ask", 3, 5)]


def test_kraken(spark):
    m = lambda t, **d: {"channel": "book", "type": t, "data": [{"symbol": "BTC/USD", "timestamp_ms": 3, "bids": [], "asks": [], "checksum": 1} | d]}
    got = read(spark, "kraken", m("snapshot", bids=[{"price": 1, "qty": 2}]), m("update", asks=[{"price": 3, "qty": 0}]), {"channel": "heartbeat"})
    assert [e["kind"] for e in got] == ["snapshot", "delta"] and brief(got)[1] == ("delta", "BTC/USD", 3000, "ask", 3, 0)


def test_gemini(spark):
    ev = lambda r, p, q, s: {"type": "change", "reason": r, "price": p, "remaining": q, "side": s}
    m = lambda n, *e: {"type": "update", "timestampms": 2, "socket_sequence": n, "events": list(e)}
    got = read(spark, "gemini", m(0, ev("initial", "1", "2", "bid"), ev("initial", "3", "4", "ask")), {"type": "heartbeat", "socket_sequence": 1}, m(2, ev("cancel", "1", "0", "bid"), {"type": "trade"}), m(9, ev("place", "1", "5", "bid")))
    assert [e["kind"] for e in got] == ["snapshot", "delta", "gap"] and brief(got)[1] == ("delta", "X", 2000, "bid", 1, 0)


def test_bitstamp(spark):
    got = read(spark, "bitstamp", {"event": "data", "channel": "order_book_btcusd", "data": {"microtimestamp": "17", "bids": [["1", "2"]], "asks": [["3", "4"]]}}, {"event": "bts:heartbeat"})
    assert brief(got) == [("snapshot", "BTCUSD", 17, None, None, None)] and got[0]["asks"] == [{"price": 3.0, "qty": 4.0}]


def test_okx(spark):
    m = lambda a, s, p: {"action": a, "arg": {"channel": "books", "instId": "BTC-USDT"}, "data": [{"bids": [["1", "2", "0", "1"]], "asks": [["3", "0", "0", "1"]], "ts": "5", "seqId": s, "prevSeqId": p}]}
    got = read(spark, "okx", "pong", m("snapshot", 1, -1), m("update", 2, 1), m("update", 9, 7))
    assert [e["kind"] for e in got] == ["snapshot", "delta", "delta", "gap"] and got[0]["asks"] == []


def test_bybit(spark):
    m = lambda t, u: {"topic": "orderbook.200.BTCUSDT", "type": t, "ts": 4, "data": {"s": "BTCUSDT", "b": [["1", "2"]], "a": [["3", "0"]], "u": u, "seq": 1}}
    got = read(spark, "bybit", m("snapshot", 1), m("delta", 2), m("delta", 5), {"op": "pong"})
    assert [e["kind"] for e in got] == ["snapshot", "delta", "delta", "gap"]


def test_stock_feeds(spark):
    a = read(spark, "alpaca", [{"T": "t", "S": "A", "p": 1.5, "s": 2, "t": "2023-01-01T15:00:00.5Z"}, {"T": "q", "S": "A", "bp": 1, "bs": 0, "ap": 2, "as": 0, "t": "2023-01-01T15:00:00Z"}, {"T": "success"}])
    assert [e["kind"] for e in a] == ["trade", "delta", "delta"] and a[0]["ts_us"] == 1672585200500000 and a[0]["is_buy"]
    p = read(spark, "polygon", [{"ev": "Q", "sym": "A", "bp": 1, "bs": 2, "ap": 3, "as": 4, "t": 5}, {"ev": "T", "sym": "A", "p": 2, "s": 1, "t": 6}, {"ev": "A"}, {"ev": "status"}])
    assert brief(p) == [("delta", "A", 5000, "bid", 1, 2), ("delta", "A", 5000, "ask", 3, 4), ("trade", "A", 6000, None, 2, 1)]
    r = read(spark, "polygon_rest", {"tickers": [{"ticker": "A", "lastQuote": {"p": 1, "s": 2, "P": 3, "S": 4, "t": 5000}, "lastTrade": {"p": 2, "s": 1, "t": 6000}}]})
    assert brief(r) == [("delta", "A", 5, "bid", 1, 2), ("delta", "A", 5, "ask", 3, 4), ("trade", "A", 6, None, 2, 1)]
    t = read(spark, "tiingo", {"messageType": "A", "data": ["T", "spy", None, 10.0, 5, None, 9.9, 1, 10.1, 2, "2023-01-01T15:00:00+00:00"]}, {"messageType": "H"}, {"messageType": "A", "data": ["T", "spy", None, 10.0, 5, None, 0, 1, 10.1, 2, "x"]})
    assert [e["kind"] for e in t] == ["delta", "delta", "trade"] and t[0]["ts_us"] == 1672585200000000 and t[0]["symbol"] == "SPY"
    f = read(spark, "finnhub", {"type": "trade", "data": [{"p": 1.5, "s": "a", "t": 3}, {"p": 2, "s": "a", "t": 4, "v": 9}]}, {"type": "ping"})
    assert brief(f) == [("trade", "A", 3000, None, 1.5, 1), ("trade", "A", 4000, None, 2, 9)]


def test_yahoo(spark):
    c = {"chart": {"result": [{"meta": {"symbol": "spy"}, "timestamp": [1, 2], "indicators": {"quote": [{"close": [10.0, None], "volume": [5, 6]}]}}]}}
    got = read(spark, "yahoo_chart", c)
    assert brief(got) == [("trade", "SPY", 1_000_000, None, 10, 5), ("snapshot", "SPY", 1_000_000, None, None, None)] and got[1]["bids"] == [{"price": 9.99, "qty": 1000.0}]
    q = {"symbol": "spy", "bid": 1, "ask": 2, "bidSize": 3, "regularMarketPrice": 1.5, "regularMarketTime": 7}
    got = read(spark, "yahoo_quote", {"quoteResponse": {"result": [q, q | {"bid": 0}]}})
    assert len(got) == 2 and got[1]["bids"] == [{"price": 1.0, "qty": 300.0}] and got[1]["asks"] == [{"price": 2.0, "qty": 100.0}]


def test_tick_file(spark, tmp_path):
    from lobspark.sources.files import dukascopy_hours

    path = tmp_path / "EURUSD" / "2024" / "00" / "15" / "10h_ticks.bi5"
    path.parent.mkdir(parents=True)
    path.write_bytes(lzma.compress(struct.pack(">IIIff", 0, 110010, 110000, 1.5, 2.5) + struct.pack(">IIIff", 500, 110020, 110010, 0.0, 1.0), format=lzma.FORMAT_ALONE))
    (path.parent / "11h_ticks.bi5").write_bytes(b"")
    rows = dukascopy_hours(spark, str(tmp_path)).orderBy("seq").collect()
    assert len(rows) == 2 and rows[1].ts_us - rows[0].ts_us == 500_000 and rows[0].bids[0].price == pytest.approx(1.1) and rows[1].asks[0].qty == 0.001
    assert rows[0].symbol == "EURUSD" and rows[0].ts_us == 1705312800000000

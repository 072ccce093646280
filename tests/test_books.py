"""Books, features and labels on small cases worked out by hand, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lobspark.operators import book, features
from lobspark.operators.asof import forward_asof, labelled

DELTA = "symbol string, ts_us long, seq long, side string, price double, qty double"
SNAP = "symbol string, ts_us long, seq long, top_bids array<struct<price:double,qty:double>>, top_asks array<struct<price:double,qty:double>>, gap_id long"


def test_best_levels_deletes_and_order():
    b = book.Book()
    for p in (98.0, 100.0, 99.0):
        b.apply("delta", "bid", p, 1.0, 1, None, None)
    b.apply("delta", "ask", 101.0, 5.0, 5, None, None)
    assert [x["price"] for x in b.bids.top(9)] == [100.0, 99.0, 98.0] and b.asks.top(1) == [{"price": 101.0, "qty": 5.0}]
    b.apply("delta", "bid", 100.0, 0.0, 3, None, None)
    assert [x["price"] for x in b.bids.top(9)] == [99.0, 98.0] and b.ts == 5
    assert b.apply("delta", "bid", 1.0, -1.0, 6, None, None) == "negative_qty" and b.apply("delta", "bid", math.nan, 1.0, 6, None, None) == "non_finite_price"
    b.apply("snapshot", None, None, None, 2, [{"price": 99.0, "qty": 20.0}], [{"price": 102.0, "qty": 10.0}])
    assert b.bids.top(9) == [{"price": 99.0, "qty": 20.0}] and b.ts == 2 and not b.crossed()
    b.apply("delta", "bid", 102.0, 1.0, 7, None, None)
    assert b.crossed()


def test_market_orders():
    b = book.Book()
    b.apply("snapshot", None, None, None, 0, [], [{"price": 101.0, "qty": 2.0}, {"price": 102.0, "qty": 3.0}])
    assert b.market_order(True, 4.0) == (101.5, 4.0) and b.asks.top(9) == [{"price": 102.0, "qty": 1.0}]
    assert b.market_order(True, 9.0) == (102.0, 1.0) and b.market_order(True, 1.0) == (0.0, 0.0)


def test_fold_equals_intervals(spark):
    rng = random.Random(3)
    rows = [(rng.choice("AB"), i // 3, i, s := rng.choice(["bid", "ask"]), rng.randrange(90, 100) + (10.5 if s == "ask" else 0.0), float(rng.choice([0, 0, 1, 2, 5]))) for i in range(400)]
    df = spark.createDataFrame(rows, DELTA).repartition(4)
    cols = ["symbol", "ts_us", "seq", "top_bids", "top_asks"]
    one = [tuple(r) for r in book.reconstructed(df, 3).select(cols).orderBy("symbol", "seq").collect()]
    two = [tuple(x or [] if isinstance(x, list) or x is None else x for x in r) for r in book.intervals(df, 3).select(cols).orderBy("symbol", "seq").collect()]
    assert [(*r[:3], list(r[3]), list(r[4])) for r in one] == two and len(one) == 400


def test_best_price_feeds(spark):
    rows = [("A", 1, 1, "bid", 100.0, 1.0), ("A", 2, 2, "bid", 99.0, 1.0), ("A", 3, 3, "ask", 101.0, 1.0)]
    last = book.reconstructed(spark.createDataFrame(rows, DELTA), mode="l1_replace").orderBy("seq").collect()[-1]
    assert [x.price for x in last.top_bids] == [99.0]


def test_features_by_hand(spark):
    lv = lambda *x: [dict(zip(("price", "qty"), v, strict=True)) for v in x]
    rows = [
        ("A", 0, 0, lv((100.0, 10.0)), lv((102.0, 5.0)), 0), ("A", 1_000_000, 1, lv((100.0, 20.0)), lv((102.0, 5.0)), 0), ("A", 2_000_000, 2, lv((100.0, 20.0)), lv((102.0, 15.0)), 0),
        ("A", 2_000_000, 3, lv((100.0, 30.0)), lv((102.0, 10.0)), 0), ("A", 3_000_000, 4, [], lv((102.0, 10.0)), 0), ("A", 4_000_000, 5, lv((100.0, 10.0)), lv((102.0, 10.0)), 1),
    ]
    df = spark.createDataFrame(rows, SNAP)
    trades = spark.createDataFrame([("A", 1_000_000, 0, 101.0, 10.0), ("A", 2_000_000, 9, 101.0, 0.0)], "symbol string, ts_us long, seq long, price double, qty double")
    r = features.extracted(df, trades).orderBy("seq").collect()
    assert [x.ofi_1 for x in r] == [None, 10.0, -10.0, 15.0, None, None]
    assert r[1].level_drain == -10.0 and r[3].level_drain is None and r[3].microprice_dev == pytest.approx(0.5) and r[3].queue_imb == 0.75
    assert r[5].queue_imb == 0.5 and r[0].depth_imb == pytest.approx(5 / 15) and r[0].spread == 2.0 and r[0].relative_spread == pytest.approx(2 / 101)
    assert [x.trade_intensity for x in r[:2]] == [1.0, 1.5] and r[2].trade_intensity == pytest.approx(1 + 0.5 * math.exp(-1)) and r[5].trade_intensity == pytest.approx(1 + 0.5 * math.exp(-3) + 0.5 * math.exp(-2))
    assert r[0].price_impact is None and r[1].price_impact == 0.0 and r[5].price_impact is None and r[4].mid is None
    with pytest.raises(ValueError):
        features.extracted(df, trades, alpha=2.0)


def test_ofi_telescopes(spark):
    rng = random.Random(5)
    rows = [("A", i, i, [{"price": 100.0 - k, "qty": float(rng.randrange(1, 9))} for k in range(7)], [{"price": 101.0 + k, "qty": float(rng.randrange(1, 9))} for k in range(7)], 0) for i in range(40)]
    r = features.extracted(spark.createDataFrame(rows, SNAP)).orderBy("seq").collect()
    net = lambda row, n: sum(x["qty"] for x in row[3][:n]) - sum(x["qty"] for x in row[4][:n])
    for n in (1, 5, 10):
        assert sum(x[f"ofi_{n}"] for x in r[1:]) == pytest.approx(net(rows[-1], n) - net(rows[0], n))


def test_labels(spark):
    df = spark.createDataFrame([("A", 0, 0, 100.0, 0.1), ("A", 300_001_000, 1, 102.0, 0.1), ("A", 300_001_000, 2, 50.0, 0.1), ("A", 301_001_000, 3, 0.0, 0.1)], "symbol string, ts_us long, seq long, mid double, spread double")
    r = labelled(df).orderBy("seq").collect()
    assert r[0].r_300s == pytest.approx(0.02) and r[0].r_1s == pytest.approx(0.02) and r[0].sign_1s == 1
    assert r[1].r_1s == -1.0 and r[1].r_5s is None and r[1].sign_5s is None and r[3].r_1s is None


def test_asof_against_a_loop(spark):
    rng = random.Random(8)
    rows = [(rng.choice("AB"), rng.randrange(60), i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(150)]
    got = forward_asof(spark.createDataFrame(rows, "symbol string, ts_us long, seq long, x double"), {"x": F.col("x")}, {"a": 5, "b": 0})
    for r in got.collect():
        for h, us in (("a", 5), ("b", 0)):
            later = sorted((t, q, x) for s, t, q, x in rows if s == r.symbol and t >= r.ts_us + us)
            assert r[f"x_{h}"] == (later[0][2] if later else None)


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_segments_give_the_same_books(spark, parts):
    """All kinds of events, refused ones, gaps and cut connections; several rows of a time, an instrument with a single time."""
    rng, rows, conn = random.Random(5), [], 1
    lv = lambda lo: [{"price": lo + rng.randrange(8), "qty": float(rng.choice([0, 1, 2]))} for _ in range(3)]
    for i in range(900):
        conn += rng.random() < 0.02
        kind = rng.choices(["delta", "snapshot", "gap", "trade", "disconnected"], [90, 2, 2, 4, 1])[0]
        side = rng.choice(["bid", "ask"])
        book_levels = (lv(90.0), lv(100.0)) if kind == "snapshot" else (None, None)
        price = rng.choice([math.nan, None]) if rng.random() < 0.02 else (90.0 if side == "bid" else 100.0) + rng.randrange(9)
        rows.append((rng.choice("AAAAB"), i // 4, (i, rng.randrange(3)), kind, side, price, rng.choice([-1.0, 0.0, 0.0, 1.0, 2.0, 5.0, None]), *book_levels, conn))
    rows += [("C", 5, (i, 0), "delta", "bid", 50.0 + i, 1.0, None, None, 1) for i in range(5)]
    level = "array<struct<price:double,qty:double>>"
    df = spark.createDataFrame(rows, f"symbol string, ts_us long, seq struct<line:long,pos:int>, kind string, side string, price double, qty double, bids {level}, asks {level}, conn int").repartition(3)
    key = lambda r: (r.symbol, r.ts_us, r.seq)
    want = sorted(book.reconstructed(df).collect(), key=key)
    assert sorted(book.reconstructed(df, parts=parts).collect(), key=key) == want and len(want) == 905 and want[0].gap_id == 0 and max(r.gap_id for r in want) > 20

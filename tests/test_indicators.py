"""Indicators against plain loops over lists."""

import math
import random
import statistics as st

import numpy as np
import pytest

from lobspark.app import indicators
from lobspark.functions import registry
from lobspark.functions.indicators import FOLDED, NAMES
from lobspark.operators import folds

N = 260


def series():
    rng = random.Random(11)
    p, rows = 100.0, []
    for i in range(N):
        p = max(1.0, p + rng.choice([-0.5, 0.0, 0.25, 0.5]) + 0.3 * math.sin(i / 7))
        sp = rng.choice([0.1, 0.2, 0.4])
        rows.append({"p": p, "h": p + sp / 2, "l": p - sp / 2, "o": rows[-1]["p"] if rows else p, "v": float(rng.randrange(1, 9)), "sp": sp, "ofi": float(rng.randrange(-4, 5))})
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = [("A", i * 1000, i, *r.values()) for i, r in enumerate(series())] + [("B", i, i, 5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "symbol string, ts_us long, seq long, p double, h double, l double, o double, v double, sp double, ofi double").repartition(3)
    out = indicators(df).orderBy("symbol", "seq").collect()
    return [r for r in out if r.symbol == "A"], [r for r in out if r.symbol == "B"]


def expected():
    r = series()
    p, h, l, v, sp, ofi, o = ([x[k] for x in r] for k in ("p", "h", "l", "v", "sp", "ofi", "o"))  # noqa: E741
    tp = [(a + b + c) / 3 for a, b, c in zip(h, l, p, strict=True)]
    tr = [h[i] - l[i] if i == 0 else max(h[i] - l[i], abs(h[i] - p[i - 1]), abs(l[i] - p[i - 1])) for i in range(N)]
    win = lambda x, i, n: x[i + 1 - n : i + 1]
    wma = lambda x: sum((k + 1) * y for k, y in enumerate(x)) / (len(x) * (len(x) + 1) / 2)
    at = {}

    def put(name, first, f):
        at[name] = [f(i) if i >= first else None for i in range(N)]

    def ema(x, n, first=0):
        out, y = [None] * N, None
        for i in range(first + n - 1, N):
            y = sum(x[first : first + n]) / n if y is None else x[i] * 2 / (n + 1) + y * (1 - 2 / (n + 1))
            out[i] = y
        return out

    put("sma_20", 19, lambda i: st.mean(win(p, i, 20)))
    put("wma_14", 13, lambda i: wma(win(p, i, 14)))
    put("hma_14", 16, lambda i: wma([2 * wma(win(p, j, 7)) - wma(win(p, j, 14)) for j in range(i - 3, i + 1)]))
    at["ema_12"], at["ema_26"] = ema(p, 12), ema(p, 26)
    line = [None if b is None else a - b for a, b in zip(at["ema_12"], at["ema_26"], strict=True)]
    at["macd_line"], at["macd_signal"] = line, ema(line, 9, 25)
    put("aroon_up_25", 25, lambda i: 100 * max(range(26), key=lambda k: (win(h, i, 26)[k], k)) / 25)
    put("aroon_down_25", 25, lambda i: 100 * min(range(26), key=lambda k: (win(l, i, 26)[k], k)) / 25)
    put("choppiness_14", 14, lambda i: 100 * math.log10(sum(win(tr, i, 14)) / (max(win(h, i, 14)) - min(win(l, i, 14)))) / math.log10(14))
    put("stoch_k_14", 13, lambda i: 100 * (p[i] - min(win(l, i, 14))) / (max(win(h, i, 14)) - min(win(l, i, 14))))
    put("stoch_d_14", 15, lambda i: st.mean(at["stoch_k_14"][i - 2 : i + 1]))
    put("cci_20", 19, lambda i: (tp[i] - st.mean(win(tp, i, 20))) / (0.015 * st.mean(abs(x - st.mean(win(tp, i, 20))) for x in win(tp, i, 20))))
    put("bb_width_20", 19, lambda i: 4 * st.pstdev(win(p, i, 20)) / st.mean(win(p, i, 20)))
    put("zscore_50", 49, lambda i: (p[i] - st.mean(win(p, i, 50))) / st.pstdev(win(p, i, 50)))
    lr = [math.log(b / a) for a, b in zip(p, p[1:], strict=False)]
    put("realized_vol_20", 20, lambda i: st.pstdev(lr[i - 20 : i]))
    put("parkinson_vol_14", 13, lambda i: math.sqrt(st.mean(math.log(a / b) ** 2 for a, b in zip(win(h, i, 14), win(l, i, 14), strict=True)) / (4 * math.log(2))))
    put("garman_klass_20", 19, lambda i: math.sqrt(max(0, st.mean(0.5 * math.log(h[j] / l[j]) ** 2 - (2 * math.log(2) - 1) * math.log(p[j] / o[j]) ** 2 for j in range(i - 19, i + 1)))))
    put("obv", 0, lambda i: sum(v[j] * ((p[j] > p[j - 1]) - (p[j] < p[j - 1])) for j in range(1, i + 1)))
    put("vwap_dev", 0, lambda i: (p[i] - sum(a * b for a, b in zip(tp[: i + 1], v, strict=False)) / sum(v[: i + 1])) / p[i])
    put("amihud_20", 20, lambda i: st.mean((abs(lr[j - 1]) if j else 0) / v[j] for j in range(i - 20, i)))
    ret = [0.0] + [b - a for a, b in zip(p, p[1:], strict=False)]

    def cov(x, y):
        mx, my = st.mean(x), st.mean(y)
        return st.mean((a - mx) * (b - my) for a, b in zip(x, y, strict=True))

    put("roll_spread", 21, lambda i: 2 * math.sqrt(max(0, -cov(ret[i - 20 : i], ret[i - 21 : i - 1]))))
    put("kyle_lambda_20", 20, lambda i: abs(p[i] - p[i - 20]) / sum(abs(x) for x in ofi[i - 20 : i]))
    put("info_efficiency_20", 20, lambda i: abs(p[i] - p[i - 20]) / sum(abs(ret[j]) for j in range(i - 19, i)))
    put("autocorr_lag5", 54, lambda i: cov(p[i - 49 : i + 1], p[i - 54 : i - 4]) / (st.pstdev(p[i - 49 : i + 1]) * st.pstdev(p[i - 54 : i - 4])))
    put("variance_ratio_16", 115, lambda i: st.pvariance([math.log(p[j] / p[j - 16]) for j in range(i - 84, i + 1)]) / (16 * st.pvariance(lr[i - 100 : i])))
    put("book_pressure", 19, lambda i: ofi[i] / max(abs(x) for x in win(ofi, i, 20)))
    put("dpo_20", 30, lambda i: p[i] - st.mean(win(p, i - 11, 20)))
    put("mfi_14", 14, lambda i: 100 * sum(tp[j] * v[j] for j in range(i - 13, i + 1) if tp[j] >= tp[j - 1]) / sum(tp[j] * v[j] for j in range(i - 13, i + 1)))
    put("pivot_dist", 1, lambda i: (p[i] - (h[i - 1] + l[i - 1] + p[i - 1]) / 3) / p[i])
    return at


def test_against_loops(found):
    rows, _ = found
    for name, want in expected().items():
        for i, (r, w) in enumerate(zip(rows, want, strict=True)):
            assert (r[name] is None) == (w is None), (name, i)
            assert w is None or r[name] == pytest.approx(w, rel=1e-7, abs=1e-9), (name, i)


def test_all_87_are_there_and_bounded(found):
    rows, flat = found
    assert len(NAMES) == len(set(NAMES)) == 87 and len(rows) == N and len(flat) == 10
    for name in NAMES:
        assert any(r[name] is not None for r in rows), name
        assert all(r[name] is None or math.isfinite(r[name]) for r in rows + flat), name
    for r in rows:
        for n in ("rsi_14", "adx_14", "aroon_up_25", "stoch_k_14", "mfi_14"):
            assert r[n] is None or -1e-9 <= r[n] <= 100 + 1e-9
        assert r.supertrend_14 in (None, 1.0, -1.0) and (r.kama_10 is None or 0 < r.kama_10 < 1000)
        # The pivot of a symmetric bar is its close, so the distance is one row's return.
    assert all(abs(b.pivot_dist - (y["p"] - x["p"]) / y["p"]) < 1e-12 for x, y, b in zip(series(), series()[1:], rows[1:], strict=False))


def test_rsi_without_losses(spark):
    df = spark.createDataFrame([("A", i, i, 1.0 + i, 1.0 + i, 1.0 + i, 1.0 + i, 1.0, 0.0, 0.0) for i in range(20)], "symbol string, ts_us long, seq long, p double, h double, l double, o double, v double, sp double, ofi double")
    assert indicators(df).orderBy("seq").collect()[-1].rsi_14 == pytest.approx(100 - 100 / 101)


def test_blocks_of_a_long_instrument(spark):
    """Folds in blocks of time equal those over the whole, row by row; missing inputs leave the state alone."""
    rng, rows, p = random.Random(4), [], 100.0
    for i in range(30_000):
        p = max(50.0, p + rng.gauss(0, 0.1))
        rows.append(("LONG" if i % 30 else "short", i // 2, i, None if i % 997 == 5 else p, p + rng.random(), p - rng.random(), rng.random() * 9 + 1))
    df = spark.createDataFrame(rows, "symbol string, ts_us long, seq long, p double, h double, l double, v double").repartition(3).cache()
    key = lambda r: (r.symbol, r.seq)
    whole = sorted(folds.folded(df, FOLDED).collect(), key=key)
    cut = sorted(folds.folded(df, FOLDED, rows=9_000).collect(), key=key)
    assert len(whole) == len(cut) == 30_000
    for name in FOLDED:
        a, b = (np.array([r[name] if r[name] is not None else np.nan for r in x]) for x in (whole, cut))
        assert (np.isnan(a) == np.isnan(b)).all(), name
        assert np.nanmax(np.abs(a - b) / (1 + np.abs(a))) < 1e-9, name
    df.unpersist()


def test_sql_users(spark, found):
    rows, _ = found
    df = spark.createDataFrame([("A", i, i, *[r[c] for c in ("p", "h", "l", "o", "v", "sp", "ofi")]) for i, r in enumerate(series())], "symbol string, ts_us long, seq long, p double, h double, l double, o double, v double, sp double, ofi double")
    df.repartition(3).createOrReplaceTempView("some_bars")
    registry.register(spark, "some_bars")
    got = spark.sql("select * from indicator(table(some_bars) partition by symbol order by (ts_us, seq), 'kama_10, adx_14, hurst_100')").orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("A", i, i, r.kama_10, r.adx_14, r.hurst_100) for i, r in enumerate(sorted(rows, key=lambda r: r.seq))]
    for name in ("zscore_20", "ema_20"):
        assert [r[name] for r in spark.sql(f"select * from ind_{name}").orderBy("seq").collect()] == [r[name] for r in sorted(rows, key=lambda r: r.seq)]
    for text, error in (("nothing", "no such indicator"), ("sma_10", "views")):
        with pytest.raises(Exception, match=error):
            spark.sql(f"select * from indicator(table(some_bars) partition by symbol order by (ts_us, seq), '{text}')").collect()
    with pytest.raises(Exception, match="bars have no"):
        spark.sql("select * from indicator(table(select 1 as p), 'ema_5')").collect()


def test_frames_in_blocks(spark):
    """a long instrument's frames and running sums are the same from blocks with the rows before them, and no window has an instrument's rows."""
    from lobspark import app, catalog
    from lobspark.functions.indicators import FRAME, framed_sql

    bars = catalog.bars(spark, "/root/testdata/sf0.01").where("symbol in ('view', 'click') or seq % 50 = 0")
    keys, names = ["symbol", "ts_us", "seq"], list(FRAME)
    cut = app.framed(bars, names, ["p"], rows=300)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert all("block" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window"))
    got, want = ({tuple(r[k] for k in keys): r for r in df.select(*keys, *names).collect()} for df in (cut, spark.sql(framed_sql("select * from {bars}"), bars=bars)))
    assert got.keys() == want.keys()
    for at, r in want.items():
        for n in names:
            a, b = got[at][n], r[n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))), (at, n, a, b)

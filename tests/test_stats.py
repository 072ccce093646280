"""Statistics against numpy, and whole runs of the app on files."""

import math

import numpy as np
import pytest

from lobspark import app
from lobspark.operators import backtest, signals, stats
from lobspark.plans import report
from lobspark.sources import files, sinks

COLS = "symbol string, ts_us long, seq long, x double, y double"


def frame(spark, x, y, symbol="A"):
    return spark.createDataFrame([(symbol, i, i, None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], COLS)


def test_ranks_and_spearman(spark):
    df = frame(spark, [1, 1, 3], [1, 2, 3])
    assert [r[0] for r in df.select(stats.average_rank("x", ["symbol"])).collect()] == [1.5, 1.5, 3.0]
    one = lambda x, y: stats.spearman(frame(spark, x, y), ["symbol"], "x", "y").collect()[0]
    assert one(range(10), range(10)).ic == pytest.approx(1.0) and one(range(10), range(9, -1, -1)).ic == pytest.approx(-1.0)
    r = one([0, math.nan, 2, 3], [0, 1, 2, math.inf])
    assert r.n == 2 and r.ic == pytest.approx(1.0) and one([1, 1, 1], [1, 2, 3]).ic is None


def test_rolling_ic(spark):
    r = stats.rolling_ic(frame(spark, range(100), range(100)), ["symbol"], ["ts_us", "seq"], "x", "y", 30, 10).orderBy("window_idx").collect()
    assert [x.center for x in r] == [15 + 10 * i for i in range(8)] and all(x.ic == pytest.approx(1.0) for x in r)


def test_least_squares_and_errors(spark):
    r = stats.ols(frame(spark, range(10), [2 * i + 1 for i in range(10)]), ["symbol"], "y", ["x"]).collect()[0]
    assert r.beta == pytest.approx([1, 2]) and r.ss_res == pytest.approx(0, abs=1e-8)
    assert stats.ols(frame(spark, [1] * 5, range(5)), ["symbol"], "y", ["x"]).collect()[0].beta is None
    assert stats.solved(np.zeros((2, 2)), np.ones(2)) is None


def newey_west(x, e, lag):
    """HAC standard errors, term by term."""
    n, k = x.shape
    if n <= k + lag:
        return None
    z, inv = x * e[:, None], np.linalg.inv(x.T @ x)
    s = z.T @ z
    for i in range(1, lag + 1):
        g = z[i:].T @ z[: n - i]
        s += (1 - i / (lag + 1)) * (g + g.T)
    return np.sqrt(np.diag(inv @ s @ inv))


def adf(y, lags):
    d = np.diff(y)
    n = len(d) - lags
    if n < lags + 4:
        return None
    x = np.column_stack([np.ones(n), y[lags:-1], *[d[lags - j : len(d) - j] for j in range(1, lags + 1)]])
    beta = np.linalg.solve(x.T @ x, x.T @ d[lags:])
    se = newey_west(x, d[lags:] - x @ beta, max(lags, 1))
    return None if se is None else beta[1] / se[1]


def series(n, seed, symbol):
    rng = np.random.default_rng(seed)
    x = np.convolve(rng.normal(size=n + 4), [0.5, 0.3, 0.2, 0.1, 0.1], "valid")
    y = 0.2 * x + np.convolve(rng.normal(size=n + 20), np.ones(21) / 9, "valid")
    gone = rng.random((2, n)) < 0.02
    t = np.sort(rng.integers(0, 3 * n, n))  # several rows of a time
    return [(symbol, int(t[i]), i, None if gone[0, i] else float(round(x[i], 2)), float("nan") if gone[1, i] else float(y[i])) for i in range(n)]


SERIES = {"long": series(20_000, 1, "long"), "short": series(400, 2, "short"), "tiny": series(9, 3, "tiny"), "flat": [("flat", i, i, 1.0, float(i % 7)) for i in range(300)]}


@pytest.mark.parametrize("parts", [1, 64])
def test_series_in_blocks(spark, parts):
    """HAC errors, windows and Dickey-Fuller as on whole series, with one segment and with 64."""
    df = spark.createDataFrame([r for rows in SERIES.values() for r in rows], COLS)
    got = {r.symbol: r for r in stats.series_facts(df, ["symbol"], ["ts_us", "seq"], ["x"], {"y": 3000}, 252, 63, parts).collect()}
    near = {r.symbol: r for r in stats.series_facts(df, ["symbol"], ["ts_us", "seq"], ["x"], {"y": 10}, 252, 63, parts).collect()}
    walk = {r.symbol: r.t for r in stats.dickey_fuller(df, ["symbol"], ["ts_us", "seq"], ["x"], 5, parts, 1000).collect()}
    assert got.keys() == near.keys() == walk.keys() == SERIES.keys()
    for name, rows in SERIES.items():
        pairs = np.array([(x, y) for *_, x, y in rows if x is not None and not math.isnan(y)])
        x, y = np.column_stack([np.ones(len(pairs)), pairs[:, 0]]), pairs[:, 1]
        ics = [stats.rank_correlation(pairs[a : a + 252, 0], pairs[a : a + 252, 1]) for a in range(0, len(pairs) - 251, 63)]
        ics = [v for v in ics if v is not None]
        assert near[name].n == len(pairs)
        assert near[name].icir == (pytest.approx(np.mean(ics) / np.std(ics, ddof=1)) if len(ics) > 1 else None)
        if name == "flat":
            assert near[name].beta is None and near[name].nw_t is None and walk[name] is None
            continue
        beta = np.linalg.solve(x.T @ x, x.T @ y)
        assert near[name].beta == pytest.approx(beta[1])
        for r, lag in ((near, 10), (got, 3000)):
            se = newey_west(x, y - x @ beta, lag)
            assert r[name].nw_t == (None if se is None else pytest.approx(beta[1] / se[1], rel=1e-6)), (name, lag)
        t = adf(np.array([v for *_, v, _ in rows if v is not None]), 5)
        assert walk[name] == (None if t is None else pytest.approx(t, rel=1e-6)), name


def test_time_series(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    assert adf(noise, 5) < -5 and adf(np.cumsum(noise), 5) > -3.5
    r = stats.ljung_box(frame(spark, noise, noise), ["symbol"], ["ts_us", "seq"], "x").collect()[0]
    c = noise - noise.mean()
    want = 400 * 402 * sum((c[k:] @ c[: 400 - k] / (c @ c)) ** 2 / (400 - k) for k in range(1, 21))
    assert r.q == pytest.approx(want)


def test_decay(spark):
    points = [("A", t, 0.3 * math.exp(-t / 20) + 0.05) for t in (1.0, 5.0, 30.0, 300.0)] + [("B", 1.0, 0.1), ("B", 5.0, None), ("C", 1.0, 0.1), ("C", 5.0, 0.1), ("C", 30.0, 0.1)]
    r = stats.ic_decay(spark.createDataFrame(points, "symbol string, tau double, ic double"), ["symbol"]).collect()
    assert len(r) == 1 and r[0].tau_star == 20.0 and r[0].r2 == pytest.approx(1.0) and r[0].a == pytest.approx(0.3)


def test_vif_and_regimes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = x + rng.normal(size=200)
    got = {r.feature: r.vif for r in stats.vif(frame(spark, x, y), ["symbol"], ["x", "y"]).collect()}
    assert got["x"] == pytest.approx(1 / (1 - np.corrcoef(x, y)[0, 1] ** 2))
    df = spark.createDataFrame([("A", i, i, float(i), float(i), float(i if i < 2 else -i)) for i in range(11)], "symbol string, ts_us long, seq long, g double, x double, y double")
    r = stats.regime_ic(df, ["symbol"], "g", "x", "y").orderBy("quartile").collect()
    assert [q.n for q in r] == [2, 2, 2, 5] and r[0].ic == pytest.approx(1) and r[3].ic == pytest.approx(-1)


def toy(spark, n=22_000):
    step = 86_400_000
    rows = []
    for i in range(n):
        ofi = 1.0 if i % 3 == 0 else -0.5
        rows.append(("TOY", i * step, i, ofi, 0.1 * ofi, 0.01 * ofi, 0.5, 1.0 + i % 5, 0.0002, ofi * 1e-4 + 1e-5 * ((i % 7) - 3)))
    return spark.createDataFrame(rows, "symbol string, ts_us long, seq long, ofi_1 double, depth_imb double, microprice_dev double, queue_imb double, trade_intensity double, spread double, r_300s double")


def test_backtest_toy(spark):
    df = toy(spark).cache()
    c = backtest.Config(features=("ofi_1", "trade_intensity"))
    r = backtest.backtested(df, c).orderBy("window_idx", "k").collect()
    span, windows = 21_999 * 86_400_000, 0
    while (windows * 7 + 21) * 86_400_000_000 <= span:
        windows += 1
    assert len(r) == 3 * windows and windows >= 1
    assert all(math.isfinite(x.oos_ic) and x.max_drawdown >= 0 and 0 <= x.turnover <= 1 for x in r)
    s = backtest.summarised(backtest.backtested(df, c)).collect()
    assert {x.n_windows for x in s} == {windows} and len(s) == 3
    df.unpersist()


def test_positions(spark):
    r = spark.createDataFrame([(2.0,), (-2.0,), (0.5,)], "s double").select(backtest.position(app.F.col("s"), app.F.lit(1.5), app.F.lit(1.0))).collect()
    assert [x[0] for x in r] == [1, -1, 0]
    rows = spark.createDataFrame([("A", i, i, x, 0.1) for i, x in enumerate([None, 1.0, 1.0, 3.0, None, 3.0])] + [("B", 0, 0, 5.0, 0.2)], "symbol string, ts_us long, seq long, s double, dt double")
    a = 1 - math.exp(-0.1)
    want = [None, 1.0, 1.0, 1 + 2 * a, None, 3 - 2 * (1 - a) ** 2, 5.0]
    for dt in (0.1, "dt"):
        assert [r.filtered for r in signals.decayed(rows, ["symbol"], "s", 1.0, dt).orderBy("symbol", "seq").collect()] == [v if v is None else pytest.approx(v) for v in want]


def slow_windows(rows, c):
    """Test rows of each window with the fit of its training rows, one window after the other."""
    rows = sorted(rows, key=lambda r: (r["ts_us"], r["seq"]))
    t0, t1, day = rows[0]["ts_us"], rows[-1]["ts_us"], 86_400_000_000
    train, test, out, w = int(c.train_days * day), int(c.test_days * day), {}, 0
    skip = max(1, round(c.resample_s / ((t1 - t0) / 1e6 / (len(rows) - 1))))
    while w * test + train + test <= t1 - t0:
        off = [(r, r["ts_us"] - t0 - w * test) for r in rows]
        fit, rest = [r for r, o in off if 0 <= o < train][::skip], [r for r, o in off if train <= o < train + test][::skip]
        if len(fit) >= c.least_train and len(rest) >= c.least_test:
            whole = [r for r in fit if all(r[n] is not None for n in (*c.features, c.target))]
            x, y = np.array([[1.0, *(r[f] for f in c.features)] for r in whole]), np.array([r[c.target] for r in whole])
            out[w] = ([r["seq"] for r in rest], len(fit), np.linalg.lstsq(x, y, rcond=None)[0][1:])
        w += 1
    return out


@pytest.mark.parametrize("train,test,resample", [(14, 7, 300), (10, 4, 3 * 3600), (3, 6, 7200)])
def test_windows_from_slot_sums(spark, train, test, resample):
    rng = np.random.default_rng(7)
    t = np.sort(rng.integers(0, 60 * 86_400_000_000, 2500))
    rows = [{"symbol": "A", "ts_us": int(v), "seq": i, "ofi_1": float(rng.normal()), "depth_imb": None if rng.random() < 0.03 else float(rng.normal()), "spread": 0.01, "r_300s": float(rng.normal())} for i, v in enumerate(t)]
    c = backtest.Config(train_days=train, test_days=test, resample_s=resample, features=("ofi_1", "depth_imb"))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "symbol string, ts_us long, seq long, ofi_1 double, depth_imb double, spread double, r_300s double")
    got = {}
    for r in backtest.windows(df, c).orderBy("window_idx", "ts_us", "seq").collect():
        seqs, n, beta = got.setdefault(r.window_idx, ([], r.train_rows, r.beta))
        seqs.append(r.seq)
    want = slow_windows(rows, c)
    assert got.keys() == want.keys() and len(want) > 5
    for w, (seqs, n, beta) in want.items():
        assert got[w][0] == seqs and got[w][1] == n and got[w][2] == pytest.approx(beta, rel=1e-6, abs=1e-9)


def feature_rows(n=250):
    rows = []
    for i in range(n):
        r = 0.0001 * math.sin(0.3 * i)
        rows.append((1000 * i, *[0.1 * k + 0.01 * ((i * k) % 7) for k in range(1, 12)], r, r, r, None if i > 200 else r, 1, 0, "ex", "S/Y", "file", i == 5, False))
    return rows


def test_files_round_trip_and_analysis(spark, tmp_path):
    from pyspark.sql import types as T

    kinds = {**dict.fromkeys(files.DOUBLES, "double"), "ts": "long", "sign_1s": "byte", "sign_5s": "byte", "exchange": "string", "symbol": "string", "data_source": "string", "is_imputed": "boolean", "gap_flag": "boolean"}
    df = spark.createDataFrame(feature_rows(), T._parse_datatype_string(", ".join(f"{c} {kinds[c]}" for c in files.COLUMNS))).withColumnRenamed("ts", "ts_us")
    for wide in (True, False):
        text = sinks.labelled_rows(df, wide)
        assert len(text.columns) == (23 if wide else 22)
        out = tmp_path / str(wide)
        out.mkdir()
        body = [",".join("" if v is None else v for v in r) for r in text.collect()]
        (out / "ex_sy_features.csv").write_text("\n".join([",".join(text.columns), *body, "x,,,"]) + "\n")
        got = files.feature_files(spark, str(out))
        rows = {r.ts_us: r for r in got.collect()}
        assert len(rows) == 249 and 5000 not in rows and rows[249_000].r_300s is None and rows[1000].ofi_1 == pytest.approx(0.11)
        assert rows[1000].data_source == ("file" if wide else None)
        assert got.select(files.file_symbol()).first()[0] == "SY" and got.select(files.relative_symbol(str(out))).first()[0] == "ex_sy"
    assert files.thinned(got, 100).count() == 125 and files.thinned(got, 249).count() == 249
    f = app.read_features(spark, str(tmp_path / "True"))
    ic = app.techanalysis(f).cache()
    assert ic.select("indicator").distinct().count() > 60 and ic.where("abs(ic) > 1.0000001").count() == 0
    sinks.write_ic(ic, str(tmp_path / "ic"))
    assert app.ic_summary(ic).count() == ic.select("indicator").distinct().count()
    ic.unpersist()
    text = "\n".join(report.text(app.analyze(f)))
    assert all(f"{i}. " in text for i in (1, 2, 8))
    sinks.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("symbol = 'S_Y' and date = '1970-01-01'").count() == 250


def test_replay_to_features(spark, tmp_path):
    (tmp_path / "ticks.csv").write_text("".join(f"2024-01-01 00:00:{i:02d}.000,{1.1 + i * 1e-4},{1.0999 + i * 1e-4},2,3\n" for i in range(40)))
    out = str(tmp_path / "out")
    app.ingest(spark, "dukascopy", str(tmp_path / "ticks.csv"), out, "EURUSD", "l1_replace")
    r = spark.read.parquet(out).orderBy("ts_us", "seq").collect()
    assert len(r) == 79 and r[0].r_1s is not None and r[-1].r_1s is None and r[10].spread == pytest.approx(1e-4, abs=1.1e-4)


def test_large_keys_are_ranked_in_parts(spark):
    import random

    from lobspark.operators import stats

    rng = random.Random(2)
    rows = [(f"s{i % 2}", rng.choice([None, float("nan"), rng.gauss(0, 1), float(rng.randrange(3))]), float(rng.randrange(9)), rng.choice([None, rng.random()])) for i in range(3000)]
    rows += [("s2", 1.0, float(i), 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, a double, r1 double, r2 double")
    large = stats.large_keys(df, ["symbol"], 100)
    assert sorted(r.symbol for r in large.collect()) == ["s0", "s1"] and stats.large_keys(df, ["symbol"]) is None
    key = lambda r: (r.symbol, r.indicator, r.horizon)
    want = sorted(stats.ic_table(df, ["symbol"], ["a", "r2"], ["r1", "r2"]).collect(), key=key)
    got = sorted(stats.ic_table(df, ["symbol"], ["a", "r2"], ["r1", "r2"], large=large).collect(), key=key)
    assert [(*key(r), r.n) for r in got] == [(*key(r), r.n) for r in want] and len(got) == 12
    assert all((a.ic is None) == (b.ic is None) and (a.ic is None or abs(a.ic - b.ic) < 1e-9) for a, b in zip(got, want, strict=True))


def test_ranks_of_chunks(spark, monkeypatch):
    """Ranks of columns that are cut into chunks, with ties and nulls on either side, are those of whole columns; no task has a key's rows."""
    import random

    from lobspark.operators import stats

    rng = random.Random(3)
    value = lambda: rng.choice([None, float("nan"), float("-inf"), -0.0, 0.0, rng.gauss(0, 1), rng.gauss(0, 1) * 1e12, float(rng.randrange(4))])
    rows = [(rng.choice(["s0", "s1", None]), value(), value() if i > 900 else None, 2.0, value(), None if i % 7 == 0 else float(rng.randrange(30))) for i in range(3000)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double, r1 double, r2 double").repartition(3)
    monkeypatch.setattr(stats, "CHUNK", 100)
    key = lambda r: (r.symbol or "", r.indicator, r.horizon)
    for digits in (9, None):
        found = stats.ic_table(df, ["symbol"], ["a", "b", "c"], ["r1", "r2"], digits=digits)
        assert not any(name in found._jdf.queryExecution().optimizedPlan().toString() for name in ("Generate", "Expand"))  # no row a value
        got = {key(r): (r.n, r.ic) for r in found.collect()}
        assert len(got) == 18
        for x in ("a", "b", "c"):
            for y in ("r1", "r2"):
                for r in stats.spearman(df, ["symbol"], x, y, 10, digits).collect():
                    n, ic = got[r.symbol or "", x, y]
                    assert n == r.n and (ic is None) == (r.ic is None) == (x == "c") and (ic is None or abs(ic - r.ic) < 1e-9)


def slow_signals(rows, c):
    """Each window's signal, row by row, from frames taken one at a time; None where there is none."""
    out, last = {}, {}
    for r in rows:
        x, size = [r[f] for f in c.features], max(10, min(300, int(1800 // r["bar_s"])))
        seen, y = last.setdefault(r["window_idx"], ([], None))
        out[r["window_idx"], r["seq"]] = None
        if any(v is None for v in x):
            continue
        seen.append(x)
        if len(seen) < size:
            continue
        f = np.array(seen[-size:])
        total = sum(map(abs, r["beta"] or []))
        w = [b / total for b in r["beta"]] if total >= 1e-12 else [1 / len(x)] * len(x)
        raw = sum(w[i] * (0 if len(set(f[:, i])) == 1 else (x[i] - f[:, i].mean()) / f[:, i].std()) for i in range(len(x)))
        y = raw if y is None else y + (1 - math.exp(-r["bar_s"] / c.tau_star_s)) * (raw - y)
        last[r["window_idx"]], out[r["window_idx"], r["seq"]] = (seen, y), y
    return out


def test_signals_across_batches(spark):
    """windows of several lengths of bars, with features missing, in batches shorter and longer than a z-score's frame; a feature that spikes
    and then stands still has no deviation left. No frame of a Spark window is read again for each row."""
    rng, c, rows = np.random.default_rng(3), backtest.Config(features=("ofi_1", "depth_imb")), []
    for w, (n, bar, beta) in enumerate([(700, 6.0, [0.3, -0.1]), (9, 300.0, [1.0, 1.0]), (10, 300.0, [0.0, 0.0]), (150, 90.0, None), (400, 25.0, [-2.0, 5.0])]):
        for i in range(n):
            still = 0.1 if i > 60 else 1e9 if i == 60 else float(rng.normal())
            rows.append({"symbol": "A", "window_idx": w, "ts_us": i // 2, "seq": i, "bar_s": bar, "spread": 0.01, "max_spread": 0.05, "r_300s": 0.0, "train_rows": 20, "test_rows": n, "beta": beta, "ofi_1": None if rng.random() < 0.05 else 1e6 + float(rng.normal()), "depth_imb": still})
    kinds = "symbol string, window_idx int, ts_us long, seq long, bar_s double, spread double, max_spread double, r_300s double, train_rows long, test_rows long, beta array<double>, ofi_1 double, depth_imb double"
    df, want = spark.createDataFrame([tuple(r.values()) for r in rows], kinds), slow_signals(rows, c)
    for batch in ("37", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            sig = backtest.signals(df, c)
            got = {(r.window_idx, r.seq): r.signal for r in sig.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys() and sum(v is not None for v in want.values()) > 500
        assert all((got[k] is None) == (v is None) for k, v in want.items())
        assert [got[k] for k, v in want.items() if v is not None] == pytest.approx([v for v in want.values() if v is not None], rel=1e-6, abs=1e-7)
    assert "windowspecdefinition" not in sig._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n,w", [(10, 10), (19, 10), (20, 10), (21, 10), (1, 1), (5, 1), (599, 300), (1000, 13)])
def test_rolling_moments(n, w):
    x = np.random.default_rng(n).normal(size=(2, n)) + 1e3
    frames = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)
    mean, sd = signals.rolling_moments(x, w)
    assert mean == pytest.approx(frames.mean(axis=-1)) and sd == pytest.approx(frames.std(axis=-1), abs=1e-10)
    x[:] = 0.1
    assert not signals.rolling_moments(x, w)[1].any()

import numpy as np
import pytest

from lobspark.operators import simulate


def test_arrivals():
    rng = np.random.default_rng(1)
    t = simulate.hawkes(rng, 3.0, 0.5, 1.0, 2000.0)
    assert (np.diff(t) >= 0).all() and 0 <= t[0] and t[-1] < 2000 and abs(len(t) / 2000 - 6.0) < 0.5
    counts = np.histogram(t, np.arange(2001))[0]
    assert counts.var() > 1.5 * counts.mean()
    with pytest.raises(ValueError):
        simulate.hawkes(rng, 1.0, 1.0, 1.0, 1.0)


def test_maker_leans_against_inventory():
    m = simulate.Maker(simulate.Params())
    bid, _, ask, _ = m.quote(1.0)
    assert bid < 1.0 < ask
    m.inventory = 100.0
    assert m.quote(1.0)[0] < bid


def test_paths(spark):
    p = simulate.Params(duration_s=60.0)
    rows = simulate.feature_table(spark, 2, p).cache()
    assert rows.count() == 1200 and rows.where("mid <= 0").count() == 0 and rows.where("r_5s is not null").count() == 2 * 550
    again = simulate.feature_table(spark, 2, p)
    assert sorted(map(str, rows.select("symbol", "ts_us", "mid").collect())) == sorted(map(str, again.select("symbol", "ts_us", "mid").collect()))
    assert rows.where("ofi_1 <> 0").count() > 100

"""Queries held against their SQL on tables of many rows at one time, and with series cut into many short segments."""

import duckdb
import pytest

from lobspark import catalog
from lobspark.operators import segments
from lobspark.operators.asof import forward_asof
from lobspark.sources.events import sequenced

from .conftest import sf


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The events of sf0.001 three times, with keys shifted: each time has three rows."""
    out = tmp_path_factory.mktemp("events")
    duckdb.connect().sql(f"copy (select event_id + i.range * 1000000 as event_id, ts, user_id, event_type, value, props from '{sf()}/events.parquet', range(3) i) to '{out}/events.parquet' (format parquet)")
    return str(out)


def same_as_sql(spark, name, folder):
    """The query's rows are those of its SQL."""
    df = catalog.QUERIES[name](spark, folder)
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{folder}/events.parquet'")
    want = db.sql(catalog.ORACLE_SQL[name])
    text = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert text(df.select(*want.columns).collect()) == text(want.fetchall())


@pytest.mark.parametrize("name", ["snapshots_and_gaps", "features"])
def test_rows_of_one_time(spark, repeated, name):
    same_as_sql(spark, name, repeated)


@pytest.mark.parametrize("name", ["snapshots_and_gaps", "features"])
def test_nothing_lost_at_once_has_the_bits_of_the_sql(spark, repeated, name):
    """a processor's 0 / 0 has a sign bit, with which texts and hashes of the bits tell it from another NaN."""
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{repeated}/events.parquet'")
    drained = lambda rows: rows["level_drain"].astype("float64").to_numpy().view("int64").tolist()
    order = ["symbol", "ts_us", "seq"]
    want = drained(db.sql(f"select * from ({catalog.ORACLE_SQL[name]}) where level_drain is not null").df().sort_values(order))
    assert drained(catalog.QUERIES[name](spark, repeated).where("level_drain is not null").toPandas().sort_values(order)) == want


@pytest.fixture
def short(monkeypatch):
    """Series of more than 40 rows are cut into segments."""
    monkeypatch.setattr(segments, "LEAST", 40)
    monkeypatch.setattr(segments, "PARTS", 6)


def longest_run(df):
    """Windows of the plan that have the rows of whole instruments, or of the whole table, in one task."""
    lines = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" :+-").startswith("Window")]
    return [line for line in lines if not any(part in line for part in ("__seg", "block", "window_idx"))]


@pytest.mark.parametrize("name", ["labels", "labels_stretched", "sink_parquet"])
def test_long_series_in_segments(spark, short, name):
    same_as_sql(spark, name, sf())


@pytest.mark.parametrize("name", ["feed_gemini", "feed_dukascopy", "feed_binance", "feed_okx", "feed_bybit"])
def test_messages_in_blocks(spark, short, name):
    same_as_sql(spark, name, sf())


@pytest.mark.parametrize("grows", [True, False])
def test_number_before_across_segments(spark, short, grows):
    rows = [(i, i % 3 if i % 3 else None, None if i % 5 == 0 else (i * 37) % 101, grows) for i in range(400)]
    got = sequenced(spark.createDataFrame(rows, "line long, k int, until long, grows boolean").repartition(3), "k").orderBy("line").collect()
    last = {}
    for line, k, until, _ in rows:
        assert got[line].before == last.get(k)
        if until is not None:
            last[k] = max(last.get(k, 0), until) if grows else until


def test_no_task_has_all_messages(spark, short):
    assert not longest_run(catalog.QUERIES["feed_gemini"](spark, sf()))


@pytest.mark.parametrize("name", ["stat_rolling_ic", "stat_icir", "stat_ljung_box", "price_index"])
def test_statistics_in_segments(spark, short, name):
    same_as_sql(spark, name, "/root/testdata/sf0.01" if name in ("stat_rolling_ic", "stat_icir") else sf())


@pytest.mark.parametrize("name", ["stat_rolling_ic", "stat_ljung_box", "price_index", "labels"])
def test_no_task_has_an_instrument(spark, short, name):
    assert not longest_run(catalog.QUERIES[name](spark, sf()))


@pytest.mark.parametrize("parts", [1, 2, 6, 64])
def test_segment_counts_cuts(spark, parts):
    """A segment is how many cuts a time is after, with cuts of one time, times at and beside the cuts, and none; no cuts are one segment."""
    cuts = sorted((i * 37) % 50 for i in range(parts - 1))
    rows = [(t, c) for t in [None, *range(-1, 52)] for c in (cuts, None)]
    df = spark.createDataFrame(rows, "t long, __cuts array<long>")
    for r in df.select("t", "__cuts", segments.segment("t", parts).alias("seg")).collect():
        assert r.seg == sum(r.t is not None and c < r.t for c in r["__cuts"] or [])


def test_segments_are_compiled(spark):
    """the JVM leaves methods of more than 8,000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(10).selectExpr("'A' as symbol", "id as ts_us", "id as seq", "id * 1.0 as mid")
        for rows in (segments.segmented(df, ["symbol"]), forward_asof(df, {"m": df.mid}, {"1s": 1, "5s": 5})):
            found = rows._jdf.queryExecution().debug().codegenToSeq()
            assert 0 < max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

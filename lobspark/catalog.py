"""Queries by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark import app
from lobspark.functions import registry
from lobspark.functions.indicators import FOLDED, FRAME, NAMES, framed_sql
from lobspark.operators import backtest, book, features, signals, simulate, stats
from lobspark.operators.asof import HORIZONS, labelled
from lobspark.operators.folds import folded
from lobspark.operators.segments import lagged
from lobspark.plans import recorded, report, views
from lobspark.sources import depth, sinks
from lobspark.sources.shared import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "ic_flagship"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over `events` that names no view in the session."""
    return spark.sql(text.replace(" from events", " from {events}"), events=table(spark, sf_dir, "events"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, views.ticks("spark"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, views.bars("spark"))


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; -0.0 is 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


# --- Feeds ------------------------------------------------------------------------------------------

for _feed in recorded.MESSAGES:
    QUERIES[f"feed_{_feed}"] = (lambda feed: lambda spark, sf_dir: rounded(recorded.read_back(spark, ticks(spark, sf_dir), feed), 9))(_feed)
    ORACLE_SQL[f"feed_{_feed}"] = recorded.expected(_feed)


#: Updates of three ids a tick; every fiftieth is not sent, and a snapshot comes after the tenth of the next fifty, held in the middle of the seventh.
_PLACED = "select symbol, seq, ts_us, bid, ask, rn, rn % 50 as k, rn {div} 50 as part from (select *, row_number() over (partition by symbol order by seq) as rn from ({ticks}) t1) t2"


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of depth updates that wait for snapshots, are old, or follow a gap."""
    placed = spark.sql(_PLACED.format(ticks="select * from {t}", div="div"), t=ticks(spark, sf_dir))
    update = F.expr("""concat('{"e":"depthUpdate","E":', ts_us div 1000, ',"s":"', symbol, '","U":', 3 * rn, ',"u":', 3 * rn + 2, ',"b":[["', bid, '","1"]],"a":[]}')""")
    whole = F.expr("""concat('{"s":"', symbol, '","lastUpdateId":', 3 * rn - 8, ',"bids":[],"asks":[["', ask, '","1"]]}')""")
    sent = F.array(F.struct((F.col("seq") * 2).alias("line"), update.alias("value")), F.when(F.col("k") == 10, F.struct((F.col("seq") * 2 + 1).alias("line"), whole.alias("value"))))
    raw = placed.where("k <> 0").select(F.explode(F.filter(sent, lambda x: x.isNotNull())).alias("m")).select("m.*")
    return depth.outcomes(raw).select("symbol", "line", "at", "nth", "outcome")


QUERIES["depth_outcomes"] = _depth
ORACLE_SQL["depth_outcomes"] = f"""with t as ({_PLACED.format(ticks=views.ticks('duckdb'), div='//')}), s as (select upper(symbol) as symbol, part, 2 * seq + 1 as since from t where k = 10),
m as (select upper(symbol) as symbol, 2 * seq as line, k, part, k >= 2 or part = 0 as waits, case when part = 0 then k else k - 1 end as place from t where k <> 0)
select symbol, line, line as "at", 0::int as nth, case when k > 10 then 'accept' when waits then 'buffer' else 'gap' end as outcome from m
union all select symbol, since, since, 0::int, 'snapshot' from s
union all select symbol, line, s.since, place::int, case when k <= 6 then 'old' else 'accept' end from m join s using (symbol, part) where waits and k <= 10"""


# --- Indicators -----------------------------------------------------------------------------------

#: Means of 200 prices of four decimals can lie on halves of the sixth.
DIGITS = {"sma_200": 8, "ema_200": 8}


def _frame_query(name: str) -> Query:
    return lambda spark, sf_dir: rounded(sql(spark, sf_dir, framed_sql(views.bars("spark"), [name])), DIGITS.get(name, 6))


def _fold_query(name: str) -> Query:
    return lambda spark, sf_dir: rounded(folded(bars(spark, sf_dir), (name,)), DIGITS.get(name, 6))


for _name in FRAME:
    QUERIES[f"ind_{_name}"] = _frame_query(_name)
    ORACLE_SQL[f"ind_{_name}"] = f"select symbol, ts_us, seq, round({_name}, {DIGITS.get(_name, 6)}) + 0.0 as {_name} from ({framed_sql(views.bars('duckdb'), [_name])})"
for _name in FOLDED:
    QUERIES[f"ind_{_name}"] = _fold_query(_name)

_RUN = "over (partition by symbol order by ts_us, seq)"
_B = (
    f"with b0 as (select *, row_number() {_RUN} as rn, lag(p) {_RUN} as p1, lag(h) {_RUN} as h1, lag(l) {_RUN} as l1 from ({views.bars('duckdb')})), "
    "b as (select *, case when rn = 1 then h - l else greatest(h - l, abs(h - p1), abs(l - p1)) end as tr, coalesce((p - p1) * v, 0) as f, "
    "greatest(p - p1, 0) as g, greatest(p1 - p, 0) as s, case when h - h1 > l1 - l and h - h1 > 0 then h - h1 else 0 end as dp, case when l1 - l > h - h1 and l1 - l > 0 then l1 - l else 0 end as dm from b0)"
)


def _weights(x: str, first: int, n: int, k: str, keep: str, out: str, source: str = "b", seed: str = "avg") -> str:
    """A CTE (symbol, rn, out): y = keep * y' + k * x from row first + n on, seeded at row first + n - 1 with the
    mean (or sum) of the n rows from `first`; as one weighted sum, not as a recursion."""
    return (
        f"{out} as (select t.symbol, t.rn, sum(case when j.rn >= {first + n} then ({k}) * {x.replace('@', 'j.')} * pow({keep}, t.rn - j.rn) "
        f"else {x.replace('@', 'j.')} * pow({keep}, t.rn - {first + n - 1}) {f'/ {n}' if seed == 'avg' else ''} end) as {out} "
        f"from {source} t join {source} j on j.symbol = t.symbol and j.rn between {first} and t.rn where t.rn >= {first + n - 1} group by t.symbol, t.rn)"
    )


def _ema(n: int, out: str, x: str = "@p", first: int = 1, source: str = "b") -> str:
    return _weights(x, first, n, f"2.0::double / {n + 1}", f"(1 - 2.0::double / {n + 1})", out, source)


def _wilder(n: int, out: str, x: str, first: int = 1) -> str:
    return _weights(x, first, n, f"1.0::double / {n}", f"(1 - 1.0::double / {n})", out)


def _oracle(name: str, ctes: list[str], value: str, joins: list[str]) -> None:
    using = " ".join(f"left join {j} using (symbol, rn)" for j in joins)
    ORACLE_SQL[f"ind_{name}"] = f"{', '.join([_B, *ctes])} select symbol, ts_us, seq, round({value}, {DIGITS.get(name, 6)}) + 0.0 as {name} from b {using}"




def _sql_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indicators by the table function that SQL users call."""
    registry.register(spark)
    return rounded(spark.sql("select * from indicator(table({b}) partition by symbol order by (ts_us, seq), 'ema_20, rsi_14')", b=bars(spark, sf_dir)))


QUERIES["sql_indicator"] = _sql_indicators
for _n in (5, 12, 20, 26, 50, 200):
    _oracle(f"ema_{_n}", [_ema(_n, "e")], "e", ["e"])
_E2 = [_ema(20, "e"), _ema(20, "ee", "@e", 20, "e")]
_oracle("dema_20", _E2, "2 * e - ee", ["e", "ee"])
_oracle("tema_20", [*_E2, _ema(20, "eee", "@ee", 39, "ee")], "3 * e - 3 * ee + eee", ["e", "ee", "eee"])
_MACD = [_ema(12, "e12"), _ema(26, "e26"), "ln as (select symbol, rn, e12 - e26 as line from e12 join e26 using (symbol, rn))", _ema(9, "sg", "@line", 26, "ln")]
_oracle("macd_line", _MACD[:3], "line", ["ln"])
_oracle("macd_signal", _MACD, "sg", ["sg"])
_oracle("macd_hist", _MACD, "line - sg", ["ln", "sg"])
_oracle("force_index_13", [_ema(13, "e", "@f")], "e", ["e"])
for _n in (7, 14, 21):
    _oracle(f"rsi_{_n}", [_wilder(_n, "gg", "@g", 2), _wilder(_n, "ss", "@s", 2)], "case when gg is not null then 100 - 100 / (1 + case when ss > 1e-12 then gg / ss else 100 end) end", ["gg", "ss"])
ORACLE_SQL["sql_indicator"] = f"select * from ({ORACLE_SQL['ind_ema_20']}) join ({ORACLE_SQL['ind_rsi_14']}) using (symbol, ts_us, seq)"
_oracle("atr_14", [_wilder(14, "a", "@tr")], "a", ["a"])
_oracle("natr_14", [_wilder(14, "a", "@tr")], "100 * a / p", ["a"])
_KELTNER = [_wilder(20, "a", "@tr"), _ema(20, "e")]
_oracle("keltner_width_20", _KELTNER, "3 * a / e", ["a", "e"])
_oracle("squeeze_signal", [*_KELTNER, "sd as (select symbol, rn, 4 * stddev_pop(p) over w / avg(p) over w as width from b window w as (partition by symbol order by rn rows between 19 preceding and current row))"], "case when a is not null then case when width < 3 * a / e then 1.0 else 0.0 end end", ["a", "e", "sd"])
for _name, _sign in (("golden_cross", "fast > slow and f1 <= s1"), ("death_cross", "fast < slow and f1 >= s1")):
    _oracle(_name, [_ema(5, "fast"), _ema(20, "slow"), "c as (select symbol, rn, fast, slow, lag(fast) over (partition by symbol order by rn) as f1, lag(slow) over (partition by symbol order by rn) as s1 from fast join slow using (symbol, rn))"], f"case when f1 is null or s1 is null then null when {_sign} then 1.0 else 0.0 end", ["c"])
_oracle("kama_10", [
    "er as (select symbol, rn, p, abs(p - lag(p, 10) over (partition by symbol order by rn)) as way, sum(abs(p - p1)) over (partition by symbol order by rn rows between 9 preceding and current row) as path from b)",
    "co as (select symbol, rn, p, case when rn > 11 then pow(case when path > 1e-12 then way / path else 0 end * (2.0::double / 3 - 2.0::double / 31) + 2.0::double / 31, 2) end as c from er)",
    # Products of 1 - c as sums of logarithms, so that the recursion is one weighted sum.
    "lo as (select symbol, rn, p, case when rn = 11 then 1.0::double else c end as c, sum(case when rn > 11 then ln(1 - c) else 0 end) over (partition by symbol order by rn) as lg from co where rn >= 11)",
    "ka as (select t.symbol, t.rn, sum(j.c * j.p * exp(t.lg - j.lg)) as k from lo t join lo j on j.symbol = t.symbol and j.rn <= t.rn group by t.symbol, t.rn)",
], "k", ["ka"])
_DI = [_weights(f"@{x}", 2, 14, "1", "(1 - 1.0::double / 14)", y, "b", "sum") for x, y in (("tr", "wt"), ("dp", "wp"), ("dm", "wm"))]
# The first 14 rows are summed as they are.
_DI += ["di as (select symbol, rn, case when wt > 0 then 100 * wp / wt else 0 end as pdi, case when wt > 0 then 100 * wm / wt else 0 end as mdi from wt join wp using (symbol, rn) join wm using (symbol, rn))",
        "dx as (select symbol, rn, pdi, mdi, case when rn >= 28 then avg(case when pdi + mdi > 0 then 100 * abs(pdi - mdi) / (pdi + mdi) else 0 end) over (partition by symbol order by rn rows between 13 preceding and current row) end as adx from di)"]
for _name, _col in (("adx_14", "adx"), ("pdi_14", "pdi"), ("mdi_14", "mdi")):
    _oracle(_name, _DI, _col, ["dx"])
_oracle("cci_20", [
    "tp as (select symbol, rn, (h + l + p) / 3 as tp, avg((h + l + p) / 3) over (partition by symbol order by rn rows between 19 preceding and current row) as m from b)",
    "md as (select t.symbol, t.rn, any_value(t.tp) as tp, any_value(t.m) as m, avg(abs(j.tp - t.m)) as d from tp t join tp j on j.symbol = t.symbol and j.rn between t.rn - 19 and t.rn where t.rn >= 20 group by t.symbol, t.rn)",
], "case when d > 1e-12 then (tp - m) / (0.015 * d) end", ["md"])
_oracle("hurst_100", [
    "mm as (select symbol, rn, p, avg(p) over w as m, stddev_pop(p) over w as sd, sum(p) over (partition by symbol order by rn) as c from b window w as (partition by symbol order by rn rows between 99 preceding and current row))",
    # Partial sums of deviations: c_j - c_before - (j's place) * mean.
    "rs as (select t.symbol, t.rn, any_value(t.sd) as sd, max(j.c - t.c + 100 * t.m - (j.rn - t.rn + 100) * t.m) - min(j.c - t.c + 100 * t.m - (j.rn - t.rn + 100) * t.m) as r from mm t join mm j on j.symbol = t.symbol and j.rn between t.rn - 99 and t.rn where t.rn >= 100 group by t.symbol, t.rn)",
], "case when sd > 1e-12 and r > 0 then ln(r / sd) / ln(100) end", ["rs"])


_oracle("supertrend_14", [
    _wilder(14, "a", "@tr"),
    "x as (select symbol, rn, p, p1, (h + l) / 2 + 3 * a as top, (h + l) / 2 - 3 * a as bottom from b join a using (symbol, rn))",
    "bands as (select symbol, rn, p, top as u, bottom as w from x where rn = 14 union all select x.symbol, x.rn, x.p, case when x.top < bands.u or x.p1 > bands.u then x.top else bands.u end, "
    "case when x.bottom > bands.w or x.p1 < bands.w then x.bottom else bands.w end from bands join x on x.symbol = bands.symbol and x.rn = bands.rn + 1)",
    "st as (select symbol, rn, coalesce(last_value(case when p > u then 1.0 when p < w then -1.0 end ignore nulls) over (partition by symbol order by rn), 1.0)::double as trend from bands)",
], "trend", ["st"])
ORACLE_SQL["ind_supertrend_14"] = ORACLE_SQL["ind_supertrend_14"].replace("with b0", "with recursive b0", 1)


# --- Labels and information coefficients ------------------------------------------------------------

#: Rows of one instrument lie minutes apart in the test tables; horizons are stretched to match.
STRETCHED = {h: us * 1000 for h, us in HORIZONS.items()}


def _labels(spark: SparkSession, sf_dir: str, horizons: dict[str, int]) -> DataFrame:
    t = ticks(spark, sf_dir).select("symbol", "ts_us", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"))
    return labelled(t, horizons=horizons)


def _labels_sql(horizons: dict[str, int]) -> str:
    base = f"with t as (select symbol, ts_us, seq, (bid + ask) / 2 as mid, ask - bid as spread from ({views.ticks('duckdb')}))"
    joins = " ".join(f"asof left join t f{h} on f{h}.symbol = t.symbol and t.ts_us + {us} <= f{h}.ts_us" for h, us in horizons.items())
    rets = ", ".join(f"round((f{h}.mid - t.mid) / t.mid, 9) + 0.0 as r_{h}" for h in horizons)
    signs = ", ".join(f"(case when f{h}.mid is null then null when (f{h}.mid - t.mid) / t.mid > 0.5 * t.spread / t.mid then 1 when (f{h}.mid - t.mid) / t.mid < -0.5 * t.spread / t.mid then -1 else 0 end)::tinyint as sign_{h}" for h in ("1s", "5s"))
    return f"{base} select t.symbol, t.ts_us, t.seq, round(t.mid, 9) as mid, round(t.spread, 9) as spread, {rets}, {signs} from t {joins}"


QUERIES["labels"] = lambda spark, sf_dir: rounded(_labels(spark, sf_dir, HORIZONS), 9)
ORACLE_SQL["labels"] = _labels_sql(HORIZONS)
QUERIES["labels_stretched"] = lambda spark, sf_dir: rounded(_labels(spark, sf_dir, STRETCHED), 9)
ORACLE_SQL["labels_stretched"] = _labels_sql(STRETCHED)


def _ic(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Indicators against the four forward returns."""
    returns = [f"r_{h}" for h in HORIZONS]
    table = bars(spark, sf_dir).join(_labels(spark, sf_dir, STRETCHED).select("symbol", "ts_us", "seq", *returns), ["symbol", "ts_us", "seq"])
    return app.indicator_ic(table, names, returns)


def _ic_sql(names: list[str]) -> str:
    long = " union all ".join(f"select symbol, '{n}' as indicator, 'r_{h}' as horizon, round({n}, 9) as x, round(r_{h}, 9) as y from s" for n in names for h in HORIZONS)
    return (
        f"with l as ({_labels_sql(STRETCHED)}), i as ({framed_sql(views.bars('duckdb'), names)}), s as (select * from i join l using (symbol, ts_us, seq)), "
        f"long as (select * from ({long}) where x is not null and y is not null), "
        "k as (select symbol, indicator, horizon, rank() over (partition by symbol, indicator, horizon order by x) + (count(*) over (partition by symbol, indicator, horizon, x) - 1) / 2.0 as rx, "
        "rank() over (partition by symbol, indicator, horizon order by y) + (count(*) over (partition by symbol, indicator, horizon, y) - 1) / 2.0 as ry from long) "
        "select symbol, indicator, horizon, case when count(*) >= 10 and var_pop(rx) * var_pop(ry) > 0 then round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 6) + 0.0 end as ic, count(*) as n from k group by all"
    )


QUERIES["ic_flagship"] = lambda spark, sf_dir: rounded(_ic(spark, sf_dir, ["pivot_dist", "zscore_10"]))
ORACLE_SQL["ic_flagship"] = _ic_sql(["pivot_dist", "zscore_10"])


def _techanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 87 indicators at four horizons, averaged over instruments, best 5 s mean first."""
    ic = _ic(spark, sf_dir, list(NAMES))
    mean = ic.groupBy("indicator").agg(*[F.avg(F.when(F.col("horizon") == f"r_{h}", F.col("ic"))).alias(f"avg_{h}") for h in HORIZONS])
    return rounded(mean).orderBy(F.abs("avg_5s").desc_nulls_last(), "indicator")


QUERIES["techanalysis"] = _techanalysis


# --- Books and features -----------------------------------------------------------------------------

def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, views.deltas("spark"))


_TOP = [f"{s}_{w}{i}" for s in ("bid", "ask") for i in range(1, 4) for w in ("p", "q")]


def _flat(books: DataFrame) -> DataFrame:
    cols = [F.get(F.col(f"top_{s}s"), F.lit(i - 1))[f].alias(f"{s}_{w}{i}") for s in ("bid", "ask") for i in range(1, 4) for w, f in (("p", "price"), ("q", "qty"))]
    return books.select("symbol", "ts_us", "seq", *cols, F.coalesce(F.size("top_bids"), F.lit(0)).alias("n_bids"), F.coalesce(F.size("top_asks"), F.lit(0)).alias("n_asks"))


_HELD = f"""with d as (select *, row_number() over (partition by symbol order by ts_us, seq) as rn from ({views.deltas('duckdb')})),
s as (select symbol, side, price, qty, rn as a, coalesce(lead(rn) over (partition by symbol, side, price order by rn), 1e18::bigint) as z from d),
h as (select d.symbol, d.ts_us, d.seq, d.rn, s.side, s.price, s.qty, row_number() over (partition by d.symbol, d.rn, s.side order by case when s.side = 'bid' then -s.price else s.price end) as lvl
from d join s on s.symbol = d.symbol and s.a <= d.rn and d.rn < s.z where s.qty > 2.2e-16)"""
_TOPS = ", ".join(f"max(case when side = '{s}' and lvl = {i} then {f} end) as {s}_{w}{i}" for s in ("bid", "ask") for i in range(1, 4) for w, f in (("p", "price"), ("q", "qty")))
_BOOK_SQL = f"{_HELD}, t as (select symbol, rn, {_TOPS}, count(*) filter (side = 'bid' and lvl <= 10) as n_bids, count(*) filter (side = 'ask' and lvl <= 10) as n_asks from h group by symbol, rn) select d.symbol, d.ts_us, d.seq, {', '.join(f'round({c}, 6) as {c}' for c in _TOP)}, coalesce(n_bids, 0)::int as n_bids, coalesce(n_asks, 0)::int as n_asks from d left join t using (symbol, rn)"
QUERIES["book_fold"] = lambda spark, sf_dir: rounded(_flat(book.reconstructed(deltas(spark, sf_dir))))
QUERIES["book_intervals"] = lambda spark, sf_dir: rounded(_flat(book.intervals(deltas(spark, sf_dir))))
ORACLE_SQL["book_fold"] = ORACLE_SQL["book_intervals"] = _BOOK_SQL


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extracted(book.reconstructed(deltas(spark, sf_dir)), at_once=True)


QUERIES["features"] = lambda spark, sf_dir: rounded(_features(spark, sf_dir).select("symbol", "ts_us", "seq", "mid", *[n for n in features.NAMES if n not in ("trade_intensity", "price_impact")]))
ORACLE_SQL["features"] = f"""{_HELD}, t as (select symbol, rn, max(case when side = 'bid' and lvl = 1 then price end) as bp, max(case when side = 'bid' and lvl = 1 then qty end) as bq, max(case when side = 'ask' and lvl = 1 then price end) as ap,
max(case when side = 'ask' and lvl = 1 then qty end) as aq, {', '.join(f"sum(case when side = '{s}' and lvl <= {n} then qty end) as {s}{n}" for s in ('bid', 'ask') for n in (1, 5, 10))} from h group by symbol, rn),
pair as (select b.symbol, b.rn, sum((a.price - b.price) / 2 / (b.lvl * (a.qty + b.qty) / 2)) / sum(1 / (b.lvl * (a.qty + b.qty) / 2)) as slope from h b join h a on a.symbol = b.symbol and a.rn = b.rn and a.lvl = b.lvl and a.side = 'ask' and b.side = 'bid' where b.lvl <= 5 group by b.symbol, b.rn),
f as (select d.symbol, d.ts_us, d.seq, d.rn, t.* exclude (symbol, rn), case when bp is not null and ap is not null then slope end as slope from d left join t using (symbol, rn) left join pair using (symbol, rn)),
g as (select *, bid1 - ask1 as n1, bid5 - ask5 as n5, bid10 - ask10 as n10 from f)
select symbol, ts_us, seq, round((bp + ap) / 2, 6) as mid, {', '.join(f"round(n{n} - lag(n{n}) over w, 6) + 0.0 as ofi_{n}" for n in (1, 5, 10))},
round((bid5 - ask5) / (bid5 + ask5), 6) + 0.0 as depth_imb, round((aq * bp + bq * ap) / (aq + bq) - (bp + ap) / 2, 6) + 0.0 as microprice_dev, round(bq / (bq + aq), 6) as queue_imb, round(ap - bp, 6) as spread,
round((lag(bq) over w - bq) / ((ts_us - lag(ts_us) over w) * 1e-6), 6) + 0.0 as level_drain, round(slope, 6) as weighted_mid_slope from g window w as (partition by symbol order by ts_us, seq)"""


#: Ticks as events of all kinds: every seventh a gap, every fifth a snapshot of one level a side, the others changes, some of which remove.
_KINDS = """select symbol, ts_us, seq, rn, bid, bid_qty, ask, ask_qty, case when rn % 7 = 0 then 'gap' when rn % 5 = 0 then 'snapshot' else 'delta' end as kind, case when rn % 2 = 0 then 'bid' else 'ask' end as side,
case when rn % 2 = 0 then bid - rn % 3 * 0.01e0 else ask + rn % 3 * 0.01e0 end as price, case when rn % 11 = 0 then 0e0 when rn % 2 = 0 then bid_qty else ask_qty end as qty
from (select *, row_number() over (partition by symbol order by ts_us, seq) as rn from ({ticks}) t1) t2"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books and features over snapshots, which replace a book, and gaps, which features do not look across."""
    e = spark.sql(_KINDS.format(ticks="select * from {t}"), t=ticks(spark, sf_dir))
    levels = lambda s: F.when(F.col("kind") == "snapshot", F.array(F.struct(F.col(s).alias("price"), F.col(f"{s}_qty").alias("qty"))))
    b = book.reconstructed(e.withColumns({"bids": levels("bid"), "asks": levels("ask")})).where("kind in ('delta', 'snapshot') and dq_error is null")
    return rounded(features.extracted(b, at_once=True).select("symbol", "ts_us", "seq", "gap_id", "mid", "spread", "relative_spread", "ofi_1", "level_drain"))


QUERIES["snapshots_and_gaps"] = _gaps
ORACLE_SQL["snapshots_and_gaps"] = f"""with k as ({_KINDS.format(ticks=views.ticks('duckdb'))}), ev as (select *, sum((kind = 'snapshot')::int) over w as g, sum((kind = 'gap')::int) over w as gap_id from k window w as (partition by symbol order by rn)),
lv as (select symbol, g, rn, side, price, qty from ev where kind = 'delta' union all select symbol, g, rn, 'bid', bid, bid_qty from ev where kind = 'snapshot' union all select symbol, g, rn, 'ask', ask, ask_qty from ev where kind = 'snapshot'),
s as (select *, coalesce(lead(rn) over (partition by symbol, g, side, price order by rn), 1e18::bigint) as z from lv),
h as (select ev.symbol, ev.rn, s.side, s.price, s.qty from ev join s on s.symbol = ev.symbol and s.g = ev.g and s.rn <= ev.rn and ev.rn < s.z where ev.kind <> 'gap' and s.qty > 0),
t as (select symbol, rn, max(price) filter (side = 'bid') as bp, arg_max(qty, price) filter (side = 'bid') as bq, min(price) filter (side = 'ask') as ap, arg_min(qty, price) filter (side = 'ask') as aq from h group by symbol, rn),
r as (select ev.symbol, ts_us, seq, gap_id, bp, bq, ap, aq, bq - aq as net from ev left join t using (symbol, rn) where kind <> 'gap')
select symbol, ts_us, seq, gap_id::bigint as gap_id, round((bp + ap) / 2, 6) as mid, round(ap - bp, 6) + 0.0 as spread, round((ap - bp) / ((ap + bp) / 2), 6) + 0.0 as relative_spread, round(net - lag(net) over w, 6) + 0.0 as ofi_1,
round((lag(bq) over w - bq) / ((ts_us - lag(ts_us) over w) * 1e-6), 6) + 0.0 as level_drain from r window w as (partition by symbol, gap_id order by ts_us, seq)"""


def _market_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a market buy of each event's quantity times three would get from its book."""
    d = deltas(spark, sf_dir)
    b = book.reconstructed(d).join(d.select("symbol", "ts_us", "seq", (F.col("qty") * 3).alias("want")), ["symbol", "ts_us", "seq"])
    return rounded(b.select("symbol", "ts_us", "seq", book.filled("top_asks", F.col("want")).alias("x")).select("symbol", "ts_us", "seq", "x.avg_price", "x.filled"))


QUERIES["market_orders"] = _market_orders
ORACLE_SQL["market_orders"] = f"""{_HELD}, a as (select h.symbol, h.rn, h.price, h.qty, 3 * d.qty as want, coalesce(sum(h.qty) over (partition by h.symbol, h.rn order by lvl rows between unbounded preceding and 1 preceding), 0) as before
from h join d using (symbol, rn) where h.side = 'ask' and lvl <= 10), t as (select symbol, rn, sum(price * greatest(least(qty, want - before), 0)) as cost, sum(greatest(least(qty, want - before), 0)) as got from a group by symbol, rn)
select d.symbol, d.ts_us, d.seq, round(coalesce(case when got > 0 then cost / got else 0 end, 0), 6) as avg_price, round(coalesce(got, 0), 6) + 0.0 as filled from d left join t using (symbol, rn)"""


def _trade_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade intensity and price impact on quotes, with a decay slow enough for rows minutes apart."""
    t = ticks(spark, sf_dir)
    level = lambda s: F.array(F.struct(F.col(s).alias("price"), F.col(f"{s}_qty").alias("qty")))
    b = t.select("symbol", "ts_us", "seq", level("bid").alias("top_bids"), level("ask").alias("top_asks"))
    trades = t.where("is_buy").select("symbol", "ts_us", "seq", F.col("price") * 1.001, "qty").toDF("symbol", "ts_us", "seq", "price", "qty")
    return rounded(features.extracted(b, trades, beta=0.6).select("symbol", "ts_us", "seq", "trade_intensity", "price_impact"))


QUERIES["trade_features"] = _trade_features
ORACLE_SQL["trade_features"] = f"""with t as ({views.ticks('duckdb')}), tr as (select symbol, ts_us, seq, price * 1.001 as price, qty from t where is_buy),
n as (select t.symbol, t.ts_us, t.seq, 1 + sum(coalesce(0.5 * exp(-0.6::double * (t.ts_us - tr.ts_us) * 1e-6::double), 0)) as i from t left join tr on tr.symbol = t.symbol and tr.ts_us between t.ts_us - 60000000 and t.ts_us and (tr.ts_us, tr.seq) <= (t.ts_us, t.seq) group by all)
select t.symbol, t.ts_us, t.seq, round(n.i, 6) as trade_intensity, round((tr.price - (t.bid + t.ask) / 2) / tr.qty, 6) + 0.0 as price_impact from t join n using (symbol, ts_us, seq) asof left join tr on tr.symbol = t.symbol and tr.ts_us <= t.ts_us"""


# --- Statistics -------------------------------------------------------------------------------------

def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """views.feature_rows, with the row before found in segments."""
    t = lagged(ticks(spark, sf_dir).withColumn("net", F.expr("bid_qty - ask_qty")), ["symbol"], ["ts_us", "seq"], {"net1": "net"})
    return t.selectExpr(
        "symbol", "ts_us", "seq", "(bid + ask) / 2 as mid", "ask - bid as spread", "net - net1 as ofi_1", "(bid_qty - ask_qty) / (bid_qty + ask_qty) as depth_imb",
        "(ask_qty * bid + bid_qty * ask) / (bid_qty + ask_qty) - (bid + ask) / 2 as microprice_dev", "bid_qty / (bid_qty + ask_qty) as queue_imb", "qty as trade_intensity",
    )


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of ticks with forward returns."""
    return labelled(feature_rows(spark, sf_dir), horizons=STRETCHED)


_FT = f"with l as ({_labels_sql(STRETCHED).replace('round(', '(').replace(', 9)', ')')}), r as ({views.feature_rows('duckdb')}), ft as (select r.*, l.* exclude (symbol, ts_us, seq, mid, spread) from r join l using (symbol, ts_us, seq))"


def _stat(name: str, query: Callable[[DataFrame], DataFrame], text: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(feature_table(spark, sf_dir)))
    if text:
        ORACLE_SQL[name] = f"{_FT} {text}"


_RANKS = "rank() over (partition by {k} order by {x}) + (count(*) over (partition by {k}, {x}) - 1) / 2.0::double"


def _spearman_sql(source: str, keys: str, x: str, y: str, out: str) -> str:
    rx, ry = (_RANKS.format(k=keys, x=c) for c in (x, y))
    return f"rk as (select {keys}, {rx} as rx, {ry} as ry from {source} where {x} is not null and {y} is not null) select {keys}, {out} from rk group by {keys}"


_IC = "round(case when count(*) >= 2 and var_pop(rx) * var_pop(ry) > 0 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) end, 6) + 0.0 as ic"
_stat("stat_rank", lambda d: d.select("symbol", "ts_us", "seq", stats.average_rank("ofi_1", ["symbol"]).alias("r")), f"select symbol, ts_us, seq, {_RANKS.format(k='symbol', x='ofi_1')} as r from (select * replace (case when ofi_1 is null then -1e300 else ofi_1 end as ofi_1) from ft)")
_stat("stat_spearman", lambda d: stats.spearman(d, ["symbol"], "ofi_1", "r_300s"), f", {_spearman_sql('ft', 'symbol', 'ofi_1', 'r_300s', _IC + ', count(*) as n')}")
_stat("stat_pearson", lambda d: stats.pearson(d, ["symbol"], "ofi_1", "r_300s"), "select symbol, round(corr(ofi_1, r_300s), 6) + 0.0 as r, count(*) as n from ft where ofi_1 is not null and r_300s is not null group by symbol")
_WIN = ", fp as (select *, row_number() over (partition by symbol order by ts_us, seq) - 1 as i, count(*) over (partition by symbol) as n from ft where ofi_1 is not null and r_300s is not null), wn as (select symbol, w.range as window_idx, fp.ofi_1, fp.r_300s from fp join range(0, 100000) w on fp.i between w.range * 63 and w.range * 63 + 251 and w.range * 63 + 252 <= fp.n)"
_stat("stat_rolling_ic", lambda d: stats.rolling_ic(d, ["symbol"], ["ts_us", "seq"], "ofi_1", "r_300s", 252, 63), f"{_WIN}, {_spearman_sql('wn', 'symbol, window_idx', 'ofi_1', 'r_300s', _IC)}".replace("select symbol, window_idx, round", "select symbol, window_idx::int as window_idx, (window_idx * 63 + 126)::int as center, round"))
_stat("stat_icir", lambda d: stats.icir(stats.rolling_ic(d, ["symbol"], ["ts_us", "seq"], "ofi_1", "r_300s", 252, 63), ["symbol"]), f"{_WIN}, ri as (with {_spearman_sql('wn', 'symbol, window_idx', 'ofi_1', 'r_300s', _IC.replace('round(', '(').replace(', 6)', ')'))}) select symbol, round(avg(ic) / stddev_samp(ic), 6) + 0.0 as icir, count(*) as n from ri group by symbol")
_stat("stat_ols", lambda d: stats.ols(d, ["symbol"], "r_300s", ["queue_imb"]).select("symbol", "n", (F.element_at("beta", 1) * 1e3).alias("alpha"), (F.element_at("beta", 2) * 1e3).alias("beta")), "select symbol, count(*) as n, round(regr_intercept(r_300s, queue_imb) * 1e3, 6) + 0.0 as alpha, round(regr_slope(r_300s, queue_imb) * 1e3, 6) + 0.0 as beta from ft where r_300s is not null group by symbol")
_stat("stat_regime_ic", lambda d: stats.regime_ic(d, ["symbol"], "spread", "ofi_1", "r_300s"), f", q as (select *, row_number() over (partition by symbol order by spread, ts_us, seq) - 1 as i, count(*) over (partition by symbol) as n from ft where ofi_1 is not null and r_300s is not null), qq as (select *, least(i // (n // 4), 3)::int + 1 as quartile from q), {_spearman_sql('qq', 'symbol, quartile', 'ofi_1', 'r_300s', _IC + ', count(*) as n')}")
_LAGS = ", ".join(f"sum(c * c{k}) as g{k}" for k in range(1, 21))
_stat("stat_ljung_box", lambda d: stats.ljung_box(d, ["symbol"], ["ts_us", "seq"], "r_300s"), f", c as (select symbol, ts_us, seq, r_300s - avg(r_300s) over (partition by symbol) as c from ft where r_300s is not null), cl as (select *, {', '.join(f'lag(c, {k}) over (partition by symbol order by ts_us, seq) as c{k}' for k in range(1, 21))} from c), g as (select symbol, count(*) as n, sum(c * c) as v, {_LAGS} from cl group by symbol) select symbol, n, round(n * (n + 2) * ({' + '.join(f'pow(g{k} / v, 2) / (n - {k})' for k in range(1, 21))}), 6) as q from g")
_stat("stat_vif", lambda d: stats.vif(d, ["symbol"], ["ofi_1", "spread"]), ", c as (select symbol, 1 / (1 - pow(corr(ofi_1, spread), 2)) as v from ft where ofi_1 is not null group by symbol) select symbol, unnest(['ofi_1', 'spread']) as feature, round(v, 6) as vif from c")


def _ic_points(d: DataFrame) -> DataFrame:
    return stats.ic_table(d, ["symbol"], ["ofi_1"], [f"r_{h}" for h in HORIZONS], large=stats.large_keys(d, ["symbol"])).withColumn("tau", F.regexp_extract("horizon", "([0-9]+)", 1).cast("double"))


def _decay(d: DataFrame) -> DataFrame:
    return stats.ic_decay(_ic_points(d), ["symbol"])


_POINTS = f"""rr as (select * from ({" union all ".join(f"select symbol, '{h}' as h, {us / 1e6} as tau, round(ofi_1, 9) as x, round(r_{h}, 9) as y from ft" for h, us in HORIZONS.items())}) where x is not null and y is not null),
rk as (select symbol, tau, {_RANKS.format(k='symbol, tau', x='x')} as rx, {_RANKS.format(k='symbol, tau', x='y')} as ry from rr),
ic as (select symbol, tau, case when count(*) >= 10 and var_pop(rx) * var_pop(ry) > 0 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) end as ic from rk group by symbol, tau)"""
_GRID = """g as (select symbol, i.range * 0.5 as s, count(*) as n, var_pop(exp(-tau / (i.range * 0.5))) as vx, var_pop(ic) as vy, covar_pop(exp(-tau / (i.range * 0.5)), ic) as c, avg(exp(-tau / (i.range * 0.5))) as mx, avg(ic) as my
from ic join range(1, 1201) i on true where ic is not null group by symbol, i.range),
f as (select *, c * c / (vx * vy) as r2 from g where n >= 3 and vx > 1e-24 and vy > 0),
fit as (select symbol, arg_max(struct_pack(s := s, c := c, vx := vx, mx := mx, my := my, r2 := r2), (r2, -s)) as b from f group by symbol)"""
_stat("stat_ic_decay", _decay, f", {_POINTS}, {_GRID} select symbol, round(b.c / b.vx, 6) + 0.0 as a, round(b.s, 6)::double as tau_star, round(b.my - b.c / b.vx * b.mx, 6) + 0.0 as offset, round(b.r2, 6) as r2 from fit")
_stat("stat_halflife", lambda d: signals.halflife(_ic_points(d), ["symbol"], 0.5), f", {_POINTS}, {_GRID} select symbol, any_value(case when b.r2 >= 0.5 then round(b.s, 6)::double end) as tau_star from (select distinct symbol from ic) left join fit using (symbol) group by symbol")
_WF = ", fp as (select *, row_number() over (partition by symbol order by ts_us, seq) - 1 - 500 as i, count(*) over (partition by symbol) - 500 as n from ft), wn as (select *, (i // 250)::int as step from fp where i >= 0 and (i // 250 + 1) * 250 <= n)"
_stat("stat_walk_forward_ic", lambda d: signals.walk_forward_ic(d, ["symbol"], ["ofi_1", "queue_imb"], "r_300s", 500, 250),
      f"{_WF}, wl as (select symbol, step, 'ofi_1' as feature, ofi_1 as x, r_300s from wn union all select symbol, step, 'queue_imb', queue_imb, r_300s from wn), wi as (with {_spearman_sql('wl', 'symbol, step, feature', 'x', 'r_300s', _IC)}) select * from wi where ic is not null")

def _index(d: DataFrame) -> DataFrame:
    """Bars of a table without prices: an index of its returns."""
    return app.price_bars(d.drop("mid")).select("symbol", "ts_us", "seq", "p", "h", "l", "o", "v", "sp")


_stat("price_index", _index, """, s as (select symbol, ts_us, seq, abs(spread) as sp, abs(trade_intensity) as v, greatest(exp(coalesce(sum(ln(1 + greatest(0.1 * coalesce(r_1s, 0), -0.9999999999))) over (partition by symbol order by ts_us, seq rows between unbounded preceding and 1 preceding), 0)), 1e-10) as p from ft)
select symbol, ts_us, seq, round(p, 6) as p, round(p + sp / 2, 6) as h, round(greatest(p - sp / 2, 1e-10), 6) as l, round(coalesce(lag(p) over (partition by symbol order by ts_us, seq), p), 6) as o, round(v, 6) as v, round(sp, 6) as sp from s""")


def _sunk(d: DataFrame) -> DataFrame:
    """Features written by date, exchange and symbol, and read back."""
    out = fresh_dir(d.sparkSession, "features")
    sinks.write_parquet(d.select("symbol", "ts_us", "seq", "mid", "ofi_1", "r_300s").withColumn("exchange", F.lit("recorded")), out)
    return d.sparkSession.read.parquet(out).select("symbol", "exchange", F.col("date").cast("string").alias("date"), "ts_us", "seq", "mid", "ofi_1", "r_300s")


_stat("sink_parquet", _sunk, "select symbol, 'recorded' as exchange, strftime(make_timestamp(ts_us), '%Y-%m-%d') as date, ts_us, seq, round(mid, 6) as mid, round(ofi_1, 6) + 0.0 as ofi_1, round(r_300s, 6) + 0.0 as r_300s from ft")

_SIGNALS = ["ofi_1", "queue_imb"]


def _signal(d: DataFrame) -> DataFrame:
    """A signal of two features per instrument, smoothed, and the positions it asks for."""
    fit = signals.weights(d, ["symbol"], _SIGNALS, "r_300s")
    rows = signals.combined(d.select("symbol", "ts_us", "seq", *_SIGNALS), fit, ["symbol"], _SIGNALS, 50)
    rows = signals.positions(signals.decayed(rows, ["symbol"], "signal", 30.0, 10.0), ["symbol"], "filtered", 1.0)
    return rows.select("symbol", "ts_us", "seq", "signal", "filtered", "position")


_Z = "case when {x} is not null and count({x}) over w{i} = 50 then case when stddev_pop({x}) over w{i} < 2.2e-16 then 0 else ({x} - avg({x}) over w{i}) / stddev_pop({x}) over w{i} end else 0 end"
_WINDOWS = ", ".join(f"w{i} as (partition by symbol, {x} is not null order by ts_us, seq rows between 49 preceding and current row)" for i, x in enumerate(_SIGNALS))
_stat("signal", _signal, f"""{', '.join(['', 'm as (select symbol, avg(r_300s) as my, avg(ofi_1) as m1, avg(queue_imb) as m2, covar_pop(ofi_1, ofi_1) as c11, covar_pop(ofi_1, queue_imb) as c12, covar_pop(queue_imb, queue_imb) as c22, covar_pop(ofi_1, r_300s) as c1, covar_pop(queue_imb, r_300s) as c2 from ft where ofi_1 is not null and queue_imb is not null and r_300s is not null group by symbol)'])},
bt as (select symbol, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) as b1, (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) as b2, my, m1, m2 from m),
we as (select symbol, b1 / (abs(my - b1 * m1 - b2 * m2) + abs(b1) + abs(b2)) as w1, b2 / (abs(my - b1 * m1 - b2 * m2) + abs(b1) + abs(b2)) as w2 from bt),
z as (select ft.symbol, ts_us, seq, row_number() over (partition by ft.symbol order by ts_us, seq) as rn, {_Z.format(x='ofi_1', i=0)} as z1, {_Z.format(x='queue_imb', i=1)} as z2 from ft window {_WINDOWS.replace('partition by symbol', 'partition by ft.symbol')}),
sg as (select z.*, w1 * z1 + w2 * z2 as signal from z join we using (symbol)),
fl as (select t.symbol, t.rn, sum(case when j.rn = 1 then j.signal else (1 - exp(-10.0::double / 30)) * j.signal end * exp(-10.0::double / 30 * (t.rn - j.rn))) as filtered from sg t join sg j on j.symbol = t.symbol and j.rn <= t.rn and j.rn > t.rn - 400 group by t.symbol, t.rn)
select symbol, ts_us, seq, round(signal, 6) + 0.0 as signal, round(filtered, 6) + 0.0 as filtered, (case when filtered > stddev_pop(filtered) over (partition by symbol) then 1 when filtered < -stddev_pop(filtered) over (partition by symbol) then -1 else 0 end)::int as position from sg join fl using (symbol, rn)""")


def _orthogonal(xs: list[str], y: str, out: str) -> str:
    """CTEs that take from y and from each x, in turn, what the x before it explain; the last is `out`."""
    ctes = [f"{out}_0 as (select symbol, ts_us, seq, {', '.join(f'{c} - avg({c}) over (partition by symbol) as {c}' for c in [*xs, y])} from whole)"]
    for i, x in enumerate(xs):
        later = [*xs[i + 1 :], y]
        ctes.append(f"{out}_{i + 1} as (select symbol, ts_us, seq, {', '.join(f'{c} - {x} * sum({c} * {x}) over (partition by symbol) / sum({x} * {x}) over (partition by symbol) as {c}' for c in later)} from {out}_{i})")
    return ", ".join([*ctes, f"{out} as (select symbol, ts_us, seq, {y} as e from {out}_{len(xs)})"])


# --- Backtests --------------------------------------------------------------------------------------

#: depth_imb says the same as queue_imb, with which no fit is regular.
CONFIG = backtest.Config(train_days=8, test_days=4, resample_s=1.0, features=("ofi_1", "depth_imb", "microprice_dev", "trade_intensity"))
QUERIES["backtest"] = lambda spark, sf_dir: rounded(backtest.backtested(feature_table(spark, sf_dir), CONFIG))
QUERIES["backtest_summary"] = lambda spark, sf_dir: rounded(backtest.summarised(backtest.backtested(feature_table(spark, sf_dir), CONFIG)))


def _backtest_sql(c: backtest.Config) -> str:
    """Windows joined by range, fits by orthogonal parts, z-scores in frames of the bar's length, decay as a weighted sum."""
    day, xs, key = backtest.DAY_US, list(c.features), "symbol, window_idx"
    train, test = int(c.train_days * day), int(c.test_days * day)
    chains, z = [], []
    for i, x in enumerate(xs):  # a regressor's beta: what is left of it beside the others, against the target
        chains.append(_orthogonal([v for v in xs if v != x], x, f"q{i}").replace("symbol", key).replace("from whole", "from fit_rows"))
        z.append(f"we.w{i} * case when stddev_pop({x}) over fr < 2.2e-16 then 0 else ({x} - avg({x}) over fr) / stddev_pop({x}) over fr end")
    betas = ", ".join(f"b{i} as (select f.symbol, f.window_idx, sum(e * {c.target}) / sum(e * e) as b{i} from q{i} join fit_rows f using (symbol, window_idx, ts_us, seq) group by all)" for i in range(len(xs)))
    sizes = " + ".join(f"abs(b{i})" for i in range(len(xs)))
    order = "order by ts_us, seq"
    by = f"partition by {key}"
    whole = " and ".join(f"{x} is not null" for x in xs)
    return f"""{_FT}, sy as (select symbol, min(ts_us) as t0, max(ts_us) as t1, (max(ts_us) - min(ts_us)) / 1e6::double / (count(*) - 1) as dt from ft group by symbol),
sm as (select symbol, spread as median_spread from (select symbol, spread, row_number() over (partition by symbol order by spread) as rn, count(*) over (partition by symbol) as m from ft where spread > 0) where rn = m // 2 + 1),
sp as (select sy.*, greatest(round({c.resample_s} / dt), 1)::bigint as skip, dt * greatest(round({c.resample_s} / dt), 1) as bar_s, {c.max_spread_multiple}::double * median_spread as max_spread from sy join sm using (symbol) where t1 - t0 >= {train + test}),
wi as (select sp.*, unnest(range(0, (t1 - t0 - {train + test}) // {test} + 1))::int as window_idx from sp),
al as (select ft.*, wi.window_idx, wi.skip, wi.bar_s, wi.max_spread, ft.ts_us - t0 - window_idx::bigint * {test} < {train} as is_train from ft join wi on wi.symbol = ft.symbol and ft.ts_us - t0 >= window_idx::bigint * {test} and ft.ts_us - t0 < window_idx::bigint * {test} + {train + test}),
th as (select * from (select *, row_number() over ({by}, is_train {order}) - 1 as bar from al) where bar % skip = 0),
ok as (select *, count(*) filter (is_train) over ({by}) as train_rows, count(*) filter (not is_train) over ({by}) as test_rows from th),
us as (select * from ok where train_rows >= {c.least_train} and test_rows >= {c.least_test}),
fit_rows as (select * from us where is_train and {whole} and {c.target} is not null), {', '.join(chains)}, {betas},
we as (select {key}, {', '.join(f'b{i} / ({sizes}) as w{i}' for i in range(len(xs)))} from {' join '.join(['b0', *[f'b{i} using (symbol, window_idx)' for i in range(1, len(xs))]])}),
zs as (select us.*, greatest(10, least(300, floor(1800 / bar_s)::int)) as size, row_number() over ({by} {order}) as rn from us where not is_train and {whole}),
zr as (select zs.*, case when rn >= size then {' + '.join(z)} end as raw from zs join we using (symbol, window_idx) window fr as (partition by zs.symbol, zs.window_idx order by ts_us, seq rows between size - 1 preceding and current row)),
zf as (select t.symbol, t.window_idx, t.ts_us, t.seq, sum(case when j.rn = t.size then j.raw else (1 - exp(-t.bar_s / {c.tau_star_s})) * j.raw end * exp(-t.bar_s / {c.tau_star_s} * (t.rn - j.rn))) as signal
from zr t join zr j on j.symbol = t.symbol and j.window_idx = t.window_idx and j.rn <= t.rn and j.raw is not null where t.raw is not null group by all),
sg as (select us.*, zf.signal from us left join zf using (symbol, window_idx, ts_us, seq) where not is_train),
rk as (select {key}, {_RANKS.format(k=key, x='signal')} as rx, {_RANKS.format(k=key, x=c.target)} as ry from sg where signal is not null and {c.target} is not null),
ic as (select {key}, coalesce(case when count(*) >= 2 and var_pop(rx) * var_pop(ry) > 0 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) end, 0) as oos_ic from rk group by all),
sd as (select {key}, case when count(signal) > 1 then greatest(stddev_pop(signal), 1e-10) else 1.0 end::double as sigma from sg group by all),
ps as (select sg.*, sd.sigma, k::double as k, case when coalesce(spread, 0) > max_spread then 0 when signal > k * sigma then 1 when signal < -k * sigma then -1 else 0 end as pos from sg join sd using (symbol, window_idx), (select unnest([{', '.join(map(str, c.thresholds))}]) as k)),
pv as (select *, coalesce(lag(pos) over (partition by {key}, k {order}), 0) as prev from ps),
pl as (select *, prev * coalesce({c.target}, 0) - abs(pos - prev) * (coalesce(spread, 0) / 2 + {c.fee}::double) as pnl, (pos <> prev)::int as moved from pv),
cu as (select *, sum(pnl) over run as cum from pl window run as (partition by {key}, k {order} rows unbounded preceding)),
dd as (select *, greatest(max(cum) over (partition by {key}, k {order} rows unbounded preceding), 0) - cum as down from cu),
bt as (select {key}, k, any_value(sigma) as sigma, any_value(train_rows)::bigint as train_rows, any_value(test_rows)::bigint as test_rows, sum(moved)::bigint as n_trades, sum(pnl) as total_pnl_net,
case when count(*) > 1 and stddev_pop(pnl) >= 1e-15 then avg(pnl) / stddev_pop(pnl) * sqrt(count(*)) else 0 end as period_sharpe, max(down) as max_drawdown, avg(moved) as turnover from dd group by all),
res as (select bt.*, coalesce(oos_ic, 0) as oos_ic from bt left join ic using (symbol, window_idx))"""


ORACLE_SQL["backtest"] = f"{_backtest_sql(CONFIG)} select symbol, window_idx, k, train_rows, test_rows, n_trades, {', '.join(f'round({n}, 6) + 0.0 as {n}' for n in ('sigma', 'total_pnl_net', 'period_sharpe', 'max_drawdown', 'turnover', 'oos_ic'))} from res"
ORACLE_SQL["backtest_summary"] = f"""{_backtest_sql(CONFIG)} select symbol, k, count(*) as n_windows, round(avg(oos_ic), 6) + 0.0 as avg_oos_ic, round(sum(total_pnl_net), 6) + 0.0 as total_pnl_net, round(avg(period_sharpe), 6) + 0.0 as avg_sharpe,
round(max(max_drawdown), 6) + 0.0 as max_drawdown, round(avg(turnover), 6) + 0.0 as avg_turnover, sum(n_trades)::bigint as n_trades from res group by symbol, k"""


# --- Report and simulation --------------------------------------------------------------------------

_FEATURES = ["ofi_1", "depth_imb", "microprice_dev", "queue_imb", "spread", "trade_intensity"]
_RETURNS = list(report.HORIZON_S)
_SECTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "summary": report.summary,
    "ic": lambda f: report.ic_section(f, _FEATURES, _RETURNS),
    "decay": lambda f: report.decay_section(report.ic_section(f, _FEATURES, _RETURNS)),
    "adf": lambda f: report.adf_section(f, _FEATURES),
    "vif": lambda f: report.vif_section(f, _FEATURES),
    "ljung_box": lambda f: report.ljung_box_section(f, _FEATURES),
    "regimes": report.regime_section,
    "partial_r2": report.partial_r2,
    "sign_accuracy": report.sign_accuracy,
    "hypotheses": lambda f: report.sections(f, _FEATURES)["hypotheses"],
}
for _name, _section in _SECTIONS.items():
    QUERIES[f"report_{_name}"] = (lambda s: lambda spark, sf_dir: rounded(s(feature_table(spark, sf_dir))))(_section)
ORACLE_SQL["report_summary"] = f"{_FT} select symbol, count(*) as n, min(ts_us) as first_ts, max(ts_us) as last_ts from ft group by symbol"
ORACLE_SQL["report_sign_accuracy"] = f"{_FT} select symbol, round(avg((sign(microprice_dev) = sign(r_1s))::int), 6) as sign_accuracy from ft where microprice_dev <> 0 and r_1s <> 0 group by symbol"
ORACLE_SQL["report_regimes"] = ORACLE_SQL["stat_regime_ic"]

# queue_imb says the same as depth_imb, so the regressions leave it out.
_CHOSEN = [c for c in _FEATURES if c != "queue_imb"]


_WHOLE = f", whole as (select symbol, ts_us, seq, r_300s, {', '.join(_CHOSEN)} from ft where {' and '.join(f'{c} is not null' for c in [*_CHOSEN, 'r_300s'])})"
_VIF = [f"select w.symbol, '{x}' as feature, var_pop(w.{x}) / var_pop(v{i}.e) as vif from whole w join v{i} using (symbol, ts_us, seq) group by w.symbol" for i, x in enumerate(_CHOSEN)]
ORACLE_SQL["report_vif"] = f"{_FT}{_WHOLE}, {', '.join(_orthogonal([c for c in _CHOSEN if c != x], x, f'v{i}') for i, x in enumerate(_CHOSEN))} select symbol, feature, round(vif, 6) as vif from ({' union all '.join(_VIF)})"
_BOX = ORACLE_SQL["stat_ljung_box"].split(", c as (", 1)[1].split(" from ft where r_300s is not null)", 1)
ORACLE_SQL["report_ljung_box"] = f"with x as (with y as ({_FT}{_WHOLE}, {_orthogonal(_CHOSEN, 'r_300s', 'res')} select symbol, ts_us, seq, e as r_300s from res), c as ({_BOX[0]} from y){_BOX[1]}) select *, q > 31.41 as autocorrelated from x where n >= 25"
_ALL = " union all ".join(f"select symbol, '{x}' as feature, 'r_{h}' as horizon, {us / 1e6} as tau, {x} as x, r_{h} as y from ft" for x in _FEATURES for h, us in HORIZONS.items())
_IC_ALL = f"al as (select * from ({_ALL}) where x is not null and y is not null), rk as (select symbol, feature, horizon, tau, {_RANKS.format(k='symbol, feature, horizon', x='x')} as rx, {_RANKS.format(k='symbol, feature, horizon', x='y')} as ry from al), ic as (select symbol, feature, horizon, tau, case when count(*) >= 2 and var_pop(rx) * var_pop(ry) > 0 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) end as ic from rk group by all)"
_FITS = _GRID.replace("select symbol, i.range * 0.5", "select symbol, feature, i.range * 0.5").replace("group by symbol, i.range", "group by symbol, feature, i.range").replace("fit as (select symbol,", "fit as (select symbol, feature,").replace("from f group by symbol)", "from f group by symbol, feature)")
ORACLE_SQL["report_decay"] = f"{_FT}, {_IC_ALL}, {_FITS} select symbol, feature, round(b.c / b.vx, 6) + 0.0 as a, round(b.s, 6)::double as tau_star, round(b.my - b.c / b.vx * b.mx, 6) + 0.0 as offset, round(b.r2, 6) as r2 from fit"
_PARTIAL = "pr as (select symbol, corr(depth_imb, r_300s) as ry, corr(ofi_1, r_300s) as rx, corr(ofi_1, depth_imb) as rz from ft where ofi_1 is not null and depth_imb is not null and r_300s is not null group by symbol), pq as (select symbol, pow(ry - rx * rz, 2) / ((1 - rx * rx) * (1 - rz * rz)) as partial_r2 from pr)"
ORACLE_SQL["report_partial_r2"] = f"{_FT}, {_PARTIAL} select symbol, round(partial_r2, 6) as partial_r2 from pq"
ORACLE_SQL["report_hypotheses"] = f"""{_FT}, {_IC_ALL}, {_FITS}, {_PARTIAL}, sa as (select symbol, avg((sign(microprice_dev) = sign(r_1s))::int) as acc from ft where microprice_dev <> 0 and r_1s <> 0 group by symbol),
rg as ({ORACLE_SQL['stat_regime_ic']}), rq as (select symbol, max(case when quartile = 1 then ic end) as q1, max(case when quartile = 4 then ic end) as q4 from rg group by symbol),
h1 as (select symbol, bool_or(ic > 0.05) as h1 from ic group by symbol)
select d.symbol, h1.h1, fit.b.s < 60 and fit.b.r2 > 0.9 as h2, pq.partial_r2 > 0.01 as h3, rq.q4 < rq.q1 as h4, sa.acc > 0.55 as h5
from (select distinct symbol from ft) d left join h1 using (symbol) left join (select * from fit where feature = 'ofi_1') fit using (symbol) left join pq using (symbol) left join rq using (symbol) left join sa using (symbol)"""
# By Frisch and Waugh a coefficient's robust error needs only its own regressor, orthogonal to the others: e, and the residuals u.
_OF = "over (partition by symbol, feature, horizon)"
_ROLL = "rw as (select a.symbol, a.feature, a.horizon, w.range as win, x, y from (select *, row_number() over (partition by symbol, feature, horizon order by ts_us, seq) - 1 as i, count(*) over (partition by symbol, feature, horizon) as n from al) a join range(0, 100000) w on a.i between w.range * 63 and w.range * 63 + 251 and w.range * 63 + 252 <= a.n)"
_ROLL += f", rr as (select symbol, feature, horizon, win, {_RANKS.format(k='symbol, feature, horizon, win', x='x')} as rx, {_RANKS.format(k='symbol, feature, horizon, win', x='y')} as ry from rw), ri as (select symbol, feature, horizon, win, case when var_pop(rx) * var_pop(ry) > 0 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) end as ic from rr group by all)"
_ROLL += ", ir as (select symbol, feature, horizon, case when stddev_samp(ic) > 0 then avg(ic) / stddev_samp(ic) end as icir from ri where ic is not null group by all)"
ORACLE_SQL["report_ic"] = f"""{_FT}, {_IC_ALL.replace(_ALL, _ALL.replace(' as feature,', ' as feature, ts_us, seq,'))}, {_ROLL},
fx as (select *, x - avg(x) {_OF} as e, y - avg(y) {_OF} as c, row_number() over (partition by symbol, feature, horizon order by ts_us, seq) as i, count(*) {_OF} as n, 10 * tau as lags from al),
fb as (select *, sum(c * e) {_OF} / sum(e * e) {_OF} as beta, sum(e * e) {_OF} as ee from fx),
fz as (select symbol, feature, horizon, i, n, lags, beta, ee, e * (c - beta * e) as z from fb),
fs as (select symbol, feature, horizon, any_value(n) as n, any_value(lags) as lags, any_value(beta) as beta, any_value(ee) as ee, sum(z * z) as own from fz group by all),
fl as (select t.symbol, t.feature, t.horizon, sum((1 - (t.i - s.i) / (t.lags + 1)) * t.z * s.z) as cross_ from fz t join fz s on s.symbol = t.symbol and s.feature = t.feature and s.horizon = t.horizon and s.i between t.i - t.lags and t.i - 1 where t.n > 2 + t.lags group by all),
nw as (select symbol, feature, horizon, n, beta, case when n > 2 + lags then beta / (sqrt(greatest(own + 2 * cross_, 0)) / ee) end as nw_t from fs left join fl using (symbol, feature, horizon))
select symbol, feature, horizon, round(ic.ic, 6) + 0.0 as ic, n, round(icir, 6) + 0.0 as icir, round(beta, 6) + 0.0 as beta, round(nw_t, 6) + 0.0 as nw_t from ic join nw using (symbol, feature, horizon) left join ir using (symbol, feature, horizon)"""
_DIFFS = ["d1", "d2", "d3", "d4", "d5", "y1"]
_BY = "over (partition by symbol order by ts_us, seq)"
_ADF_CHAIN = _orthogonal(_DIFFS, "d0", "od").replace("partition by symbol)", "partition by symbol, feature)").replace("select symbol, ts_us, seq,", "select symbol, feature, ts_us, seq,")
_ADF_LONG = " union all ".join(f"select symbol, '{c}' as feature, ts_us, seq, {c} as x from ft where {c} is not null" for c in _FEATURES)
ORACLE_SQL["report_adf"] = f"""{_FT}, lo as ({_ADF_LONG}), df as (select *, x - lag(x) {_BY.replace('symbol', 'symbol, feature', 1)} as d, lag(x) {_BY.replace('symbol', 'symbol, feature', 1)} as y1 from lo),
whole as (select * from (select symbol, feature, ts_us, seq, y1, d as d0, {', '.join(f'lag(d, {k}) ' + _BY.replace('symbol', 'symbol, feature', 1) + f' as d{k}' for k in range(1, 6))} from df) where d5 is not null), {_ADF_CHAIN},
uz as (select symbol, feature, ts_us, seq, y1 as e, sum(d0 * y1) over (partition by symbol, feature) / sum(y1 * y1) over (partition by symbol, feature) as beta, sum(y1 * y1) over (partition by symbol, feature) as ee, d0 from od_5),
zz as (select symbol, feature, beta, ee, e * (d0 - beta * e) as z, {', '.join(f'lag(e * (d0 - beta * e), {k}) ' + _BY.replace('symbol', 'symbol, feature', 1) + f' as z{k}' for k in range(1, 6))} from uz),
tt as (select symbol, feature, any_value(beta) / (sqrt(sum(z * z) + {' + '.join(f'{2 * (1 - k / 6)} * sum(coalesce(z * z{k}, 0))' for k in range(1, 6))}) / any_value(ee)) as t from zz group by all)
select symbol, feature, round(t, 6) + 0.0 as t, t < -2.86 as stationary from tt"""
QUERIES["simulation"] = lambda spark, sf_dir: rounded(simulate.feature_table(spark, 2, simulate.Params(duration_s=120.0)))

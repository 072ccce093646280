"""The 87 technical indicators.

Those over bounded or running frames are SQL expressions over an instrument's rows; those that carry a
state from row to row are folds (operators/folds.py). Inputs of every row: symbol, ts_us, seq, p (price),
h, l (high, low), o (open), v (volume), sp (spread), ofi.

Frame expressions are layered: LAYER1 adds columns that look back by rows, LAYER2 adds columns over
frames of those, and an indicator may use any of them. `rn` counts rows of the instrument, `n` is their number.
"""

from __future__ import annotations

from lobspark.functions.frames import ALL, KEY, RUN, rows, safe, so_far

#: name -> SQL over the inputs.
LAYER1: dict[str, str] = {
    "rn": f"row_number() over {RUN}",
    "n": f"count(*) over {ALL}",
    "p1": f"lag(p, 1) over {RUN}",
    "p10": f"lag(p, 10) over {RUN}",
    "p20": f"lag(p, 20) over {RUN}",
    "p5": f"lag(p, 5) over {RUN}",
    "p16": f"lag(p, 16) over {RUN}",
    "h1": f"lag(h, 1) over {RUN}",
    "l1": f"lag(l, 1) over {RUN}",
    "v1": f"lag(v, 1) over {RUN}",
    "v14": f"lag(v, 14) over {RUN}",
    "sp1": f"lag(sp, 1) over {RUN}",
    "wma7": "(" + " + ".join(f"{7 - j} * lag(p, {j}) over {RUN}" for j in range(7)) + ") / 28",
    "wma14": "(" + " + ".join(f"{14 - j} * lag(p, {j}) over {RUN}" for j in range(14)) + ") / 105",
    **{f"avg{n}": f"avg(p) over {rows(n)}" for n in (5, 10, 20, 50, 100, 200)},
    **{f"sd{n}": f"stddev_pop(p) over {rows(n)}" for n in (10, 20, 50)},
    **{f"hh{n}": f"max(h) over {rows(n)}" for n in (14, 20, 50)},
    **{f"ll{n}": f"min(l) over {rows(n)}" for n in (14, 20, 50)},
    "savg20": f"avg(sp) over {rows(20)}",
    "vavg20": f"avg(v) over {rows(20)}",
    "mid": "(h + l) / 2",
    "pv": "(h + l + p) / 3 * v",
    "tp": "(h + l + p) / 3",
    "hl2": f"pow(ln(h / (case when l > 1e-12 then l else 1e-12 end)), 2)",
    "co2": "pow(ln(p / o), 2)",
}
#: name -> SQL over the inputs and LAYER1.
LAYER2: dict[str, str] = {
    "d": "p - p1",
    "d0": "coalesce(p - p1, 0.0)",
    "d1": f"case when rn = 2 then 0.0 else p1 - lag(p1, 1) over {RUN} end",
    "ret": "case when p1 > 0 and p > 0 then ln(p / p1) end",
    "tr": "case when p1 is null then h - l else greatest(h - l, abs(h - p1), abs(l - p1)) end",
    "tp1": f"lag(tp, 1) over {RUN}",
    "mid1": f"lag(mid, 1) over {RUN}",
    "q16": "case when p16 > 0 and p > 0 then ln(p / p16) end",
    "hma_in": "2 * wma7 - wma14",
    "k14": "case when rn >= 14 then " + safe("100 * (p - ll14)", "hh14 - ll14") + " end",
    "avg20_11": f"lag(avg20, 11) over {RUN}",
    "mavg5": f"avg(mid) over {rows(5)}",
    "mavg34": f"avg(mid) over {rows(34)}",
    "cum_v": f"sum(v) over {so_far()}",
    "cum_pv": f"sum(pv) over {so_far()}",
    "aofi": "abs(ofi)",
    "mofi": f"max(abs(ofi)) over {rows(20)}",
}
#: name -> SQL over the inputs, LAYER1 and LAYER2.
LAYER3: dict[str, str] = {
    "up": "case when d > 0 then d else 0.0 end",
    "dn": "case when d < 0 then -d else 0.0 end",
    "pos": "case when rn = 1 then 0.0 when tp >= tp1 then tp * v else 0.0 end",
    "neg": "case when rn = 1 then 0.0 when tp < tp1 then tp * v else 0.0 end",
    "sv": "case when rn = 1 then 0.0 when p > p1 then v when p < p1 then -v else 0.0 end",
    "rv": "case when rn = 1 then 0.0 when abs(p1) < 1e-12 then 0.0 else (p - p1) / p1 * v end",
    "eomv": "case when rn = 1 or abs(h - l) <= 1e-12 then 0.0 else (mid - mid1) / ((case when v > 1e-12 then v / 1e6 else 1.0 end) * (h - l)) end",
    "ami": "case when rn = 1 or v < 1e-12 or ret is null then 0.0 else abs(ret) / v end",
    "ad": "abs(d)",
}


def after(rn: int, sql: str) -> str:
    """sql from row rn on."""
    return f"case when rn >= {rn} then {sql} end"


#: name -> SQL. Null where the instrument's history is too short.
FRAME: dict[str, str] = {
    **{f"sma_{n}": after(n, f"avg{n}") for n in (10, 20, 50, 100, 200)},
    "wma_14": "wma14",
    "hma_14": "(" + " + ".join(f"{4 - j} * lag(hma_in, {j}) over {RUN}" for j in range(4)) + ") / 10",
    "aroon_up_25": after(26, f"100e0 * (25 - (rn - max_by(rn, (h, rn)) over {rows(26)})) / 25e0"),
    "aroon_down_25": after(26, f"100e0 * (25 - (rn - min_by(rn, (l, rn)) over {rows(26)})) / 25e0"),
    "choppiness_14": after(15, f"case when hh14 - ll14 >= 1e-12 then 100 * log10(nullif(sum(tr) over {rows(14)}, 0) / nullif(hh14 - ll14, 0)) / log10(14.0) end"),
    "stoch_k_14": "k14",
    "stoch_d_14": after(16, f"case when count(k14) over {rows(3)} = 3 then avg(k14) over {rows(3)} end"),
    "williams_r_14": after(14, safe("-100 * (hh14 - p)", "hh14 - ll14")),
    **{f"roc_{n}": safe(f"100 * (p - p{n})", f"p{n}") for n in (10, 20)},
    **{f"momentum_{n}": f"p - p{n}" for n in (10, 20)},
    "cmo_14": after(15, safe(f"100 * (sum(up) over {rows(14)} - sum(dn) over {rows(14)})", f"sum(up) over {rows(14)} + sum(dn) over {rows(14)}")),
    "dpo_20": after(31, "p - avg20_11"),
    "awesome_osc": after(34, "mavg5 - mavg34"),
    "bb_width_20": after(20, safe("4 * sd20", "avg20")),
    "bb_pct_b_20": after(20, safe("p - (avg20 - 2 * sd20)", "4 * sd20")),
    "donchian_width_20": after(20, safe("hh20 - ll20", "(hh20 + ll20) / 2")),
    "realized_vol_20": after(21, f"stddev_pop(ret) over {rows(20)}"),
    "parkinson_vol_14": after(14, f"sqrt(avg(hl2) over {rows(14)} / (4 * ln(2.0)))"),
    "garman_klass_20": after(20, f"sqrt(greatest(0.5 * (avg(hl2) over {rows(20)}) - (2 * ln(2.0) - 1) * (avg(co2) over {rows(20)}), 0.0))"),
    "obv": f"sum(sv) over {so_far()}",
    "vwap_dev": "case when cum_v <= 1e-12 then 0.0 else " + safe("p - cum_pv / nullif(cum_v, 0)", "p") + " end",
    "mfi_14": after(15, safe(f"100 * (sum(pos) over {rows(14)})", f"(sum(pos) over {rows(14)}) + (sum(neg) over {rows(14)})")),
    "ease_of_movement_14": after(14, f"avg(eomv) over {rows(14)}"),
    "vpt": f"sum(rv) over {so_far()}",
    "vroc_14": safe("100 * (v - v14)", "v14"),
    "rvol_20": after(20, safe("v", "vavg20")),
    **{f"dist_high_{n}": after(n, safe(f"hh{n} - p", "p")) for n in (20, 50)},
    **{f"dist_low_{n}": after(n, safe(f"p - ll{n}", "p")) for n in (20, 50)},
    "pivot_dist": safe("p - (h1 + l1 + p1) / 3", "p"),
    "r1_dist": safe("p - (2 * (h1 + l1 + p1) / 3 - l1)", "p"),
    "s1_dist": safe("p - (2 * (h1 + l1 + p1) / 3 - h1)", "p"),
    "fib_618_dist": after(50, safe("p - (ll50 + 0.618 * (hh50 - ll50))", "p")),
    "round_number_prox": safe("abs(p - round(p / 0.001) * 0.001)", "p"),
    **{f"zscore_{n}": after(n, safe(f"p - avg{n}", f"sd{n}")) for n in (10, 20, 50)},
    "lr_slope_20": after(20, safe(f"regr_slope(p, rn) over {rows(20)}", "avg20")),
    "lr_r2_20": after(20, f"case when sd20 >= 1e-12 then pow(covar_pop(p, rn) over {rows(20)}, 2) / nullif(sd20 * sd20 * 33.25, 0) end"),
    "lr_deviation_20": after(20, safe(f"p - (avg20 + (regr_slope(p, rn) over {rows(20)}) * 9.5)", "avg20")),
    "autocorr_lag1": after(51, safe(f"covar_pop(p, p1) over {rows(50)}", f"(stddev_pop(p) over {rows(50)}) * (stddev_pop(p1) over {rows(50)})")),
    "autocorr_lag5": after(55, safe(f"covar_pop(p, p5) over {rows(50)}", f"(stddev_pop(p) over {rows(50)}) * (stddev_pop(p5) over {rows(50)})")),
    "variance_ratio_16": after(116, safe(f"var_pop(q16) over {rows(85)}", f"16 * (var_pop(ret) over {rows(100)})", "16e-12")),
    "amihud_20": after(21, f"avg(ami) over {rows(20, 1)}"),
    "roll_spread": after(22, f"2 * sqrt(greatest(-(covar_pop(d0, d1) over {rows(20, 1)}), 0.0))"),
    "kyle_lambda_20": after(21, safe("abs(p - p20)", f"sum(aofi) over {rows(20, 1)}")),
    "effective_spread": safe("sp", "p"),
    "book_pressure": after(20, safe("ofi", "mofi")),
    "spread_osc": after(20, safe("sp - savg20", "savg20")),
    "spread_change_rate": safe("sp - sp1", "sp1"),
    "info_efficiency_20": after(21, safe("abs(p - p20)", f"sum(ad) over {rows(19, 1)}")),
}

#: Folds (operators/folds.py) and indicators of whole windows, in the order of their columns there.
FOLDED = (
    "ema_5", "ema_12", "ema_20", "ema_26", "ema_50", "ema_200", "dema_20", "tema_20", "kama_10", "golden_cross", "death_cross",
    "adx_14", "pdi_14", "mdi_14", "supertrend_14", "rsi_7", "rsi_14", "rsi_21", "macd_line", "macd_signal", "macd_hist",
    "cci_20", "keltner_width_20", "atr_14", "natr_14", "squeeze_signal", "force_index_13", "hurst_100",
)
NAMES = (*FRAME, *FOLDED)


#: Sums over all rows so far, by the column that they add up; in blocks they are a block's own and those of the blocks before.
SUMS = ("v", "pv", "sv", "rv")
#: Rows before a block that its frames reach: the longest has 200, and frames over lags less.
REACH = 256


def _layers(base: str, blocks: bool = False) -> str:
    """`with` b0 to b3: base and its layers. With blocks, base also has place, block, own and, for each of SUMS, `off_<column>`."""

    def layer(columns: dict[str, str]) -> str:
        return "".join(f", {blocked(sql) if blocks else sql} as {name}" for name, sql in columns.items())

    first = LAYER1 | {"rn": "place + 1"} if blocks else LAYER1
    first = {c: sql for c, sql in first.items() if not blocks or c != "n"}
    return f"with b0 as ({base}), b1 as (select b0.*{layer(first)} from b0), b2 as (select b1.*{layer(LAYER2)} from b1), b3 as (select b2.*{layer(LAYER3)} from b2)"


def blocked(sql: str) -> str:
    """An expression over an instrument's rows as one over those of a block and the REACH rows before it."""
    for c in SUMS:
        run = f"sum(case when own then {c} end) over {so_far()}"
        sql = sql.replace(f"sum({c}) over {so_far()}", f"coalesce(off_{c} + {run}, off_{c}, {run})")
    return sql.replace(KEY, f"{KEY}, block")


def block_sums_sql(base: str) -> str:
    """(symbol, block, SUMS) of base (as for _layers, but without sums): what each block adds to the running sums."""
    none = "".join(f", cast(null as double) as off_{c}" for c in SUMS)
    return f"{_layers(f'select x.*{none} from ({base}) x', True)} select symbol, block{''.join(f', sum({c}) as {c}' for c in SUMS)} from b3 where own group by symbol, block"


def framed_sql(base: str, names: list[str] | None = None, digits: int | None = None, keep: list[str] | None = None, blocks: bool = False) -> str:
    """A query over `base` (a query with the inputs) for frame indicators, beside the columns of base in `keep`; layers that none of
    them needs are pruned by the engine. With blocks, base is as _layers says, and rows are those of the blocks' own."""
    names = list(FRAME) if names is None else names

    def last(name: str) -> str:
        sql = blocked(FRAME[name]) if blocks else FRAME[name]
        return f"({sql})" if digits is None else f"round({sql}, {digits})"

    own = ", own" if blocks else ""
    found = f"select symbol, ts_us, seq{own}{''.join(f', {c}' for c in keep or [])}{''.join(f', {last(n)} as {n}' for n in names)} from b3"
    return f"{_layers(base, blocks)} {found}"

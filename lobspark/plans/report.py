"""The analysis report: eight sections as DataFrames over all instruments at once, and a text of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.operators import stats
from lobspark.operators.features import NAMES
from lobspark.operators.stats import finite

HORIZON_S = {"r_1s": 1, "r_5s": 5, "r_30s": 30, "r_300s": 300}
#: Critical points, window of the rolling IC, lags.
ADF_CRITICAL, LJUNG_BOX_CRITICAL, ADF_LAGS, LB_LAGS, IC_WINDOW, IC_STEP = -2.86, 31.41, 5, 20, 252, 63


def summary(f: DataFrame) -> DataFrame:
    return f.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts"))


def ic_section(f: DataFrame, features: list[str], returns: list[str]) -> DataFrame:
    """(symbol, feature, horizon, ic, n, icir, beta, nw_t): lags of the HAC errors are ten times the horizon."""
    keys = ["symbol", "feature", "horizon"]
    ic = stats.ic_table(f, ["symbol"], features, returns, 2, None, stats.large_keys(f, ["symbol"])).withColumnRenamed("indicator", "feature")
    facts = stats.series_facts(f, ["symbol"], ["ts_us", "seq"], features, {h: 10 * HORIZON_S[h] for h in returns}, IC_WINDOW, IC_STEP)
    return ic.join(facts.drop("n"), keys, "left").select(*keys, "ic", "n", "icir", "beta", "nw_t")


def decay_section(ic: DataFrame) -> DataFrame:
    tau = F.regexp_extract("horizon", "([0-9]+)", 1).cast("double")
    return stats.ic_decay(ic.withColumn("tau", tau), ["symbol", "feature"])


def adf_section(f: DataFrame, features: list[str]) -> DataFrame:
    """(symbol, feature, t, stationary)."""
    return stats.dickey_fuller(f, ["symbol"], ["ts_us", "seq"], features, ADF_LAGS).withColumn("stationary", F.col("t") < ADF_CRITICAL)


def chosen_features(f: DataFrame, features: list[str]) -> DataFrame:
    """(symbol, chosen): features with enough finite values and variance; of two that say the same the later is left out."""
    base = f.select("symbol", *[finite(c).alias(c) for c in features])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a))

    def corr(a: str, b: str):
        x, y = both(a, b), both(b, a)
        var = F.var_pop(x) * F.var_pop(y)
        return F.when((F.count(x) >= 10) & (var > 0), F.covar_pop(x, y) / F.sqrt(var)).alias(f"r:{a}:{b}")

    facts = base.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n:{c}") for c in features], *[F.var_samp(c).alias(f"v:{c}") for c in features], *[corr(a, b) for a, b in pairs])
    names = facts.columns

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A row an instrument: which features take part follows from it, without the data.
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                fact, chosen = dict(zip(names, row, strict=True)), []
                for c in features:
                    alike = [fact[f"r:{b}:{c}"] for b in chosen]
                    if fact[f"n:{c}"] >= max(fact["n"] // 10, 14) and fact[f"v:{c}"] > 1e-20 and not any(r is not None and abs(r) > 0.9999 for r in alike):
                        chosen.append(c)
                out.append((fact["symbol"], chosen))
            yield pd.DataFrame(out, columns=["symbol", "chosen"])

    return facts.mapInPandas(choose, "symbol string, chosen array<string>")


def complete(f: DataFrame, features: list[str], target: str) -> DataFrame:
    """(symbol, ts_us, seq, features, target, chosen): rows with a target and all of their instrument's chosen features; the others are 0."""
    base = f.select("symbol", "ts_us", "seq", *[finite(c).alias(c) for c in dict.fromkeys([*features, target])])
    rows = base.where(F.col(target).isNotNull()).join(chosen_features(f, features), "symbol")
    named = F.create_map(*[x for c in features for x in (F.lit(c), F.col(c))])
    rows = rows.where(F.forall("chosen", lambda name: F.element_at(named, name).isNotNull()))
    return rows.withColumns({c: F.when(F.array_contains("chosen", c), F.col(c)).otherwise(0.0) for c in features})


def _whole_sums(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    cols = [F.lit(1.0), *[F.col(c) for c in features]]
    return rows.groupBy("symbol", "chosen").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.covar_pop(a, b) for a in features for b in features]).alias("cov"), F.array(*[F.covar_pop(a, F.col(target)) for a in features]).alias("cy"), F.array(*[F.avg(c) for c in [*cols[1:], F.col(target)]]).alias("means"))


def vif_section(f: DataFrame, features: list[str], target: str = "r_300s") -> DataFrame:
    """(symbol, feature, vif) of the chosen features, over the rows that the regression on them uses."""
    rows = complete(f, features, target).where(F.size("chosen") >= 2)
    k = len(features)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for symbol, names, n, cov in b[["symbol", "chosen", "n", "cov"]].itertuples(index=False):
                at = [features.index(x) for x in names]
                m = np.array(cov).reshape(k, k)[np.ix_(at, at)]
                sd = np.sqrt(np.diag(m))
                inv = stats.solved(m / np.outer(sd, sd), np.eye(len(at))) if n >= len(at) + 2 and (sd > 0).all() else None
                out += [(symbol, x, None if inv is None else float(inv[i, i])) for i, x in enumerate(names)]
            yield pd.DataFrame(out, columns=["symbol", "feature", "vif"])

    return _whole_sums(rows, features, target).mapInPandas(invert, "symbol string, feature string, vif double")


def residuals(f: DataFrame, features: list[str], target: str) -> DataFrame:
    """(symbol, ts_us, seq, e) of the complete rows, by least squares on the chosen features and a constant."""
    rows = complete(f, features, target).where(F.size("chosen") >= 1)
    k = len(features)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for symbol, names, cov, cy, means in b[["symbol", "chosen", "cov", "cy", "means"]].itertuples(index=False):
                at = [features.index(x) for x in names]
                m, v = np.array(cov).reshape(k, k)[np.ix_(at, at)], np.array(cy)[at]
                sd = np.sqrt(np.diag(m))
                beta = stats.solved(m / np.outer(sd, sd), v / sd) if (sd > 0).all() else None
                if beta is not None:
                    full = np.zeros(k)
                    full[at] = beta / sd
                    out.append((symbol, float(means[k] - full @ np.array(means)[:k]), full.tolist()))
            yield pd.DataFrame(out, columns=["symbol", "constant", "beta"])

    fits = _whole_sums(rows, features, target).mapInPandas(fit, "symbol string, constant double, beta array<double>")
    rows = rows.join(fits, "symbol")
    hat = sum((F.element_at("beta", i + 1) * F.col(c) for i, c in enumerate(features)), F.col("constant"))
    return rows.select("symbol", "ts_us", "seq", (F.col(target) - hat).alias("e"))


def ljung_box_section(f: DataFrame, features: list[str], target: str = "r_300s") -> DataFrame:
    out = stats.ljung_box(residuals(f, features, target), ["symbol"], ["ts_us", "seq"], "e", LB_LAGS)
    return out.where("n >= 25").withColumn("autocorrelated", F.col("q") > LJUNG_BOX_CRITICAL)


def regime_section(f: DataFrame, feature: str = "ofi_1", target: str = "r_300s") -> DataFrame:
    return stats.regime_ic(f, ["symbol"], "spread", feature, target)


def partial_r2(f: DataFrame, base: str = "ofi_1", added: str = "depth_imb", target: str = "r_300s") -> DataFrame:
    """(symbol, partial_r2): the share of what `base` leaves unexplained that `added` explains."""
    rows = f.where(finite(base).isNotNull() & finite(added).isNotNull())
    small, large = (stats.ols(rows, ["symbol"], target, xs).select("symbol", "n", F.col("ss_res").alias(n)) for xs, n in (([base], "r"), ([base, added], "u")))
    return small.join(large.drop("n"), "symbol").select("symbol", F.when((F.col("n") >= 6) & (F.col("r") > 0), (F.col("r") - F.col("u")) / F.col("r")).alias("partial_r2"))


def sign_accuracy(f: DataFrame, feature: str = "microprice_dev", target: str = "r_1s") -> DataFrame:
    rows = f.select("symbol", finite(feature).alias("x"), finite(target).alias("y")).where("x <> 0 and y <> 0")
    return rows.groupBy("symbol").agg(F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign_accuracy"))


def hypotheses(f: DataFrame, ic: DataFrame, decay: DataFrame, regimes: DataFrame) -> DataFrame:
    """(symbol, h1..h5): true, false, or null where it cannot be said."""
    h1 = ic.groupBy("symbol").agg(F.bool_or(F.col("ic") > 0.05).alias("h1"))
    h2 = decay.where("feature = 'ofi_1'").select("symbol", ((F.col("tau_star") < 60) & (F.col("r2") > 0.9)).alias("h2"))
    q = regimes.groupBy("symbol").agg(F.max(F.when(F.col("quartile") == 1, F.col("ic"))).alias("q1"), F.max(F.when(F.col("quartile") == 4, F.col("ic"))).alias("q4"))
    out = f.select("symbol").distinct().join(h1, "symbol", "left").join(h2, "symbol", "left").join(partial_r2(f), "symbol", "left").join(q, "symbol", "left").join(sign_accuracy(f), "symbol", "left")
    return out.select("symbol", "h1", "h2", (F.col("partial_r2") > 0.01).alias("h3"), (F.col("q4") < F.col("q1")).alias("h4"), (F.col("sign_accuracy") > 0.55).alias("h5"))


def sections(f: DataFrame, features: list[str] | None = None, returns: list[str] | None = None) -> dict[str, DataFrame]:
    """The report's sections by name, for a feature table (symbol, ts_us, seq, features, returns)."""
    features = [c for c in NAMES if c in f.columns] if features is None else features
    returns = list(HORIZON_S) if returns is None else returns
    ic = ic_section(f, features, returns)
    decay, regimes = decay_section(ic), regime_section(f)
    return {"summary": summary(f), "ic": ic, "decay": decay, "adf": adf_section(f, features), "vif": vif_section(f, features), "ljung_box": ljung_box_section(f, features), "regimes": regimes, "hypotheses": hypotheses(f, ic, decay, regimes)}


def text(parts: dict[str, DataFrame]) -> Iterator[str]:
    """The report's lines, section by section; rows come to the driver one partition at a time."""
    for i, (name, df) in enumerate(parts.items(), 1):
        yield f"{i}. {name}"
        yield "  ".join(df.columns)
        for r in df.orderBy(*[c for c in ("symbol", "feature", "horizon", "quartile", "k") if c in df.columns]).toLocalIterator():
            yield "  ".join("N/A" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
        yield ""


def backtest_text(results: DataFrame, summary: DataFrame) -> Iterator[str]:
    """A backtest's lines: for each instrument its windows, what the thresholds make of them in all, and each window's rows."""
    number = lambda v: "N/A" if v is None else f"{v:+.6f}" if isinstance(v, float) else str(v)
    sections = (
        ("Windows", results.groupBy("symbol", "window_idx").agg(F.first("test_rows").alias("test_rows"), F.first("oos_ic").alias("oos_ic"), F.array_sort(F.collect_list(F.struct("k", "total_pnl_net"))).alias("p"))
         .select("symbol", "window_idx", "test_rows", "oos_ic", F.array_join(F.transform("p", lambda x: F.format_string("k=%.1f %+.6f", x["k"], x["total_pnl_net"])), "  ").alias("net_pnl_by_k")), ["symbol", "window_idx"]),
        ("Thresholds", summary.select("symbol", "k", "n_windows", "avg_oos_ic", "total_pnl_net", "avg_sharpe", "max_drawdown", "avg_turnover", "n_trades"), ["symbol", "k"]),
        ("Rows", results.select("symbol", "window_idx", "k", "n_trades", "total_pnl_net", "max_drawdown", "turnover"), ["symbol", "window_idx", "k"]),
    )
    for i, (name, df, order) in enumerate(sections, 1):
        yield f"{i}. {name}"
        yield "  ".join(df.columns)
        for r in df.orderBy(*order).toLocalIterator():
            yield "  ".join(number(v) for v in r)
        yield ""

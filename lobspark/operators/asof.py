"""Forward as-of join: for each row the first row of its instrument at or after a later time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.operators.segments import cut_points, segment


def forward_asof(df: DataFrame, values: dict[str, Column], after_us: dict[str, int], key: str = "symbol", ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """df with, for each horizon name and value name, `<value>_<horizon>`: the value of the first row at
    or after ts + horizon, the lowest seq first; null if there is none. There is no tolerance.

    One sort of (1 + horizons) rows for each row, and one scan of it from the end, in place of a range join:
    cost does not depend on how many rows lie between. All horizons share one exchange. Long instruments are dealt in segments of
    time, requests by the time they ask for: a segment ends with a row of its own, so the answer is there; requests beyond the last row are left out.
    """
    names = list(values)
    rows = df.withColumns({f"__v_{n}": values[n] for n in names})
    # h: null for data; else the horizon that the row asks for.
    asks = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("h"), F.col(ts).alias("t")), *[F.struct(F.lit(h).alias("h"), (F.col(ts) + us).alias("t")) for h, us in after_us.items()]))
    rows = rows.select(key, ts, seq, *[f"__v_{n}" for n in names]).join(cut_points(df, [key], ts), key, "left")
    both = rows.select(key, ts, seq, "__cuts", "__top", *[f"__v_{n}" for n in names], asks.alias("ask")).where("ask.h is null or (ask.t is not null and coalesce(ask.t <= __top, true))")
    both = both.select(key, ts, seq, segment("ask.t").alias("__seg"), F.col("ask.h").alias("__h"), F.col("ask.t").alias("__t"), *[F.when(F.col("ask.h").isNull(), F.struct(F.col(f"__v_{n}").alias("v"))).alias(f"__v_{n}") for n in names])
    # From the end; data rows at a time come before those that ask for it, the lowest seq last.
    back = W.partitionBy(key, "__seg").orderBy(F.col("__t").desc(), F.col("__h").isNotNull().asc(), F.col(seq).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumns({f"__f_{n}": F.last(f"__v_{n}", ignorenulls=True).over(back)["v"] for n in names}).where("__h is not null")
    wide = seen.groupBy(key, ts, seq).agg(*[F.max(F.when(F.col("__h") == h, F.col(f"__f_{n}"))).alias(f"{n}_{h}") for n in names for h in after_us])
    return df.join(wide, [key, ts, seq], "left")


#: Horizons in microseconds.
HORIZONS = {"1s": 1_000_000, "5s": 5_000_000, "30s": 30_000_000, "300s": 300_000_000}


def labelled(df: DataFrame, mid: str = "mid", spread: str | None = "spread", horizons: dict[str, int] = HORIZONS, signs: tuple[str, ...] = ("1s", "5s")) -> DataFrame:
    """df with forward returns r_<h> and sign labels sign_<h>. Rows whose mid is not positive get no labels but still serve others."""
    found = forward_asof(df, {"__mid": F.col(mid)}, horizons)
    usable = F.col(mid) > 0
    out = found.withColumns({f"r_{h}": F.when(usable, F.try_divide(F.col(f"__mid_{h}") - F.col(mid), F.col(mid))) for h in horizons})
    if spread:
        limit = F.try_divide(0.5 * F.col(spread), F.col(mid))
        out = out.withColumns({f"sign_{h}": F.when(F.col(f"r_{h}") > limit, 1).when(F.col(f"r_{h}") < -limit, -1).when(F.col(f"r_{h}").isNotNull(), 0).cast("byte") for h in signs if h in horizons})
    return out.drop(*[f"__mid_{h}" for h in horizons])

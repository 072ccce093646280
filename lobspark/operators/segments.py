"""Long series in parts: segments of time by quantiles, places of rows across them, and blocks with a halo of their neighbours.

One instrument may hold most of the rows. What looks at an instrument's rows in order is then dealt by (instrument, segment) or
(instrument, block), and what passes from one part to the next is a few numbers a part, or some rows of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Segments of an instrument with more than LEAST rows; smaller ones are one segment.
PARTS, LEAST = 64, 1 << 20


def cut_points(df: DataFrame, keys: list[str], time: str = "ts_us", parts: int | None = None, least: int | None = None) -> DataFrame:
    """(keys, __cuts, __top) of the instruments with more than `least` rows: approximate quantiles of time, each the time of some row, and the
    last time. Of times as whole numbers below 2^53."""
    parts, least = parts or PARTS, LEAST if least is None else least
    quantiles = F.percentile_approx(time, [i / parts for i in range(1, parts)], 10 * parts)
    cuts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), quantiles.alias("__cuts"), F.max(time).alias("__top")).where(F.col("__n") > least).drop("__n")
    # A row for `least` rows at least: small where that is large.
    return F.broadcast(cuts) if least >= 1 << 16 else cuts


def segment(time: str | Column, parts: int | None = None) -> Column:
    """The segment of a time: how many of its instrument's __cuts it is after; 0 where there are none."""
    t = F.col(time) if isinstance(time, str) else time
    # Cuts are sorted, so halving steps find the place. One comparison a cut makes methods that are too long for the JVM to compile.
    steps = [1 << i for i in reversed(range(((parts or PARTS) - 1).bit_length()))] or [1]
    after = lambda i, step: i + F.when(F.get("__cuts", i + step - 1) < t, step).otherwise(0)
    return F.when(F.col("__cuts").isNotNull(), F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), after)).otherwise(0)


def segmented(df: DataFrame, keys: list[str], time: str = "ts_us", parts: int | None = None, least: int | None = None) -> DataFrame:
    """df with __seg, an instrument's segment: which of its approximate quantiles of time a row is after. Rows of one time are together."""
    return df.join(cut_points(df, keys, time, parts, least), keys, "left").withColumn("__seg", segment(time, parts)).drop("__cuts", "__top")


def last_rows(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """(keys, __seg, name): a value of the last row of each segment. First the last time, then, of the few rows there, the last one."""
    by, t = [*keys, "__seg"], order[0]
    tops = rows.groupBy(*by).agg(F.max(t).alias("__t"))
    near = rows.select(*by, *order, value.alias(name)).join(tops, by).where(F.col(t) == F.col("__t"))
    return near.groupBy(*by).agg(F.max_by(name, F.struct(*order)).alias(name))


def lagged(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], parts: int | None = None, least: int | None = None) -> DataFrame:
    """df with, for each name, a column's value in the instrument's row before; null in its first. The first row of a later segment takes
    it from the last row of the segment before."""
    least = LEAST if least is None else least
    rows = segmented(df, keys, order[0], parts, least)
    both = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    ends = last_rows(rows, keys, order, both, "__end")
    ends = ends.select(*keys, "__seg", F.lag("__end").over(W.partitionBy(*keys).orderBy("__seg")).alias("__end")).where("__end is not null")
    ends = F.broadcast(ends) if least >= 1 << 16 else ends  # of instruments in segments alone
    rows = rows.withColumn("__lag", F.lag(both).over(W.partitionBy(*keys, "__seg").orderBy(*order))).join(ends, [*keys, "__seg"], "left")
    before = F.coalesce("__lag", "__end")
    return rows.withColumns({n: before[n] for n in columns}).drop("__seg", "__lag", "__end")


def before_segment(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, __seg, sums): of aggregates that add up, what the segments before each hold; a row a segment."""
    own = df.groupBy(*keys, "__seg").agg(*[v.alias(n) for n, v in sums.items()])
    w = W.partitionBy(*keys).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    return own.select(*keys, "__seg", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])


def placed(df: DataFrame, keys: list[str], order: list[str], valid: dict[str, Column], parts: int | None = None, least: int | None = None) -> DataFrame:
    """df with a column for each name in `valid`: the 0-based place of a row among its instrument's rows for which that holds, null
    where it does not. Running counts within segments, and counts of the segments before."""
    rows = segmented(df, keys, order[0], parts, least)
    run = W.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = {f"__c{i}": F.count(F.when(c, 1)) for i, c in enumerate(valid.values())}
    before = before_segment(rows, keys, counted)
    rows = rows.withColumns({f"__r{i}": F.when(c, F.count(F.when(c, 1)).over(run) - 1) for i, c in enumerate(valid.values())})
    out = rows.join(before, [*keys, "__seg"], "left")  # an instrument without a name is one segment
    out = out.withColumns({n: F.col(f"__r{i}") + F.coalesce(f"__c{i}", F.lit(0)) for i, n in enumerate(valid)})
    return out.drop("__seg", *[f"__{p}{i}" for i in range(len(valid)) for p in ("r", "c")])


def in_blocks(df: DataFrame, place: str, size: int, before: int | Column, after: int = 0) -> DataFrame:
    """df with `block`, a row for each block of `size` places that it is in or near: also the `before` last places before a block and
    the `after` first ones after it; neither may be more than a block. A row is its block's own where place div size = block."""
    before = F.lit(before) if isinstance(before, int) else before
    at, off = F.floor(F.col(place) / size), F.col(place) % size
    near = F.array(at, F.when(off >= size - before, at + 1), F.when((off < after) & (at > 0), at - 1))
    return df.withColumn("block", F.explode(F.filter(near, lambda b: b.isNotNull())))

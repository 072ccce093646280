"""Mixing sources to target weights.

A document's size is its number of words. Sources, by code point with null last, weigh 1, 2, 3 in
turn and share all words; a source's target stops at `most` times its size, and what is over goes to
the others by weight until none is above. That fixed point is min(most * size, level * weight) for one
level, found from sums over the sources in order of most * size / weight: a window over one row a source.

A document is emitted floor(rate) times, plus one Bernoulli copy with probability equal to the fraction: its
draw, hashed from its own id, is below its source's threshold. With the fraction itself as threshold a source of
few or very unequal texts would end far from its target; so the threshold is the one of BINS that brings the
source's words nearest to it, read from a histogram of words by draw. It is near the fraction, the nearer the more
texts there are, and every draw still depends on the document and one number of its source: a source's words
miss its target by half a text or so. Reruns agree; no random state is kept; all that is shuffled is a histogram
a source.

Null texts have size 0; documents of size 0 are taken as often as others, which adds no words. A source
without words has target 0 and rate 0. Repeated ids draw alike, and so do null ids. An empty table gives an
empty result. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.llm.common import WORD, joined_small, settled

SEED = 20_251
#: Bins of the draws.
BINS = 4096


def sized(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    return docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(counts: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from counts (source, words)."""
    per = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size"))
    # Sources before a row, in this order, are those capped if the row's own cap is the first not reached.
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.withColumns(
        {
            "__left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "__weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = F.min(F.when(F.col("__left") * F.col("weight") <= F.col("cap") * F.col("__weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), "__left", "__weight"))).over(everything)
    per = per.withColumn("__level", level)
    target = F.least(F.col("cap").cast("double"), F.col("__level.__left") * F.col("weight") / F.col("__level.__weight"))
    return per.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def uniform(*parts) -> Column:
    """52 bits of a hash of the parts, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cuts(narrow: DataFrame, per: DataFrame) -> DataFrame:
    """(__none, __s, cut): of each source's BINS bins of draws those below cut give a copy; from narrow (__none, __s, size, __u)."""
    keys = ["__none", "__s"]
    bins = narrow.groupBy(*keys, F.floor(F.col("__u") * BINS).alias("bin")).agg(F.sum("size").alias("words"))
    none = per.select(*keys, F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("words"))
    bins = bins.unionByName(none).join(per.select(*keys, "source_size", "rate"), keys)
    upto = F.sum("words").over(W.partitionBy(*keys).orderBy("bin"))
    off = F.abs(upto - (F.col("rate") - F.floor("rate")) * F.col("source_size"))
    return bins.select(*keys, off.alias("off"), (F.col("bin") + 1).alias("cut")).groupBy(*keys).agg(F.min(F.struct("off", "cut"))["cut"].alias("cut"))


def mixed(docs: DataFrame, text: str = "text", id: str = "doc_id", seed: int = SEED, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with size, source_size, target, copies and taken. Their own columns of these names are replaced."""
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    # A null source must find its row: join on (is null, or '').
    keys = {"__none": F.col("source").isNull(), "__s": F.coalesce("source", F.lit(""))}
    base = sized(docs.select(*own), text).withColumns({**keys, "__u": uniform(F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit("")))})
    narrow = settled(base.select("source", "__none", "__s", "size", "__u"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = settled(targets(narrow.groupBy("source").agg(F.sum("size").alias("words")), most, weights).withColumns({**keys, "rate": rate}).drop("source"))
    out = joined_small(base, per.join(cuts(narrow, per), list(keys)), list(keys))
    copies = F.floor("rate") + (F.floor(F.col("__u") * BINS) < F.col("cut")).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*own, "size", "source_size", "target", "copies", "taken")


def emitted(mix: DataFrame) -> DataFrame:
    """A row for each copy taken."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))


def digest(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")

"""Quality rules as a bitmask ledger.

Every rule is evaluated once on each document; the ledger keeps the measurements and one bit a rule
that failed. A policy is a named, versioned mask over the rules: a document is kept if no bit of the
mask is set. Ablations (what each rule alone removes, what would come back without it) are sums over
bits of the ledger; no text is read again. Everything is a DataFrame expression on one row.

Null texts count as empty, and fail `few_words`. Repeated rows stay, each judged alone; an empty table gives no rows;
other columns are ignored; the number of words in a text has no limit. A measure that equals a rule's limit passes. Windows
of three words are told apart by their 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import WORD

#: name, SQL over the measurements that is true if a document fails. A rule's place is its bit; append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("no_letters", "2 * n_letter_words < n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_trigrams"]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = (
    Policy("base", 1, ("few_words", "repeated_trigrams")),
    Policy("web", 1, tuple(name for name, _ in RULES)),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letter_words", "n_repeat_words")


def _measured(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__t", t).withColumn("__w", F.regexp_extract_all("__t", F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD)))
    # A three-word window is a 64-bit hash of its words in turn; (hash, place) sorted puts equal windows side by side.
    df = df.withColumn("__g", F.expr("if(size(__w) < 3, array(), transform(slice(__w, 1, size(__w) - 2), (w, i) -> xxhash64(w, element_at(__w, i + 2), element_at(__w, i + 3))))"))
    return df.withColumns(
        {
            "n_words": F.expr("bigint(size(__w))"),
            "word_chars": F.expr("bigint(length(translate(__t, ' \\t\\n\\u000B\\u000C\\r', '')))"),
            "n_symbols": F.expr("bigint(length(__t) - length(translate(__t, '#*$%&|<>', '')))"),
            "n_lines": F.expr("bigint(size(__l))"),
            "n_dup_lines": F.expr("bigint(size(__l) - size(array_distinct(__l)))"),
            "n_letter_words": F.expr("bigint(size(filter(__w, w -> w rlike '\\\\p{L}')))"),
            "n_repeat_words": F.expr("if(size(array_distinct(__g)) = size(__g), 0L, bigint(size(array_distinct(flatten(transform(" + REPEATED + ", p -> array(p, p + 1, p + 2)))))))"),
        }
    ).drop("__t", "__w", "__l", "__g")


#: SQL: places of the windows whose hash occurs twice or more.
_SORTED = "array_sort(transform(__g, (g, i) -> struct(g as g, i as i)))"
REPEATED = (
    f"transform(filter(transform(array({_SORTED}), s -> transform(s, (x, j) -> struct(x.i as i, (x.g = get(s, j - 1).g or x.g = get(s, j + 1).g) as twice)))[0], x -> x.twice), x -> x.i)"
)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failed`, the bits of the rules that it fails."""
    bits = [f"if({rule}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES)]
    # A zero that the optimizer takes for non-deterministic: it keeps filters on `failed` above this projection.
    # Pushed below, they would repeat the measurements in every place that a rule names one.
    zero = "shiftright(monotonically_increasing_id(), 63)"
    return _measured(docs, text).withColumn("failed", F.expr(" | ".join([*bits, zero])))


def kept(policy: Policy) -> Column:
    return F.expr(f"(failed & {policy.mask}L) = 0")


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """From a ledger, one row a policy and rule: documents removed, those that fail the rule, and
    those that fail only it and would come back without it. One pass, one row a task shuffled."""
    aggs = []
    for p in policies:
        aggs.append(F.sum(F.expr(f"bigint((failed & {p.mask}L) != 0)")).alias(f"{p.name}:{p.version}:removed"))
        for r in p.rules:
            aggs.append(F.sum(F.expr(f"bigint((failed & {BIT[r]}L) != 0)")).alias(f"{p.name}:{p.version}:{r}:failed"))
            aggs.append(F.sum(F.expr(f"bigint((failed & {p.mask}L) = {BIT[r]}L)")).alias(f"{p.name}:{p.version}:{r}:only"))
    one = book.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = [
        f"struct('{p.name}' as policy, {p.version} as version, '{r}' as rule, n as n_docs, coalesce(`{p.name}:{p.version}:removed`, 0L) as n_removed, coalesce(`{p.name}:{p.version}:{r}:failed`, 0L) as n_failed, coalesce(`{p.name}:{p.version}:{r}:only`, 0L) as n_only)"
        for p in policies
        for r in p.rules
    ]
    return one.select(F.expr(f"inline(array({', '.join(rows)}))"))


def digest(docs: DataFrame, policy: Policy = POLICIES[1]) -> DataFrame:
    book = ledger(docs.select("doc_id", "text"))
    base_failed = F.expr(f"(failed & {BASE}L) != 0")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & kept(policy)).alias("kept"), "n_lines", "n_letter_words", F.col("failed").alias("failed_rules"))

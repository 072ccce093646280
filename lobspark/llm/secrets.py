"""Secret scan: fixed patterns, and a battery of randomness tests for what no pattern names.

Everything is a DataFrame expression on one row; nothing but the histogram is shuffled.

Base kinds: assign, access, hex (leftmost, not overlapping within a kind). The battery adds kind
`random`: runs of 16 or more characters of a printable encoding that hold letters and digits and
overlap no base span; a run ends at '=', so that a key and its value are apart. For each the encoding is
inferred (lower or upper hex, base32, base36, base62, base64), each character becomes its index in that
alphabet, and three tests are made: chi-squared over the alphabet, runs, and lag-1 serial correlation.
Each test is read twice. Against "drawn uniformly", Fisher's method combines the p-values, and tokens
that the battery rejects at `alpha` are out. Against natural names (letters as frequent as in text, digits
and letters that keep to themselves, neighbours that are alike), a weighed sum of the tests' normal scores
gives `p_text`, the chance that a name looks that random.

False discoveries are counted on p_text over the whole corpus, by class of length, as long tokens tell more
than short ones: a first pass makes one histogram of p_text a class (at most BINS * CLASSES rows), from which
the Benjamini-Hochberg step with an estimate of the share of names sets the class's threshold at level `fdr`;
p_text must be at most `level` in any case, so that names are left alone where keys are many. So a document with many keys finds them all. The second pass applies the thresholds.

Null texts count as empty. No row is dropped; repeated rows stay, and count again; an empty table gives an empty
result; other columns stay, but one named secrets is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.llm.common import settled

#: The base patterns, with the least length of the part that counts.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: A candidate: a whole run of the characters of printable encodings, neither word nor number.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Of natural names: the chance that two letters agree, that a digit and a letter are neighbours at a place, and the correlation of neighbours.
NATURAL = 0.065
NEIGHBOURS = 0.12
ALIKE = 0.35
#: What the serial correlation weighs beside the other two tests.
SERIAL = 0.5
#: Least lengths of the classes; bins of p_text, so many to a factor of two.
CLASSES = (16, 20, 24, 32, 48, 96)
BINS, FINE = 320, 8


SPAN = "array<struct<s:int,e:int,t:string>>"


def located(text: str, pattern: str) -> Column:
    """array<struct<s,e,t>> of a pattern's matches in a column: code points, end exclusive."""
    t = F.col(text)
    pairs = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("t"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    found = F.aggregate(F.filter(pairs, lambda x: x["t"].isNotNull()), start, add, lambda acc: acc["out"])
    return F.when(t.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def normal_tail(z: str) -> str:
    """SQL for P(Z > z) of a standard normal Z (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    poly = f"({t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"
    upper = f"(exp(-{z} * {z} / 2) * 0.3989422804014327D * {poly})"
    return f"greatest(if({z} >= 0, {upper}, 1 - {upper}), 1e-300D)"


def _map(array: str, keep: str, **fields: str) -> str:
    """SQL: of each element x the fields to keep, and further ones. A pass of its own, so that none is worked out twice."""
    return f"transform({array}, x -> struct({', '.join([f'x.{k} as {k}' for k in keep.split()] + [f'{v} as {k}' for k, v in fields.items()])}))"


#: SQL, to be closed: characters' indices, each with the one after it.
NEXT = "zip_with(slice(x.idx, 1, size(x.idx) - 1), slice(x.idx, 2, size(x.idx) - 1)"


def battery(tokens: str) -> str:
    """SQL: candidates (s, e, t) with p_random, the battery's combined p-value, p_text, that of a natural name
    as random, and n, the length."""
    enc = "case when x.t rlike '^[0-9a-f]+$' then 'hex' when x.t rlike '^[0-9A-F]+$' then 'HEX' when x.t rlike '^[A-Z2-7]+$' then 'base32' when x.t rlike '^[0-9A-Z]+$' then 'base36' when x.t rlike '^[0-9A-Za-z]+$' then 'base62' else 'base64' end"
    abc = f"element_at(map({', '.join(repr(y) for kv in ALPHABETS.items() for y in kv)}), {enc})"
    q = f"filter(transform({tokens}, x -> struct(x.s as s, x.e as e, rtrim('=', translate(x.t, '-_', '+/')) as t)), x -> x.t rlike '[A-Za-z]' and x.t rlike '[0-9]' and length(x.t) >= 16)"
    q = _map(q, "s e t", abc=abc)
    q = _map(q, "s e t abc", n="double(length(x.t))", k="double(length(x.abc))", idx="transform(split(x.t, ''), c -> instr(x.abc, c) - 1)", counts="transform(split(x.abc, ''), c -> double(length(x.t) - length(replace(x.t, c, ''))))")
    q = _map(
        q,
        "s e n k idx",
        pairs="aggregate(x.counts, 0D, (a, c) -> a + c * (c - 1))",
        high="double(size(filter(x.idx, i -> 2 * i >= x.k)))",
        runs=f"1D + size(filter({NEXT}, (a, b) -> (2 * a >= x.k) != (2 * b >= x.k)), y -> y))",
        mean="aggregate(x.idx, 0D, (a, i) -> a + i) / x.n",
        turns="double(regexp_count(x.t, '[0-9][A-Za-z]') + regexp_count(x.t, '[A-Za-z][0-9]'))",
    )
    q = _map(q, "s e n k idx pairs high runs mean turns", var="aggregate(x.idx, 0D, (a, i) -> a + (i - x.mean) * (i - x.mean))", cov=f"aggregate({NEXT}, (a, b) -> (a - x.mean) * (b - x.mean)), 0D, (a, y) -> a + y)", rm="1 + 2 * x.high * (x.n - x.high) / x.n", kap=f"greatest({NATURAL}D, 2 / x.k)")
    q = _map(
        q,
        "s e n",
        z1="(x.k * x.pairs / x.n + x.k - x.n - (x.k - 1)) / sqrt(2 * (x.k - 1) * (1 - 1 / x.n))",
        z2="if(x.rm <= 2, 40D, abs(x.runs - x.rm) / sqrt((x.rm - 1) * (x.rm - 2) / (x.n - 1)))",
        z3="if(x.var <= 0, 40D, abs(x.cov / x.var + 1 / x.n) * sqrt(x.n))",
        z4="(x.n * (x.n - 1) * x.kap - x.pairs) / sqrt(2 * x.n * (x.n - 1) * x.kap * (1 - x.kap) + x.n * (x.n - 1) * (x.n - 2) * x.kap * x.kap)",
        z5=f"(x.turns - (x.n - 1) * {NEIGHBOURS}D) / sqrt((x.n - 1) * {NEIGHBOURS * (1 - NEIGHBOURS)}D)",
        z6=f"if(x.var <= 0, -40D, ({ALIKE}D - x.cov / x.var) * sqrt(x.n))",
    )
    text = f"((x.z4 + x.z5 + {SERIAL}D * x.z6) / {(2 + SERIAL**2) ** 0.5}D)"
    q = _map(q, "s e n", t1=f"-ln({normal_tail('x.z1')}) - ln(least(1D, 2 * {normal_tail('x.z2')})) - ln(least(1D, 2 * {normal_tail('x.z3')}))", p_text=normal_tail(text))
    return f"transform({q}, x -> struct(x.s as s, x.e as e, x.n as n, exp(-x.t1) * (1 + x.t1 + x.t1 * x.t1 / 2) as p_random, x.p_text as p_text))"


#: SQL of a token x: its class of length, and the bin of its p_text.
CLASS = "case " + " ".join(f"when x.n >= {low} then {i}" for i, low in reversed(list(enumerate(CLASSES)))) + " end"
BIN = f"int(least({BINS - 1}, floor(-{FINE} * log2(x.p_text))))"


def tokens(docs: DataFrame, text: str, alpha: float) -> DataFrame:
    """docs with base spans and `__token`: the candidates that the battery takes for random (s, e, class, bin)."""
    text_ = "__text"
    df = docs.withColumn(text_, F.coalesce(F.col(text), F.lit("")))
    # Equal to matching the whole run and dropping short ones: a shorter rest of a run never matches.
    df = df.withColumns({"__assign": located(text_, ASSIGN), "__access": located(text_, ACCESS[:-1] + "{16,}"), "__hex": located(text_, HEX[:-1] + "{24,}")})
    df = df.withColumn("__assign", F.filter("__assign", lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= 6))
    df = df.withColumn("__token", located(text_, TOKEN)).withColumn("__base", F.concat("__assign", "__access", "__hex"))
    df = df.withColumn("__token", F.expr("filter(__token, x -> not exists(__base, b -> b.s < x.e and x.s < b.e))"))
    empty = "cast(array() as array<struct<s:int,e:int,class:int,bin:int>>)"
    found = f"transform(filter({battery('__token')}, x -> x.p_random >= {alpha}D), x -> struct(x.s as s, x.e as e, {CLASS} as class, {BIN} as bin))"
    return df.withColumn("__token", F.expr(f"if(size(__token) = 0, {empty}, {found})")).drop("__base", text_)


def thresholds(found: DataFrame, fdr: float, level: float) -> dict[int, int]:
    """For each class of length the least bin that is reported, from documents with `__token`; a class without discoveries has none."""
    # One row a class and bin, map-side combined.
    bins = found.select(F.explode("__token").alias("x")).groupBy("x.class", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    whole, above = W.partitionBy("class"), W.partitionBy("class").orderBy(F.col("bin").desc())
    bins = bins.withColumns({"all": F.sum("n").over(whole), "names": F.sum(F.when(F.col("bin") < FINE, F.col("n")).otherwise(0)).over(whole), "found": F.sum("n").over(above)})
    # Of names, half have p_text above 1/2.
    names = F.least(F.col("all"), 2 * F.col("names") + 1)
    good = bins.where(F.pow(F.lit(2.0), -F.col("bin") / FINE) <= level).where(names * F.pow(F.lit(2.0), -F.col("bin") / FINE) <= fdr * F.col("found"))
    return {r["class"]: r["bin"] for r in good.groupBy("class").agg(F.min("bin").alias("bin")).collect()}  # a row a class


def scan(docs: DataFrame, text: str = "text", alpha: float = 1e-4, fdr: float = 0.02, level: float = 0.01) -> DataFrame:
    """docs with `secrets`: array<struct<kind,s,e>> by start, then kind as in KINDS. Texts are read twice, so that none is stored."""
    return reported(tokens(docs, text, alpha), thresholds(tokens(docs.select(text), text, alpha), fdr, level))


def reported(df: DataFrame, least: dict[int, int]) -> DataFrame:
    """df (from tokens) with `secrets`: base spans, and the candidates that reach their class's threshold."""
    passed = " or ".join(f"x.class = {c} and x.bin >= {b}" for c, b in sorted(least.items())) or "false"
    df = df.withColumn("__random", F.expr(f"filter(__token, x -> {passed})"))
    each = ", ".join(f"transform(__{k}, x -> struct(x.s as s, {i} as o, x.e as e))" for i, k in enumerate(KINDS))
    df = df.withColumn("secrets", F.expr(f"transform(array_sort(concat({each})), x -> struct(element_at(array({', '.join(repr(k) for k in KINDS)}), x.o + 1) as kind, x.s as s, x.e as e))"))
    return df.drop(*[f"__{k}" for k in (*KINDS, "token")])


def joined(kinds: str) -> str:
    """SQL: kind:start:end of the secrets of some kinds, comma-joined."""
    return f"array_join(transform(filter(secrets, x -> x.kind in ({kinds})), x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def digest(docs: DataFrame, alpha: float = 1e-4, fdr: float = 0.02, level: float = 0.01) -> DataFrame:
    """doc_id, counts and spans of the base kinds, and all spans. Texts are read once: spans and candidates are kept, which are small."""
    marked = settled(tokens(docs.select("doc_id", "text"), "text", alpha).drop("text"))
    found = reported(marked, thresholds(marked, fdr, level))
    counts = [F.expr(f"bigint(size(filter(secrets, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in KINDS]
    base = ", ".join(repr(k) for k in KINDS[:3])
    return found.select("doc_id", *counts[:3], F.expr(f"sha2({joined(base)}, 256)").alias("base_sha256"), F.expr(joined(", ".join(map(repr, KINDS)))).alias("spans"), counts[3])

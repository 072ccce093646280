"""The corpus pipeline against a brute-force version of its stages."""

import hashlib
from collections import Counter

import corpus_pipeline
from lobspark.llm import mixing, packing, pii, quality

from tests.llm.test_neardup import near
from tests.llm.test_operators import SF, WORD, slow_targets, texts_of


def test_pipeline(spark):
    import duckdb

    docs = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet' order by doc_id").fetchall()
    kept = {r.doc_id for r in quality.ledger(spark.read.parquet(f"{SF}/documents.parquet")).where(quality.kept(quality.POLICIES[1])).collect()}
    docs = [d for d in docs if d[0] in kept]
    top = near({i: x for i, x, _ in docs})
    docs = [d for d in docs if top[d[0]] == d[0]]
    docs = [(i, pii.redact(t), s) for i, t, s in docs]
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t))
    target = slow_targets(sizes)
    want, taken = Counter(), Counter()
    unit = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:13], 16) / 2**52
    part = {s: target[s] / n - int(target[s] / n) for s, n in sizes.items()}
    draws = {s: Counter() for s in sizes}
    for i, t, s in docs:
        draws[s][int(unit(f"{mixing.SEED}:{i}") * mixing.BINS)] += len(WORD.findall(t))
    cut = {s: min((abs(sum(n for b, n in draws[s].items() if b < c) - part[s] * sizes[s]), c) for c in {0, *(b + 1 for b in draws[s])})[1] for s in sizes}
    for i, t, s in docs:
        n = len(WORD.findall(t))
        copies = int(target[s] / sizes[s]) + (int(unit(f"{mixing.SEED}:{i}") * mixing.BINS) < cut[s])
        taken[s] += copies * n
        for k in range(-(-n // 2048)):
            want[i, k, min(2048, n - 2048 * k)] += copies
    longest = {s: max(len(WORD.findall(t)) for _, t, o in docs if o == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    got = Counter((r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want
    assert texts_of() and packing.boundaries(Counter(k[2] for k in got.elements()), 16)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_nulls_repeats_and_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.limit(1).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars")
    some = docs.union(docs).union(odd.to(docs.schema)).union(odd.to(docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    plain = ids(docs)
    # Rules judge each row alone, and a row without a text has too few words.
    good = ids(corpus_pipeline.good(spark, docs, SF))
    assert good and ids(corpus_pipeline.good(spark, some, SF)) == good + good
    # Of equal texts one row stays, and of those without a text one.
    alone = ids(corpus_pipeline.distinct(spark, docs, SF))
    assert ids(corpus_pipeline.distinct(spark, some, SF)) == alone + Counter([None])
    # Personal data goes row by row.
    assert ids(corpus_pipeline.private(spark, some, SF)) == plain + plain + Counter([None, None])
    # The mix takes whole copies: equal rows equally often, and none of a row without words.
    taken = ids(corpus_pipeline.mixture(spark, some, SF))
    assert taken[None] == 0 and all(n % 2 == 0 for n in taken.values())
    # Every row with words is cut into its pieces.
    pieces = Counter((r.doc_id, r.piece) for r in corpus_pipeline.packs(spark, some, SF).collect())
    assert pieces == Counter({k: 2 * n for k, n in Counter((r.doc_id, r.piece) for r in corpus_pipeline.packs(spark, docs, SF).collect()).items()})

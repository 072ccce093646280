"""The pipeline's near-duplicate stage: five-word shingles, similarity 0.8 or more."""

import random
from collections import Counter

import corpus_pipeline


def _words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]


def _stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.distinct(spark, docs, "").collect())


def test_near_copies_are_removed_and_others_stay(spark):
    rows, want = [], set()
    for g in range(30):
        base = _words(g, 200)
        near, far = list(base), list(base)
        near[20], near[90] = "changed", "words"  # 186 of 206 shingles: 0.90
        for k in range(20, 200, 25):
            far[k] = f"other{k}"  # similarity about 0.66
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(near)), (3 * g + 2, " ".join(far))]
        want |= {3 * g, 3 * g + 2}
    assert {i for _, i, _ in _stage(spark, rows)} == want


def test_unlike_short_texts_stay(spark):
    rows = [(i, " ".join(_words(1000 + i, 12))) for i in range(40)]
    assert len(_stage(spark, rows)) == 40


def test_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(_words(k, 60)) for k in (1, 2, 3, 4))
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, a), (3, None), (4, " "), (None, d)]
    assert _stage(spark, rows) == [(False, 1, a), (False, 1, b), (False, 3, ""), *sorted([(True, 0, c), (True, 0, d)])]
    assert _stage(spark, []) == []


def near(texts):
    """By brute force: the smallest id that links of similarity 0.8 reach, for each id."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    where, shared, up = {}, Counter(), {i: i for i in sets}
    for i, s in sorted(sets.items()):
        for x in s:
            for j in where.setdefault(x, []):
                shared[j, i] += 1
            where[x].append(i)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def test_against_every_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = near({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    got = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()}
    assert got == {i for i, j in want.items() if i == j} and len(got) < len(want)


def test_recall_at_the_threshold(spark):
    """Pairs at similarity 0.80 to 0.82: at least 0.9 of them are found (measured: 0.94 of 600 at 0.81, 0.92 of 600 at 0.80)."""
    rows = []
    for g in range(200):
        base = _words(5000 + g, 196)
        far = list(base)
        for k in (20, 60, 100, 140):
            far[k] = f"x{k}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(far))]  # 172 of 212 shingles: 0.81
    assert len(_stage(spark, rows)) <= 400 - 0.9 * 200


def test_a_group_with_unlike_leads(spark):
    """Texts whose smallest candidates are not similar enough are held against the others."""
    rows, base = [], _words(77, 300)
    for g in range(12):
        one = list(base)
        for k in range(3, 300, 40):
            one[k] = f"g{g}k{k}"  # versions at 0.75 or so of one another
        two = [*one[:150], "changed", *one[151:]]
        rows += [(g, " ".join(one)), (100 + g, " ".join(two))]
    want = near(dict(rows))
    assert [i for _, i, _ in _stage(spark, rows)] == sorted(i for i, j in want.items() if i == j)


def test_pairs_are_held_against_all_bits_where_they_meet(spark):
    """Of a group that meets on one table, only pairs near in all bits come out, tied to the node of the largest rank."""
    from lobspark.llm import simhash

    r = random.Random(5)
    rows = []
    for i in range(60):
        others = [r.getrandbits(40) if i % 3 else 7 << k % 3 for k in range(3)]  # every third alike, the others not
        fp = 0x5A5A5A5A5A ^ (1 << i % 40)
        rows.append((0, i, fp, i, 1000 - abs(i - 30), [fp, *others]))
    reps = spark.createDataFrame(rows, "table int, node long, fp long, mark long, rank long, prints array<long>")
    loose = {(x.u, x.v) for x in simhash.links(reps, 4, bits=40, tables=1, out="across").collect()}
    near = lambda u, v: sum((a ^ b).bit_count() for a, b in zip(rows[u][5], rows[v][5], strict=True)) <= 20
    tight = [(x.u, x.v) for x in simhash.links(reps, 4, bits=40, tables=1, out="across", most=20).collect()]
    assert set(tight) == {p for p in loose if near(*p)} and 0 < len(set(tight)) < len(loose)
    assert all(rows[u][4] > rows[v][4] or rows[u][4] == rows[v][4] and u < v for u, v in loose)


def test_only_those_that_meet_are_sent_on(spark):
    """a fingerprint goes to its routes in a few packed bytes, and on, with its prints, only from routes where it met another."""
    from pyspark.sql import functions as F

    from lobspark.llm import simhash

    r = random.Random(11)
    fps = [[r.getrandbits(40) for _ in range(3000)] for _ in range(2)]
    for t in fps:
        t[:20] = [t[0] ^ (1 << k) for k in range(20)]  # within two bits of one another, as of the first alone are not
    rows = [(t, i, x) for t in range(2) for i, x in enumerate(fps[t])]
    reps = spark.createDataFrame(rows, "table int, node long, fp long").coalesce(1)
    runs = simhash.routed(reps.selectExpr("cast(table as long) as route", "node", "fp"), 0, 4, 40, 2)
    n, size = runs.agg(F.sum("n"), F.sum(F.length("run"))).first()
    assert n == 11 * len(rows) and size < 12 * n
    again = simhash.routed(simhash.routed(reps.selectExpr("cast(table as long) as route", "node", "fp"), 0, 2, 40, 2), 2, 4, 40, 2)
    unpacked = lambda df: Counter((x.route, *p) for x in df.collect() for p in zip(*simhash._unpacked(x.run, x.n, 2), strict=True))
    assert unpacked(runs) == unpacked(again)
    got = Counter()
    for x in simhash.places(reps, lead=4, bits=40, tables=2).collect():
        assert (x.fp, x.level) == (fps[x.route >> 4][x.node], 4)
        got[x.route >> 4, x.node] += x.met
    masks = [int(m) for m in simhash.flips(40, 2)]
    want = Counter()
    for t in range(2):
        on = Counter(x ^ m for x in fps[t] for m in masks)
        for i, x in enumerate(fps[t]):
            want[t, i] = sum(on[x ^ m] - 1 for m in masks)
    assert got == +want and len(got) < 200


def test_more_pairs_than_are_broadcast(spark, monkeypatch):
    """pairs are taken in rounds, so that texts outside a pair are never shuffled; no pair is lost."""
    from lobspark.llm import neardup

    texts = [" ".join(_words(g, 60)) for g in range(40)]
    docs = spark.createDataFrame([(i, texts[i // 2]) for i in range(80)], "row long, text string")
    pairs = spark.createDataFrame([(2 * g + 1, 2 * g) for g in range(40)] + [(2 * g, (2 * g + 3) % 80) for g in range(40)], "row long, lead long")
    monkeypatch.setattr(neardup, "PAIRS", 15)
    found = neardup._verified(pairs, docs)
    assert sorted((x.row, x.lead) for x in found.collect()) == [(2 * g + 1, 2 * g) for g in range(40)]

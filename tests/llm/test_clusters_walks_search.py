"""Centroid clustering, edit-walk fingerprints and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lobspark.llm import bmw, editwalk, hamerly
from lobspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EDGES = [None, "", " \n\t ", "one", "A a", "same words here now", "same words here now", "x" * 50_000, "word " * 30_000, "é ß É \U0001f600 tail", "a\x0bb_c-d\x7fe", "Straße straße STRASSE"]


def documents(spark, texts, ids=None):
    rows = [(i, t, "a", "b", 3) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, term string, rank string, score int")


# --- 11 ------------------------------------------------------------------------------------------------

def lloyd(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [e for _, e in first]
    nearest = lambda e: min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(e, c[j], strict=True)), j))
    for _ in range(rounds):
        at = [nearest(e) for _, e in kept]
        for j in set(at):
            own = [e for (_, e), a in zip(kept, at, strict=True) if a == j]
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, j, sum((a - b) ** 2 for a, b in zip(e, c[j], strict=True))) for i, e in kept for j in [nearest(e)]]
    by = Counter()
    for _, j, d in out:
        by[j] += d
    return sorted(((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


def vectors(seed, n, spread, groups=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    return [(i, [float(np.float32(x)) for x in centres[i % groups] + spread * rng.normal(size=64)]) for i in range(n)]


FIXTURES = {
    "clustered": vectors(1, 300, 0.1),
    "scattered": vectors(2, 200, 3.0),
    "repeated": [(i % 5, [float(i % 3 == j % 3) for j in range(64)]) for i in range(40)],  # ties, equal ids, equal centroids
    "few": vectors(3, 5, 1.0),
    "bad": [*vectors(4, 30, 1.0), (100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, [float("nan")] + [1.0] * 63), (104, [float("-inf")] + [0.0] * 63), (105, [None] + [1.0] * 63), (106, []), (None, [0.5] * 64), (107, [0.0] * 64)],
    "none": [],
}


@pytest.mark.parametrize("name", FIXTURES)
def test_clusters(spark, name):
    table = spark.createDataFrame([(i, e, 1, "x") for i, e in FIXTURES[name]], "vec_id long, embedding array<float>, cluster int, upper string")
    got = hamerly.digest(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(FIXTURES[name])


def test_bounds_spare_scans_and_change_nothing():
    x = np.floor(np.array([e for _, e in vectors(5, 4000, 0.2, 16)]) * 64).astype(np.int64)
    c = x[:16].copy()
    near, upper, lower = hamerly.scanned(x, c)
    scans = []
    for _ in range(5):
        new = np.stack([x[near == j].sum(axis=0) // max((near == j).sum(), 1) if (near == j).any() else c[j] for j in range(16)])
        drift, c = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)), new
        near, upper, lower, n = hamerly.reassigned(x, near, upper, lower, c, drift)
        scans.append(n)
        exact, own, second = hamerly.scanned(x, c)
        assert (near == exact).all() and (upper >= own * (1 - 1e-9)).all() and (lower <= second * (1 + 1e-9)).all()
    assert scans[-1] < len(x) / 4


def test_a_component_beyond_64_bits_stops(spark):
    with pytest.raises(Exception, match="too large"):
        hamerly.digest(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


# --- 12 ------------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    """Tick by tick."""
    if not text:
        return bytes(editwalk.WALKS * editwalk.SLOTS)
    rng, out = np.random.default_rng(editwalk.SEED), []
    points = [ord(ch) for ch in text]
    for w in range(editwalk.WALKS):
        coins = rng.random((editwalk.CLASSES, editwalk.PERIOD)) < 0.5
        shown, i, tick = [], 0, 0
        while i < len(points):
            shown.append(i)
            i += bool(coins[(points[i] * editwalk.ODD & 0xFFFFFFFF) >> 24, tick % editwalk.PERIOD])
            tick += 1
        for s in range(w * editwalk.SLOTS, (w + 1) * editwalk.SLOTS):
            at = shown[max(r for r in editwalk._RECORDS[s].tolist() if r < tick)]
            gram = (points[at : at + editwalk.GRAM] + [0] * editwalk.GRAM)[: editwalk.GRAM]
            h = sum(p * int(g) for p, g in zip(gram, editwalk._GAINS[s], strict=True)) % 2**64
            out.append(((h ^ h >> 29) * 0x9E3779B97F4A7C15 % 2**64) >> 56)
    return bytes(out)


def slow_compared(docs):
    order = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        take = len(t) // 3
        edit = t[: len(t) - take] + after[:take]
        a, b, c = map(slow_fingerprint, (t, edit, after))
        same = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), a.hex(), b.hex(), same(a, b), same(a, c)))
    return sorted(out, key=repr)


TEXTS = [t[0] for t in duckdb.sql(f"select text from '{SF}/documents.parquet' where length(text) < 3000 order by doc_id limit 60").fetchall()]


@pytest.mark.parametrize("docs", [list(enumerate(EDGES)), [(i * 7 % 60, t) for i, t in enumerate(TEXTS)], [(1, "only one text")], [(5, "twice"), (5, "twice"), (None, "no id"), (9, "last")], []], ids=["edges", "texts", "one", "repeated", "none"])
def test_edit_walks(spark, docs):
    # The longest edge is left to a shorter copy of itself: a tick at a time is slow.
    docs = [(i, t[:4000] if t else t) for i, t in docs]
    got = editwalk.digest(documents(spark, [t for _, t in docs], [i for i, _ in docs])).drop("bands_edited", "bands_next")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_compared(docs)


def test_a_long_text_is_walked_whole(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=300_000))
    whole, cut, edit = (editwalk.Walked.of(t).fingerprint for t in (text, text[:290_000], text[:299_000] + "zz" * 500))
    assert editwalk._walk(bytes(range(256)) * 40, editwalk._HANDS[0], 3, 1000) == editwalk._walk(bytes(range(256)) * 40, editwalk._HANDS[0], 3)
    assert 0.9 < editwalk.likeness(whole, cut) < 1 and editwalk.likeness(whole, edit) > 0.95


def edited(text, n, rng):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([[], [chars[k], "q"], ["q"]])
    return "".join(chars)


def test_likeness_falls_with_edits_and_not_with_their_place():
    rng, means = random.Random(2), []
    for n in (1, 5, 20, 80):
        pairs = [(t, edited(t, n, rng)) for t in TEXTS if len(t) > 800]
        means.append(np.mean([editwalk.likeness(editwalk.Walked.of(a).fingerprint, editwalk.Walked.of(b).fingerprint) for a, b in pairs]))
    assert means[0] > 0.97 and means == sorted(means, reverse=True) and means[-1] > 0.2
    long = [t for t in TEXTS if len(t) > 800]
    others = [editwalk.likeness(editwalk.Walked.of(a).fingerprint, editwalk.Walked.of(b).fingerprint) for a, b in zip(long, long[1:], strict=False)]
    assert np.mean(others) < 0.1


def test_the_edit_is_nearer_than_the_next(spark):
    got = QUERIES["op12_editwalk"](spark, SF).collect()
    long = [r for r in got if r["n_chars"] > 300]
    assert len(got) == 200 and np.mean([r["near_edited"] > r["near_next"] or r["near_next"] > 0.6 for r in long]) > 0.99
    assert 0.55 < np.mean([r["near_edited"] for r in long]) < 0.8
    assert all(r["bands_edited"] == 32 for r in got if r["near_edited"] == 1)


def test_bands_find_the_pairs_that_all_pairs_give(spark):
    rng = random.Random(3)
    texts = [t for t in TEXTS if len(t) > 400][:25]
    texts += [edited(t, max(1, len(t) // 300), rng) for t in texts] + texts[:5]
    fps = [editwalk.Walked.of(t).fingerprint for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if editwalk.likeness(fps[i], fps[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["id"]: r["component"] for r in editwalk.near_duplicates(documents(spark, texts)).collect()}
    same = sum(got[i] == root[i] for i in range(len(texts)))
    assert len(set(root)) < len(texts) and same >= 0.98 * len(texts)
    assert editwalk.near_duplicates(documents(spark, ["alone", "", None])).count() == 3


# --- 13 ------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def slow_search(docs, items, k=50):
    low = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(low(t)), len(low(t))) for i, t in docs if low(t)]
    N, L = len(counts), sum(n for *_, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 50 + (50 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(low(text)) if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def items_of(spark, texts):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in texts], "item_id long, text string, doc_id int, shard string")


@pytest.mark.parametrize("shard", [1, 300, 10**6])
def test_search(spark, shard):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i * 31 % 1009, " ".join(rng.choices(words, k=rng.choice([3, 30, 120])))) for i in range(400)]
    docs += list(zip(range(2000, 2100), EDGES, strict=False)) + [(None, "w1 w2"), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2")] + [(3000 + i, "w1 same") for i in range(90)]
    items = [(1, "w1"), (2, "W1 w2, w1!"), (3, "w7 w11 w12 w400 w5"), (4, "nowhere"), (5, None), (6, ""), (7, "É é straße"), (8, "same"), (8, "same"), (None, "w3"), (9, " ".join(words[:200]))]
    index = bmw.built(documents(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3), shard=shard)
    assert sorted((tuple(r) for r in bmw.searched(bmw.opened(spark, index.path), items_of(spark, items)).collect()), key=repr) == slow_search(docs, items)


def test_search_over_nothing(spark):
    assert bmw.digest(documents(spark, []), items_of(spark, [(1, "a")])).collect() == []
    assert bmw.digest(documents(spark, [None, ""]), items_of(spark, [(1, "a")])).collect() == []
    assert bmw.digest(documents(spark, ["a"]), items_of(spark, [])).collect() == []


def test_queries_come_in_blocks(spark, monkeypatch):
    docs, items = [(i, f"a b{i % 3} c{i % 7}") for i in range(50)], [(i, f"b{i % 3} c{i % 5}") for i in range(9)]
    monkeypatch.setattr(bmw, "QUERIES", 4)
    assert sorted((tuple(r) for r in bmw.digest(documents(spark, [t for _, t in docs]), items_of(spark, items)).collect()), key=repr) == slow_search(docs, items)


def test_boundaries_cost_least():
    rng = np.random.default_rng(5)
    for n in (1, 7, 8, 9, 40, 100):
        impacts = rng.integers(1, 1000, n)
        cost = lambda ends: sum((b - a) * int(impacts[a:b].max()) + 700 for a, b in zip([0, *ends], ends, strict=False))  # noqa: B023, E731
        ends = bmw.boundaries(impacts, 700, 8, 64).tolist()
        cuts = list(range(8, n, 8))
        best = min(cost([c for j, c in enumerate(cuts) if mask >> j & 1] + [n]) for mask in range(1 << len(cuts))) if len(cuts) < 13 else None
        assert ends[-1] == n and cost(ends) == best


def test_blocks_are_skipped():
    rng, n = np.random.default_rng(6), 20_000
    lists = []
    for t in range(3):
        docs = np.sort(rng.choice(n, 6000, replace=False)).astype(np.int32)
        impacts = rng.integers(100_000, 200_000, 6000).astype(np.int32)
        impacts[1000 * t : 1000 * t + 40] = 900_000
        ends = bmw.boundaries(impacts)
        lists.append((t, docs, impacts, ends, np.maximum.reduceat(impacts, np.append(0, ends[:-1]))))
    shard = bmw.Shard(lists, n)
    place, score = shard.best([(0, 5), (1, 7), (2, 900)], 10)
    whole = np.zeros(n, np.int64)
    for (_, docs, impacts, *_), w in zip(lists, (5, 7, 900), strict=True):
        whole[docs] += w * impacts.astype(np.int64)
    top = np.lexsort((np.arange(n), -whole))[:10]
    at = np.lexsort((place, -score))[:10]
    assert place[at].tolist() == top.tolist() and score[at].tolist() == whole[top].tolist()
    assert shard.opened < len(shard.stop) / 2

"""Ranked lexical search over an index of variable blocks, with exact skipping of blocks.

The index is cut into shards of documents, each of a bounded number of postings and made by one task from the documents
that it reads, so building shuffles nothing. A shard holds, for every term, its documents in the order of their ids, what
each would add to a score per unit of the term's weight, and blocks of those with their maxima. Dynamic programming
chooses a list's block boundaries: they minimise what the maxima overstate plus a price a block, so that blocks end where impacts change.

A search deals the lists of the queries' terms out by shard. There the block boundaries of a query's terms cut the
documents into stretches in which the sum of weighted maxima is one number. That sum is WAND's test of a pivot: a stretch
below the k-th best score so far cannot hold a winner. Stretches are taken best first; only blocks that overlap
those taken are opened, and the search ends at the first stretch below the threshold. Equal scores are kept, so results are exact.

Queries come in blocks of bounded size; the driver holds one block's terms and their weights, never a list.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.llm.common import fresh_dir, in_batches, settled

TOP = 50
#: Bytes in place of characters: upper case to lower, ASCII that is neither a letter nor a digit to a space.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Postings of a shard, unless one document has more.
SHARD = 2_000_000
#: Block boundaries lie between so many postings, a block has at most so many such units, and its price in impact.
UNIT, UNITS, PRICE = 8, 64, 3_000_000
#: A block of queries: rows, and distinct terms.
QUERIES, QUERY_TERMS = 2_048, 100_000
INDEX = "shard bigint, term binary, n int, docs array<int>, impacts array<int>, ends array<int>, tops array<int>, ids array<bigint>"
#: Documents that a search scores first; each further step doubles them.
STEP = 512


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text, in order."""
    return text.translate(_LOWER).split()


def norm(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms, of `docs` documents with `terms` terms in all."""
    return 50 + (50 * n.astype(np.int64) * docs) // max(terms, 1)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def boundaries(impacts: np.ndarray, price: int = PRICE, unit: int = UNIT, units: int = UNITS) -> np.ndarray:
    """Ends of the blocks of one list: those of least (length x maximum - sum) + price over all blocks."""
    n = len(impacts)
    if n <= unit:
        return np.array([n])
    starts = np.arange(0, n, unit)
    tops = np.maximum.reduceat(impacts, starts).astype(np.int64)
    at = np.append(starts, n)
    cost, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for i in range(1, len(at)):
        low = max(0, i - units)
        # The sum of impacts is the same however they are cut, so it is left out.
        total = cost[low:i] + np.maximum.accumulate(tops[low:i][::-1])[::-1] * (at[i] - at[low:i])
        j = int(total.argmin())
        cost[i], back[i] = total[j] + price, low + j
    ends, i = [], len(at) - 1
    while i:
        ends.append(at[i])
        i = back[i]
    return np.array(ends[::-1])


@dataclass
class Index:
    """Where an index lies, the documents with a term, and all their terms with repeats."""

    path: str
    docs: int
    terms: int


def _totals(docs: DataFrame, text: str) -> tuple[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for b in batches:
            for t in b.column(0):
                n = len(terms_of(t.as_py()))
                docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])

    row = in_batches(docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("t")), run, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _shard(number: int, ids: list[int | None], lengths: list[int], vocabulary: dict[bytes, int], lists: list[tuple[np.ndarray, np.ndarray]], docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    """A shard's rows: one a term, and one without a term that has the ids."""
    by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    term = np.concatenate([t for t, _ in lists]).astype(np.int64)
    tf = np.concatenate([c for _, c in lists]).astype(np.int64)
    doc = np.repeat(place, [len(t) for t, _ in lists])
    m = np.repeat(norm(np.array(lengths), docs, terms), [len(t) for t, _ in lists])
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
    order = np.argsort(term * len(ids) + doc)
    doc, impact = doc[order].astype(np.int32), impact[order].astype(np.int32)
    cuts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    names = list(vocabulary)
    columns = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64())]
    for k in range(0, len(names), 4096):
        rows = []
        for j in range(k, min(k + 4096, len(names))):
            a, z = cuts[j], cuts[j + 1]
            own = impact[a:z]
            ends = boundaries(own)
            rows.append((number, names[j], z - a, doc[a:z], own, ends.astype(np.int32), np.maximum.reduceat(own, np.append(0, ends[:-1])), None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], columns)
    last = (number, None, len(ids), None, None, None, None, [ids[i] for i in by_id])
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, kinds, strict=True)], columns)


def built(docs: DataFrame, path: str | None = None, text: str = "text", id: str = "doc_id", shard: int = SHARD) -> Index:
    """The index of every row with a term, written to `path` (a new folder of the shared one if there is none). Rows are documents
    of their own, also where ids are null (the last of equals) or repeated; null and empty texts have no term."""
    spark, out = docs.sparkSession, path or fresh_dir(docs.sparkSession, "index")
    n_docs, n_terms = _totals(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        ids, lengths, vocabulary, lists = [], [], {}, []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(t.as_py())
                if not words:
                    continue
                tf = Counter(words)
                ids.append(i)
                lengths.append(len(words))
                lists.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tf], np.int32), np.fromiter(tf.values(), np.int32, len(tf))))
                held += len(tf)
                if held >= shard:
                    yield from _shard(number, ids, lengths, vocabulary, lists, n_docs, n_terms)
                    number, held = number + 1, 0
                    ids, lengths, vocabulary, lists = [], [], {}, []
        if ids:
            yield from _shard(number, ids, lengths, vocabulary, lists, n_docs, n_terms)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    in_batches(rows, run, INDEX).write.parquet(out)
    spark.createDataFrame([(n_docs, n_terms)], "docs bigint, terms bigint").coalesce(1).write.parquet(f"{out}-totals")
    return Index(out, n_docs, n_terms)


def opened(spark: SparkSession, path: str) -> Index:
    row = spark.read.parquet(f"{path}-totals").first()
    return Index(path, row["docs"], row["terms"])


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each start, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


class Shard:
    """Lists of the terms at hand, by number: postings and blocks one after the other, and where each list's begin."""

    def __init__(self, lists: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], size: int) -> None:
        self.size, self.place = size, {t: i for i, (t, *_) in enumerate(lists)}
        docs, impacts, ends, tops = ([x[i] for x in lists] for i in (1, 2, 3, 4))
        offset = np.cumsum([0, *map(len, docs)])
        self.docs, self.impacts, self.tops = np.concatenate(docs), np.concatenate(impacts).astype(np.int64), np.concatenate(tops).astype(np.int64)
        self.first = np.cumsum([0, *map(len, ends)])  # of a list's blocks
        self.stop = np.concatenate([e + o for e, o in zip(ends, offset, strict=False)])  # of a block's postings
        self.start = np.concatenate([np.append(0, e[:-1]) + o for e, o in zip(ends, offset, strict=False)])
        self.low, self.high = self.docs[self.start].astype(np.int64), self.docs[self.stop - 1].astype(np.int64) + 1
        self.opened = 0

    def best(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents that may be among the k best by (score, place): all that reach the k-th score."""
        have = [(self.place[t], w) for t, w in query if t in self.place and w > 0]
        if not have:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists, w = np.array([p for p, _ in have]), np.array([x for _, x in have])
        count = self.first[lists + 1] - self.first[lists]
        blocks, w = spans(self.first[lists], count), np.repeat(w, count)
        most = w * self.tops[blocks]
        # Stretches between the blocks' boundaries, and the most that a document there may score.
        points = np.concatenate([self.low[blocks], self.high[blocks]])
        order = np.argsort(points, kind="stable")
        points, rises = points[order], np.concatenate([most, -most])[order]
        new = np.flatnonzero(np.append(True, points[1:] != points[:-1]))
        edge, bound = points[new], np.cumsum(np.add.reduceat(rises, new))[:-1]
        by_bound = np.argsort(-bound, kind="stable")
        width = np.cumsum((edge[1:] - edge[:-1])[by_bound])
        scores, least, done, step = np.zeros(self.size, np.int64), 1, 0, max(STEP, 4 * k)
        while done < len(by_bound) and bound[by_bound[done]] >= least:
            upto = int(np.searchsorted(width, (width[done - 1] if done else 0) + step)) + 1
            now = by_bound[done:upto]
            now = now[bound[now] >= least]
            taken = np.zeros(self.size + 1, np.int64)
            np.add.at(taken, edge[now], 1)
            np.add.at(taken, edge[now + 1], -1)
            taken = np.cumsum(taken)[:-1] > 0
            upon = np.append(0, np.cumsum(taken))
            live = np.flatnonzero(upon[self.high[blocks]] > upon[self.low[blocks]])
            self.opened += len(live)
            size = self.stop[blocks[live]] - self.start[blocks[live]]
            at = spans(self.start[blocks[live]], size)
            doc = self.docs[at]
            ok = taken[doc]
            np.add.at(scores, doc[ok], (np.repeat(w[live], size) * self.impacts[at])[ok])
            if np.count_nonzero(scores) >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
            done, step = upto, 2 * step
        found = np.flatnonzero(scores >= least)
        return found, scores[found]


def _block_scores(index: Index, spark: SparkSession, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    """(query, item_id, doc_id, score): the k best of each shard for each query of a block."""
    numbers = {t: i for i, t in enumerate(dict.fromkeys(t for _, ts in block for t in ts))}
    wanted = F.broadcast(spark.createDataFrame([(bytearray(t), i) for t, i in numbers.items()], "term binary, number int"))  # at most QUERY_TERMS and one query's terms
    rows = spark.read.parquet(index.path)
    df = rows.select("term", "n").join(wanted, "term").groupBy("number").agg(F.sum("n").alias("df")).collect()
    weights = {r["number"]: weight(r["df"], index.docs) for r in df}
    queries = [(i, item, [(numbers[t], weights.get(numbers[t], 0)) for t in ts]) for i, (item, ts) in enumerate(block)]
    lists = rows.where("term is not null").join(wanted, "term").unionByName(rows.where("term is null").withColumn("number", F.lit(-1)))

    def search(key: tuple, t: pa.Table) -> pa.Table:
        found, ids, own = [], None, []
        for i, number in enumerate(t.column("number").to_pylist()):
            if number < 0:
                ids = t.column("ids")[i].values
            else:
                own.append((number, *(t.column(c)[i].values.to_numpy() for c in ("docs", "impacts", "ends", "tops"))))
        if own:
            shard = Shard(own, len(ids))
            for q, item, terms in queries:
                place, score = shard.best(terms, k)
                at = np.lexsort((place, -score))[:k]
                found.append((q, item, place[at], score[at]))
        size = [len(p) for *_, p, _ in found]
        doc = ids.take(pa.array(np.concatenate([p for *_, p, _ in found]))) if found else pa.array([], pa.int64())
        score = pa.array(np.concatenate([s for *_, s in found])) if found else pa.array([], pa.int64())
        per = lambda i, kind: pa.array([x[i] for x in found], kind).take(pa.array(np.repeat(np.arange(len(found)), size), pa.int64()))
        return pa.table([per(0, pa.int32()), per(1, pa.int64()), doc, score], ["query", "item_id", "doc_id", "score"])

    need = lists.select("shard", "number", "docs", "impacts", "ends", "tops", "ids")
    found = need.groupBy("shard").applyInArrow(search, "query int, item_id bigint, doc_id bigint, score bigint")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def searched(index: Index, items: DataFrame, k: int = TOP, text: str = "text", id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents above 0 of each query, equal scores by doc_id.

    Every row of items is a query of its own, so repeated rows repeat their results; one without a known term has none. Queries
    are read to the driver in blocks, and the shards are searched once for each block.
    """
    spark = items.sparkSession
    out, block, terms = fresh_dir(spark, "found"), [], set()
    spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint").write.parquet(out)

    def finish() -> None:
        if terms:
            _block_scores(index, spark, block, k).write.mode("append").parquet(out)
        block.clear()
        terms.clear()

    for r in items.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).toLocalIterator():
        own = list(dict.fromkeys(terms_of(bytes(r["t"]))))
        block.append((r["id"], own))
        terms.update(own)
        if len(block) >= QUERIES or len(terms) >= QUERY_TERMS:
            finish()
    finish()
    return spark.read.parquet(out)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of every item's best 50 documents; no rows where there are no documents or items."""
    return searched(built(docs), items)

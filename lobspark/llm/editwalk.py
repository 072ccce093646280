"""Document fingerprints by a randomised edit embedding.

A walk passes over a text with a clock that all texts share. At each tick the walker shows where it stands; whether it
then goes on is a coin that the clock and the character decide. So a text of n characters becomes some 2 n ticks, and
texts that differ by a few edits show the same at nearly all ticks: after an edit two walkers stand at the same character
with clocks a little apart, and fall together as soon as one character's coins make both wait for the same tick.

Of each walk some ticks are looked at. Which ones follows from the length alone and hardly changes with it: a slot's tick
is the last record of a shared random sequence below the length, so that it is uniform, and equal for two lengths with
the probability of their ratio. A slot keeps a byte of the characters from there on. The share of equal slots is the
likeness of two fingerprints: Hamming distance in place of edit distance.

For near-duplicates bits are sampled from fingerprints as bands: texts that share a band meet and are verified by all slots.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.llm.common import fresh_dir, in_batches, min_components, settled

SEED = 12
WALKS, SLOTS = 2, 64
#: Characters whose hash a slot keeps.
GRAM = 4
#: Coins repeat after so many ticks; a clock's hand fits a byte.
PERIOD = 256
CLASSES = 256
#: Bands of the query.
BANDS, BAND_BITS = 32, 24
ODD = 2654435761


def _hands() -> list[list[bytes]]:
    """By walk and class of characters: where the clock's hand stands after a character, by where it stood before."""
    rng, out = np.random.default_rng(SEED), []
    for _ in range(WALKS):
        rows = []
        for coins in rng.random((CLASSES, PERIOD)) < 0.5:
            goes = np.flatnonzero(coins)
            # The first tick from s on whose coin says go, around the period, and one more.
            at = np.searchsorted(goes, np.arange(PERIOD))
            rows.append(((goes[at % len(goes)] + 1) % PERIOD).astype(np.uint8).tobytes())
        out.append(rows)
    return out


def _records() -> np.ndarray:
    """By slot the records of its sequence, rising, up to 2^42 ticks; rows are filled up with the last."""
    rng, rows = np.random.default_rng(SEED + 1), []
    for _ in range(WALKS * SLOTS):
        row = [0]
        while row[-1] < 1 << 42:  # no record between p and m with probability (p + 1) / (m + 1)
            row.append(max(row[-1] + 1, int((row[-1] + 1) / (1 - rng.random()))))
        rows.append(row)
    width = max(map(len, rows))
    return np.array([r + [r[-1]] * (width - len(r)) for r in rows])


_HANDS, _RECORDS = _hands(), _records()
_GAINS = np.random.default_rng(SEED + 2).integers(1, 1 << 32, (WALKS * SLOTS, GRAM), np.uint64) | np.uint64(1)


@dataclass
class Walked:
    """A text's code points and the hands after each of them, by walk; whatever begins alike shares them."""

    points: np.ndarray
    classes: bytes
    hands: list[bytes]

    @classmethod
    def of(cls, text: str) -> Walked:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = ((points * np.uint32(ODD)) >> np.uint32(24)).astype(np.uint8).tobytes()
        return cls(points, classes, [_walk(classes, rows, 0) for rows in _HANDS])

    def edited(self, keep: int, other: Walked, take: int) -> Walked:
        """The first `keep` characters of this text, then the first `take` of another; only those are walked anew."""
        tail = other.classes[:take]
        hands = [h[:keep] + _walk(tail, rows, h[keep - 1] if keep else 0) for h, rows in zip(self.hands, _HANDS, strict=True)]
        return Walked(np.concatenate([self.points[:keep], other.points[:take]]), self.classes[:keep] + tail, hands)

    @cached_property
    def fingerprint(self) -> bytes:
        """A byte a slot; of an empty text zeros."""
        n = len(self.points)
        if not n:
            return bytes(WALKS * SLOTS)
        padded, out = np.concatenate([self.points, np.zeros(GRAM, np.uint32)]).astype(np.uint64), []
        for w, hands in enumerate(self.hands):
            hand = np.frombuffer(hands, np.uint8).astype(np.int64)
            ticks = (np.diff(hand, prepend=0) - 1) % PERIOD + 1
            until = np.cumsum(ticks)
            slots = _RECORDS[w * SLOTS : (w + 1) * SLOTS]
            tick = slots[np.arange(SLOTS), (slots < until[-1]).sum(axis=1) - 1]
            at = np.searchsorted(until, tick, side="right")
            grams = padded[at[:, None] + np.arange(GRAM)]
            mixed = (grams * _GAINS[w * SLOTS : (w + 1) * SLOTS]).sum(axis=1, dtype=np.uint64)
            out.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8))
        return np.concatenate(out).tobytes()


def _walk(classes: bytes, rows: list[bytes], hand: int, stretch: int = 1 << 20) -> bytes:
    out = bytearray()
    for k in range(0, len(classes), stretch):
        out += bytes([hand := row[hand] for row in map(rows.__getitem__, classes[k : k + stretch])])
    return bytes(out)


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal slots."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def sampled(bands: int, bits: int) -> np.ndarray:
    """The bits of each band."""
    rng = np.random.default_rng(SEED + 3)
    return np.stack([rng.choice(WALKS * SLOTS * 8, bits, replace=False) for _ in range(bands)])


def banded(fps: list[bytes], at: np.ndarray) -> np.ndarray:
    """A row of band values for each fingerprint; at: sampled()."""
    bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
    return (bits[:, at].astype(np.int64) << np.arange(at.shape[1])).sum(axis=2)


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, fp) of every row; a null text counts as empty, equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Walked.of(t).fingerprint for t in b.column(1).to_pylist()], pa.binary())], ["id", "fp"])

    return in_batches(docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), run, "id bigint, fp binary")


def band_plan(n: int, at_least: float, missed: float = 0.02) -> tuple[int, int]:
    """(bands, bits): wide enough that n fingerprints that have nothing in common seldom share one, and so many that a pair of
    likeness at_least shares none with probability `missed`. A slot that differs still has half its bits alike."""
    bits = min(60, max(BAND_BITS, math.ceil(math.log2(max(n, 1))) + 6))
    met = (at_least + (1 - at_least) / 2) ** bits
    return max(1, math.ceil(math.log(missed) / math.log1p(-met))), bits


def near_duplicates(docs: DataFrame, at_least: float = 0.8, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, component): texts linked by fingerprints of likeness at_least or more that share a band; component is the smallest id.

    Equal fingerprints are one row. In each bucket of a band all are verified against its smallest; those that are unlike it
    form the bucket anew without it, until none are left, so a bucket of n near copies makes n links. Ids must be distinct and not null.
    """
    fps = settled(fingerprints(docs, text, id))
    reps = settled(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    at = sampled(*band_plan(reps.count(), at_least))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = banded(b.column("fp").to_pylist(), at)
                per = pa.array(np.repeat(np.arange(b.num_rows), len(at)))
                yield pa.RecordBatch.from_arrays([b.column("rep").take(per), b.column("fp").take(per), pa.array(np.tile(np.arange(len(at), dtype=np.int32), b.num_rows)), pa.array(values.ravel())], ["rep", "fp", "band", "value"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = [likeness(x, y) >= at_least for x, y in zip(b.column("fp").to_pylist(), b.column("head").to_pylist(), strict=True)]
            yield b.append_column("like", pa.array(like, pa.bool_()))

    rows, links = in_batches(reps, bands, "rep bigint, fp binary, band int, value bigint"), []
    while True:
        heads = rows.groupBy("band", "value").agg(F.min(F.struct("rep", "fp")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "value", F.col("m.rep").alias("first"), F.col("m.fp").alias("head"))
        pairs = rows.join(heads, ["band", "value"]).where("rep <> first")
        held = settled(in_batches(pairs, verified, "band int, value bigint, rep bigint, fp binary, first bigint, head binary, like boolean").select("band", "value", "rep", "fp", "first", "like"))
        if held.isEmpty():
            break
        links.append(held.where("like").select(F.col("rep").alias("u"), F.col("first").alias("v")).distinct())
        rows = held.where("not like").select("rep", "fp", "band", "value")
    if not links:
        return fps.join(reps, "fp").select("id", F.col("rep").alias("component"))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    comps = min_components(edges)
    named = fps.join(reps, "fp").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return named.select("id", F.coalesce("component", "rep").alias("component"))


# --- Each text, its edit, and the next -------------------------------------------------------------------

_FIELDS = "doc_id bigint, n_chars bigint, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double, bands_edited int, bands_next int"


def _compared(doc_id: int | None, text: str, own: Walked, after: str, other: Walked, at: np.ndarray) -> tuple:
    n = len(text)
    take = n // 3
    edit = own.edited(n - take, other, min(take, len(after)))
    fps = [own.fingerprint, edit.fingerprint, other.fingerprint]
    bands = banded(fps, at)
    digest = hashlib.sha256((text[: n - take] + after[:take]).encode()).hexdigest()
    return doc_id, n, digest, fps[0], fps[1], likeness(fps[0], fps[1]), likeness(fps[0], fps[2]), int((bands[0] == bands[1]).sum()), int((bands[0] == bands[2]).sum())


def compared(docs: DataFrame) -> DataFrame:
    """Each text by its fingerprint against its edit and against the next text, in descending order of doc_id (null ids last,
    equal ids by their text's hash, the first after the last).

    Texts are dealt once, by ranges of that order, and read in order within a range, each held against the one after it. What
    spans two ranges is one pair a range; those are kept apart and joined by the number of the range.
    """
    spark, at = docs.sparkSession, sampled(BANDS, BAND_BITS)
    need = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [f.split()[0] for f in _FIELDS.split(", ")] + ["range", "head", "tail"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = before = None
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                now = (doc_id, text, Walked.of(text))
                if before is None:
                    head = text
                else:
                    out.append((*_compared(*before, text, now[2], at), None, None, None))
                before = now
            yield batch(out)
        if before is not None:
            yield batch([(before[0], *[None] * 8, TaskContext.get().partitionId(), head, before[1])])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("doc_id").to_pylist(), b.column("tail").to_pylist(), b.column("after").to_pylist(), strict=True)
            yield batch([(*_compared(d, t, Walked.of(t), a, Walked.of(a), at), None, None, None) for d, t, a in rows])

    schema = f"{_FIELDS}, range int, head string, tail string"
    out = fresh_dir(spark, "edit-walks")
    in_batches(need.repartitionByRange(*order).sortWithinPartitions(*order), run, schema).write.parquet(out)
    done = spark.read.schema(schema).parquet(out)
    ends = done.where("range is not null").select("doc_id", "range", "head", "tail")
    by = W.orderBy("range")  # a row a range
    after = F.coalesce(F.lead("range").over(by), F.min("range").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    spans = ends.select("range", after.alias("next"))
    pairs = ends.drop("head").join(spans, "range").join(ends.select(F.col("range").alias("next"), F.col("head").alias("after")), "next")
    return done.where("range is null").unionByName(in_batches(pairs.select("doc_id", "tail", "after"), edges, schema)).drop("range", "head", "tail")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many of 32 bands of 24
    sampled bits the text shares with its edit and with the next text.

    A null text counts as empty; an empty text's edit is empty, and two empty texts are alike. Repeated rows follow each other. A
    table of one row has itself as the next; an empty one gives no rows. Columns besides doc_id and text are left out.
    """
    hexed = lambda c: F.lower(F.hex(c))
    out = compared(docs)
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "bands_edited", "bands_next")

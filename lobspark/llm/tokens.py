"""Token sequences in training order, as fixed-stride binary shards.

Documents are encoded, each ended by an end mark, and joined into sequences of `seq_len` tokens within
each input partition; the last of a partition is padded. A first pass, which only measures, counts tokens
by partition, so that every sequence has a global number without a shuffle. A keyed Feistel permutation
with cycle-walking maps the n numbers one to one onto n slots, the training order; it needs no table and can
be inverted. Sequences are shuffled once, by shard (a range of slots), and each shard is one file of
equal strides, so that slot s is at byte s * stride and a reader resumes anywhere.

A byte-pair vocabulary in the public rank format gives ids of 16 or 32 bits; the driver reads its file and
tasks get its contents. Without one, ids are bytes (UTF-8 never reaches 248; 254 pads, 255 ends a document).

Null and empty texts have only their end mark. Repeated rows are separate documents. Other columns are
ignored. If a second read of the input deals its rows otherwise than the first, the job stops.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import fresh_dir, in_batches
from lobspark.llm.files import opened, written

KEY = 0x5EED_0F_0D_E5
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROUNDS = 6
SHARD_BYTES = 1 << 24


def _mixed(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slots of numbers 0..n-1, or with inverse the numbers of slots."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        if inverse:
            for k in keys[::-1]:
                left, right = right ^ (_mixed(left ^ k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mixed(right ^ k) & mask)
        return left << half | right

    out = once(np.asarray(x, dtype=np.uint64))
    while (off := out >= np.uint64(n)).any():
        out[off] = once(out[off])
    return out.astype(np.int64)


def encoder(ranks: bytes | None) -> tuple[Callable[[str], np.ndarray], np.dtype, int, int]:
    """How a text becomes ids, by the contents of a rank file; their type; the end mark; the padding."""
    if ranks is None:
        return lambda t: np.frombuffer(t.encode("utf-8", "replace"), np.uint8), np.dtype("u1"), 255, 254
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    look = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    full = tiktoken.Encoding("full", pat_str=look, mergeable_ranks=table, special_tokens={})
    # Without two blanks in a row the look-ahead changes nothing, and without it splitting is faster.
    fast = tiktoken.Encoding("fast", pat_str=look.replace(r"|\s+(?!\S)", ""), mergeable_ranks=table, special_tokens={})
    twice = re.compile(r"\s\s")
    end = len(table)
    kind = np.dtype("<u2" if end + 1 < 1 << 16 else "<u4")
    return lambda t: np.array((full if twice.search(t) else fast).encode_ordinary(t), kind), kind, end, end + 1


def materialised(docs: DataFrame, folder: str, text: str = "text", id: str = "doc_id", seq_len: int = 2048, key: int = KEY, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards and manifest.json; a row a sequence: seq, slot, shard, offset (bytes), n_tokens, first_id, first_at, crc32.
    first_id is the document that the sequence begins in, first_at the token of it that comes first."""
    spark = docs.sparkSession
    # Splits of files depend on the cores at hand unless this is set; both passes must see the same ones.
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    base = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranks = None
    if vocabulary:
        with open(vocabulary, "rb") as file:
            ranks = file.read()
    _, kind, end, pad = encoder(ranks)
    if ranks is None:
        sizes = base.select(F.spark_partition_id().alias("part"), (F.octet_length("text") + 1).cast("long").alias("n"), F.xxhash64("id").alias("sum"))
    else:

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode, *_ = encoder(ranks)
            part = TaskContext.get().partitionId()
            for b in batches:
                n = [len(encode(t)) + 1 for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64()), b.column(0)], ["part", "n", "sum"])

        sizes = in_batches(base, measure, "part int, n long, sum long")
    # A row for each input partition: bounded by the number of tasks, not by their rows.
    parts = sorted(tuple(r) for r in sizes.groupBy("part").agg(F.sum("n"), F.count(F.lit(1))).collect())
    first, total, expected = {}, 0, {}
    for part, n, rows in parts:
        first[part], expected[part] = total, (n, rows)
        total += -(-n // seq_len)
    stride = seq_len * kind.itemsize
    per_shard = max(1, SHARD_BYTES // stride)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind, end, pad = encoder(ranks)
        part = TaskContext.get().partitionId()
        seq, held, size = first.get(part, 0), [], 0  # held: (id, place in its document, ids)
        seen = rows = 0
        names = ["shard", "slot", "seq", "n_tokens", "first_id", "first_at", "data"]

        def emit(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal seq, held, size
            whole = np.concatenate([x[2] for x in held]) if held else np.zeros(0, kind)
            n = len(whole) // seq_len + (final and len(whole) % seq_len > 0)
            if n:
                starts = np.cumsum([0, *[len(x[2]) for x in held]])
                used = min(n * seq_len, len(whole))
                body = np.full(n * seq_len, pad, kind)
                body[:used] = whole[:used]
                at = np.arange(n) * seq_len
                owner = np.searchsorted(starts, at, side="right") - 1
                slot = permuted(np.arange(seq, seq + n), total, key)
                ids, places = [x[0] for x in held], np.array([x[1] for x in held])
                raw = body.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot // per_shard), pa.array(slot), pa.array(np.arange(seq, seq + n)), pa.array(np.minimum(seq_len, len(whole) - at)),
                     pa.array([ids[o] for o in owner], pa.int64()), pa.array(places[owner] + at - starts[owner]), pa.array([raw[i * stride : (i + 1) * stride] for i in range(n)], pa.binary())], names)
                seq += n
                k = int(np.searchsorted(starts, used, side="right") - 1)
                held = [] if used == len(whole) else [(held[k][0], held[k][1] + used - int(starts[k]), whole[used : starts[k + 1]]), *held[k + 1 :]]
                size = len(whole) - used

        for b in batches:
            for i in range(b.num_rows):
                d, t = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids = np.append(encode(t), kind.type(end))
                held.append((d, 0, ids))
                size, seen, rows = size + len(ids), seen + len(ids), rows + 1
                if size >= 512 * seq_len:
                    yield from emit(False)
        yield from emit(True)
        if (seen, rows) != expected.get(part, (0, 0)):
            raise RuntimeError("the input was dealt out otherwise than when it was measured")

    def store(k: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        shard, data = k[0].as_py(), t.column("data")
        crc = []
        with written(f"{folder}/shard-{shard:06d}.bin") as out:
            for chunk in data.chunks:
                for x in chunk:
                    raw = x.as_buffer()
                    out.write(raw)
                    crc.append(zlib.crc32(raw))
        slot = t.column("slot").to_numpy()
        cols = [t.column("seq"), slot, t.column("shard"), (slot - shard * per_shard) * stride, t.column("n_tokens"), t.column("first_id"), t.column("first_at"), crc]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, pa.int64()) for x in cols], names=out_names)

    out_names = ["seq", "slot", "shard", "offset", "n_tokens", "first_id", "first_at", "crc32"]
    cuts = in_batches(base, cut, "shard long, slot long, seq long, n_tokens long, first_id long, first_at long, data binary")
    with written(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"sequences": total, "seq_len": seq_len, "dtype": kind.str, "stride": stride, "per_shard": per_shard, "end": end, "pad": pad, "key": key}).encode())
    return cuts.groupBy("shard").applyInArrow(store, ", ".join(f"{n} long" for n in out_names))


def sequences(folder: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of slots start..stop-1, in training order."""
    with opened(f"{folder}/manifest.json") as file:
        m = json.loads(file.read())
    stop = m["sequences"] if stop is None else min(stop, m["sequences"])
    while start < stop:
        shard = start // m["per_shard"]
        last = min(stop, (shard + 1) * m["per_shard"])
        with opened(f"{folder}/shard-{shard:06d}.bin") as file:
            for slot in range(start, last):
                yield np.frombuffer(file.read_at(m["stride"], (slot - shard * m["per_shard"]) * m["stride"]), m["dtype"])
        start = last


def digest(docs: DataFrame, vocabulary: str = RANKS) -> DataFrame:
    return materialised(docs.select("doc_id", "text"), fresh_dir(docs.sparkSession, "tokens"), seq_len=1024, vocabulary=vocabulary)

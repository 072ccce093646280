"""Packing by optimal length buckets.

Texts are cut into pieces of at most `max_len` tokens: words, or the ids of a public vocabulary. A global histogram of piece lengths, which has at
most max_len entries however large the corpus, goes to the driver, where dynamic programming picks the
`buckets` boundaries that pad least. Inside a bucket, pieces form batches of `budget` padded tokens. To
number them without gathering a bucket in one task, each bucket is dealt by hash into sub-buckets of
about `chunk` rows, known from the histogram; a sub-bucket numbers its own pieces and leaves at most one
short batch.

Null and empty texts have no pieces and no rows, and so has an empty table. Repeated rows are packed one by one; ties go by id and
piece. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.llm.common import WORD, in_batches, settled
from lobspark.llm.tokens import encoder

SEED = 77


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The lengths, the largest among them, that pad least when each piece is padded to the next one."""
    lengths = sorted(k for k, n in histogram.items() if n)
    if not lengths:
        return []
    x = np.array(lengths, dtype=np.float64)
    n = np.concatenate(([0], np.cumsum([histogram[k] for k in lengths]))).astype(np.float64)
    # Cost of a bucket over lengths i..j-1 is x[j-1] * rows; the words themselves are the same for all choices.
    best = np.concatenate(([0.0], x * n[1:]))
    back = [np.zeros(len(best), dtype=np.int64)]
    for _ in range(1, min(buckets, len(lengths))):
        nxt, via = best.copy(), np.zeros(len(best), dtype=np.int64)
        for j in range(1, len(best)):
            cost = best[:j] + x[j - 1] * (n[j] - n[:j])
            via[j] = int(np.argmin(cost))
            nxt[j] = cost[via[j]]
        best = nxt
        back.append(via)
    out, j = [], len(lengths)
    for via in reversed(back):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = int(via[j])
    return sorted(out)


def counted(docs: DataFrame, text: str, id: str, vocabulary: str | None, content: bool) -> DataFrame:
    """(id, __n, __w): length in tokens and, with content, the tokens: words, or a vocabulary's ids."""
    if vocabulary is None:
        w = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"), F.lit(1))
        n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
        return docs.select(F.col(id).alias(id), *([F.size(w).cast("long").alias("__n"), w.alias("__w")] if content else [n.alias("__n")]))
    with open(vocabulary, "rb") as file:
        ranks = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, *_ = encoder(ranks)
        for b in batches:
            found = [encode(t or "") for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(pa.int32()))] if content else cols, [id, "__n", "__w"][: 3 if content else 2])

    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, __n long" + (", __w array<int>" if content else "")
    return in_batches(docs.select(id, text), run, schema)


def pieces(docs: DataFrame, text: str = "text", id: str = "doc_id", max_len: int = 2048, vocabulary: str | None = None, content: bool = False) -> DataFrame:
    """(id, piece, n_tokens) for every piece of every text; with content also its tokens."""
    sized = counted(docs, text, id, vocabulary, content).where("__n > 0")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {max_len}"))))
    own = [F.slice("__w", (F.col("piece") * max_len + 1).cast("int"), max_len).alias("tokens")] if content else []
    return cut.select(id, "piece", F.least(F.lit(max_len).cast("long"), F.col("__n") - F.col("piece") * max_len).alias("n_tokens"), *own)


def packed(docs: DataFrame, text: str = "text", id: str = "doc_id", max_len: int = 2048, buckets: int = 16, budget: int = 16_384, chunk: int = 20_000, vocabulary: str | None = None, content: bool = False) -> DataFrame:
    """A row a piece: id, piece, n_tokens, bucket_len (padded length), batch (bucket_len/sub/number), slot (its row in the batch), with content also tokens."""
    if budget < max_len:
        raise ValueError("a batch must hold the longest piece")
    rows = settled(pieces(docs, text, id, max_len, vocabulary, content))
    histogram = {r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    edges = boundaries(histogram, buckets)
    subs, low = {}, 0
    for edge in edges:
        n = sum(c for k, c in histogram.items() if low < k <= edge)
        subs[edge] = -(-n // chunk)
        low = edge
    bucket, sub = F.lit(None).cast("long"), F.lit(1).cast("long")
    for edge in reversed(edges):
        bucket = F.when(F.col("n_tokens") <= edge, F.lit(edge).cast("long")).otherwise(bucket)
        sub = F.when(F.col("n_tokens") <= edge, F.lit(subs[edge]).cast("long")).otherwise(sub)
    rows = rows.withColumn("bucket_len", bucket).withColumn("__sub", F.pmod(F.xxhash64(F.lit(SEED), id, "piece"), sub))
    place = F.row_number().over(W.partitionBy("bucket_len", "__sub").orderBy(F.xxhash64(F.lit(SEED + 1), id, "piece"), id, "piece")) - 1
    per = F.expr(f"{budget} div bucket_len")
    return rows.withColumn("__at", place.cast("long")).select(
        id, "piece", "n_tokens", "bucket_len",
        F.concat_ws("/", "bucket_len", "__sub", F.expr(f"__at div ({budget} div bucket_len)")).alias("batch"),
        F.pmod(F.col("__at"), per).alias("slot"), *(["tokens"] if content else []),
    )


def batched(docs: DataFrame, folder: str, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """Writes the batches as Parquet, a row a batch under its bucket's length: batch, ids, pieces, lengths, and tokens as
    rows of one length, padded with null; and reads them back. A batch holds at most `budget` tokens with its padding."""
    rows = packed(docs, text, id, content=True, **options)
    rows = rows.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(None).cast(rows.schema["tokens"].dataType.elementType), (F.col("bucket_len") - F.col("n_tokens")).cast("int"))))
    whole = rows.groupBy("bucket_len", "batch").agg(F.array_sort(F.collect_list(F.struct("slot", F.col(id).alias("id"), "piece", "n_tokens", "tokens"))).alias("r"))
    out = whole.select("bucket_len", "batch", *[F.col(f"r.{c}").alias(n) for c, n in (("id", "ids"), ("piece", "pieces"), ("n_tokens", "lengths"), ("tokens", "tokens"))])
    out.write.partitionBy("bucket_len").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def digest(docs: DataFrame) -> DataFrame:
    return packed(docs.select("doc_id", "text"))

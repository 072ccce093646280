"""Files of market data: hourly tick archives and feature tables."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.sources.events import LEVELS

#: 20-byte records, big-endian; prices in 1e-5.
TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_qty", ">f4"), ("bid_qty", ">f4")])
LEAST_QTY = 0.001

RETURNS = ("r_1s", "r_5s", "r_30s", "r_300s")
COLUMNS = ("ts", "ofi_1", "ofi_5", "ofi_10", "depth_imb", "microprice_dev", "queue_imb", "spread", "trade_intensity", "price_impact", "level_drain", "weighted_mid_slope", *RETURNS, "sign_1s", "sign_5s", "exchange", "symbol", "data_source", "is_imputed", "gap_flag")
DOUBLES = COLUMNS[1:16]


def dukascopy_hours(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots from files <symbol>/<year>/<month from 00>/<day>/<hour>h_ticks.bi5; an empty file is an hour without ticks.
    Ticks without a price are dropped; a file that is no whole number of records stops the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bi5").option("recursiveFileLookup", "true").load(path).select("path", "content")
    at = F.regexp_extract_all("path", F.lit(r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5"), F.lit(0))[0]
    part = F.split(at, "/")
    hour = F.unix_micros(F.make_timestamp(part[1].cast("int"), part[2].cast("int") + 1, part[3].cast("int"), F.substring(part[4], 1, 2).cast("int"), F.lit(0), F.lit(0.0), F.lit("UTC")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbol, start, raw in (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows)):
            data = lzma.decompress(raw) if raw else b""
            if len(data) % TICK.itemsize:
                raise ValueError(f"a tick file of {symbol} is damaged: {len(data)} bytes are no whole records")
            t = np.frombuffer(data, TICK)
            t = t[(t["bid"] > 0) & (t["ask"] > 0)]
            if not len(t):
                continue
            us = start + t["ms"].astype(np.int64) * 1000
            sides = []
            for side in ("bid", "ask"):
                one = pa.StructArray.from_arrays([pa.array(t[side] * 1e-5), pa.array(np.maximum(t[f"{side}_qty"].astype(float), LEAST_QTY))], ["price", "qty"])
                sides.append(pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1), pa.int32()), one))
            yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(t)), pa.array(us), pa.array((us << 8) | (np.arange(len(t)) & 255)), *sides], ["symbol", "ts_us", "seq", "bids", "asks"])

    out = files.select(part[0].alias("symbol"), hour.alias("start"), "content").mapInArrow(decode, f"symbol string, ts_us long, seq long, bids {LEVELS}, asks {LEVELS}")
    return out.withColumns({"exchange": F.lit("dukascopy"), "kind": F.lit("snapshot")})


def feature_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Feature CSVs of 22 or 23 columns, read by name; imputed rows, rows after gaps and rows without a time are
    dropped; a number that cannot be read is null. `file` is the path they came from."""
    read = spark.read.option("header", True).option("pathGlobFilter", "*_features.csv").option("recursiveFileLookup", str(recursive).lower())
    raw = read.csv(path, enforceSchema=False) if not recursive else read.csv(path)
    have = {c.lower(): c for c in raw.columns}
    text = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    out = raw.select(
        text("ts").try_cast("bigint").alias("ts_us"), *[finite(text(c).try_cast("double")).alias(c) for c in DOUBLES], *[text(c).try_cast("tinyint").alias(c) for c in ("sign_1s", "sign_5s")],
        *[text(c).alias(c) for c in ("exchange", "symbol", "data_source")], *[F.coalesce(F.trim(text(c)).isin("1", "true"), F.lit(False)).alias(c) for c in ("is_imputed", "gap_flag")], F.col("_metadata.file_path").alias("file"),
    )
    return out.where("ts_us is not null and not is_imputed and not gap_flag")


def thinned(rows: DataFrame, most: int = 50_000, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every k-th row of a symbol with more than `most`, k = floor(n / most), by time."""
    by = W.partitionBy(*keys)
    counted = rows.withColumns({"__n": F.count(F.lit(1)).over(by), "__i": F.row_number().over(by.orderBy("ts_us")) - 1})
    stride = F.greatest(F.floor(F.col("__n") / most), F.lit(1))
    return counted.where((F.col("__n") <= most) | (F.col("__i") % stride == 0)).drop("__n", "__i")


def file_symbol(path: str = "file"):
    """The last part of a feature file's name before _features, in upper case."""
    return F.upper(F.regexp_extract(path, r"([^_/]+)_features\.csv$", 1))


def relative_symbol(root: str, path: str = "file"):
    """A feature file's path below root, as a name."""
    below = F.regexp_replace(F.regexp_replace(path, "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", ""), r"(_features)?\.csv$", "")
    return F.regexp_replace(below, "/", "_")

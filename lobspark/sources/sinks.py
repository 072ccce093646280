"""Tables that others read: labelled features, information coefficients."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.sources.files import COLUMNS, DOUBLES


def labelled_rows(df: DataFrame, data_source: bool = True, digits: int = 8) -> DataFrame:
    """The 23 columns (22 without data_source) as text: fixed decimals, null as nothing, flags as 0 or 1."""
    fixed = {c: F.format_string(f"%.{digits}f", c) for c in DOUBLES}
    out = {"ts": F.col("ts_us").cast("string"), **{c: F.when(F.col(c).isNotNull(), v) for c, v in fixed.items()}, "is_imputed": F.col("is_imputed").cast("int").cast("string"), "gap_flag": F.col("gap_flag").cast("int").cast("string")}
    names = [c for c in COLUMNS if data_source or c != "data_source"]
    return df.select(*[out.get(c, F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in names])


def write_csv(df: DataFrame, path: str, data_source: bool = True) -> None:
    labelled_rows(df, data_source).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """By date, exchange and symbol (slashes as underscores); rows of a partition go to one task each, split if large."""
    out = df.withColumns({"date": F.to_date(F.timestamp_micros("ts_us")), "symbol": F.regexp_replace("symbol", "/", "_")})
    out.hint("rebalance", "date", "exchange", "symbol").write.mode("overwrite").option("compression", "snappy").partitionBy("date", "exchange", "symbol").parquet(path)


def ic_rows(ic: DataFrame) -> DataFrame:
    """A row an indicator: symbol, indicator, ic_1s ... ic_300s with six decimals."""
    wide = ic.groupBy("symbol", "indicator").pivot("horizon", ["r_1s", "r_5s", "r_30s", "r_300s"]).agg(F.first("ic"))
    return wide.select("symbol", "indicator", *[F.when(F.col(f"r_{h}").isNotNull(), F.format_string("%.6f", f"r_{h}")).alias(f"ic_{h}") for h in ("1s", "5s", "30s", "300s")])


def write_ic(ic: DataFrame, path: str) -> None:
    ic_rows(ic).write.mode("overwrite").option("header", True).partitionBy("symbol").csv(path)


def write_lines(spark: SparkSession, lines: Iterable[str], path: str) -> None:
    """Lines as one text file of any file system that the session opens."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for line in lines:
            out.write(f"{line}\n".encode())
    finally:
        out.close()

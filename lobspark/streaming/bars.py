"""Bars of two phases, history and then live polls: each once, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_KEPT = "ts_us bigint, line bigint, pos int, body string"


class _Newer(StatefulProcessor):
    """The time of an instrument's last bar; what is not later was given before. Of a bar's messages the first counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows))
        if self.last.exists():
            b = b[b["ts_us"] > self.last.get()[0]]
        b = b[b["line"] == b.groupby("ts_us")["line"].transform("min")]
        if len(b):
            self.last.update((int(b["ts_us"].max()),))
        yield b[["symbol", "ts_us", "line", "pos", "body"]]

    def close(self) -> None:
        pass


def once(events: DataFrame) -> DataFrame:
    """events of bars (those of one symbol and ts_us are one bar) without repeats: within a batch the bar that came first counts, and
    one that is not later than what its instrument gave in an earlier batch does not. So the seam of two phases, pages that
    overlap and polls that repeat leave every bar once; within a batch bars may come in any order."""
    if not events.isStreaming:
        first = F.min("seq.line").over(W.partitionBy("symbol", "ts_us"))
        return events.withColumn("__first", first).where(F.col("seq.line") == F.col("__first")).drop("__first")
    need = events.select("symbol", "ts_us", "seq.line", "seq.pos", F.to_json(F.struct(*events.columns)).alias("body"))
    kept = need.groupBy("symbol").transformWithStateInPandas(_Newer(), f"symbol string, {_KEPT}", "append", "none")
    return kept.select(F.from_json("body", events.schema).alias("e")).select("e.*")

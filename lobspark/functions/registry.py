"""Indicators for users of SQL: a table function, and a view for each indicator.

    registry.register(spark, "bars")
    select * from indicator(table(bars) partition by symbol order by (ts_us, seq), 'ema_20, rsi_14')
    select * from ind_zscore_20
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lobspark.functions.indicators import FOLDED, FRAME, framed_sql
from lobspark.operators.folds import INPUTS, Instrument, folded

#: Rows that numpy works on at once.
ROWS = 4096
_KEYS = INPUTS[:3]


def _named(text: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in text.split(",") if n.strip())


class _Indicator:
    """The keys of each row of a partition and the named indicators, recursive ones and moving frames of a bar's own columns."""

    def __init__(self) -> None:
        self.state, self.rows, self.names = Instrument(), [], ()

    @staticmethod
    def analyze(bars: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not bars.isTable or not isinstance(bars.dataType, T.StructType):
            raise ValueError("indicator needs a table of bars and the names of indicators")
        have = {f.name: f for f in bars.dataType.fields}
        if missing := [c for c in INPUTS if c not in have]:
            raise ValueError(f"bars have no {', '.join(missing)}")
        wanted = _named(names.value or "")
        if unknown := [n for n in wanted if n not in FOLDED]:
            raise ValueError(f"{', '.join(unknown)}: not an indicator with a state; those over frames are views named ind_<name>" if all(n in FRAME for n in unknown) else f"no such indicator: {', '.join(unknown)}")
        return AnalyzeResult(T.StructType([*(have[c] for c in _KEYS), *(T.StructField(n, T.DoubleType()) for n in wanted)]))

    def eval(self, bars: Row, names: str) -> Iterator[tuple]:
        self.names = self.names or _named(names)
        self.rows.append(tuple(bars[c] for c in INPUTS))
        if len(self.rows) == ROWS:
            yield from self._done()

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from self._done()

    def _done(self) -> Iterator[tuple]:
        cols = {c: np.array([np.nan if r[i] is None else r[i] for r in self.rows], float) for i, c in enumerate(INPUTS) if i >= 3}
        out = np.full((len(self.names), len(self.rows)), np.nan)
        at = np.flatnonzero(~np.isnan(sum(cols.values())))
        if len(at):
            out[:, at] = self.state.run(self.names, **{n: c[at] for n, c in cols.items()})
        for r, values in zip(self.rows, out.T.tolist(), strict=True):
            yield (*r[:3], *(None if v != v else v for v in values))
        self.rows = []


def register(spark: SparkSession, bars: str | None = None) -> None:
    """The function `indicator`; and, over a view or table of bars, a temporary view ind_<name> (symbol, ts_us, seq, name) for all 87."""
    spark.udtf.register("indicator", udtf(_Indicator))
    if bars:
        for name in FRAME:
            spark.sql(framed_sql(f"select * from {bars}", [name])).createOrReplaceTempView(f"ind_{name}")
        for name in FOLDED:
            folded(spark.table(bars), (name,)).createOrReplaceTempView(f"ind_{name}")

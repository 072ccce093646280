"""SQL text for windows over one instrument's rows, shared by the engine's plans and their checks."""

from __future__ import annotations

KEY = "partition by symbol"
ORDER = "order by ts_us, seq"


def rows(n: int, end: int = 0) -> str:
    """The n rows that end `end` rows before the current one."""
    last = "current row" if end == 0 else f"{end} preceding"
    return f"({KEY} {ORDER} rows between {n - 1 + end} preceding and {last})"


def so_far(end: int = 0) -> str:
    """All rows up to the current one, or up to `end` rows before it."""
    last = "current row" if end == 0 else f"{end} preceding"
    return f"({KEY} {ORDER} rows between unbounded preceding and {last})"


RUN = f"({KEY} {ORDER})"
ALL = f"({KEY})"


def safe(top: str, bottom: str, eps: str = "1e-12") -> str:
    """top / bottom, null where the bottom is too small."""
    return f"(case when abs({bottom}) >= {eps} then ({top}) / nullif({bottom}, 0) end)"

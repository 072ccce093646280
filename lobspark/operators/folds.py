"""Indicators that carry a state from row to row.

Rows are dealt by instrument (long ones by blocks of time, each begun some rows early) and sorted within their partition; one
pass reads them batch by batch and keeps a fixed state per instrument, so memory does not grow with an instrument's history and no
instrument is gathered whole. Within a batch numpy works on whole columns: averages with a memory are affine
recursions, solved in blocks; moving frames reach back into the last rows of the batch before. Only what the
named indicators need is worked out. Nulls in a row's inputs leave its outputs null and the state as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.operators.segments import in_blocks, placed

INPUTS = ("symbol", "ts_us", "seq", "p", "h", "l", "v")
#: Rows of a block of a recursion.
BLOCK = 64


@lru_cache(maxsize=64)
def _powers(a: float) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(BLOCK)
    return np.tril(a ** np.maximum(steps[:, None] - steps[None, :], 0)).T, a ** (steps + 1.0)


def affine(b: np.ndarray, a: float, y: float) -> np.ndarray:
    """y[t] = a y[t-1] + b[t], from y before the first."""
    n = len(b)
    rows = np.zeros((-(-n // BLOCK), BLOCK))
    rows.ravel()[:n] = b
    inner, fade = _powers(a)
    rows = rows @ inner
    for r in rows:
        r += fade * y
        y = r[-1]
    return rows.ravel()[:n]


def faded(p: np.ndarray, c: np.ndarray, y: float) -> np.ndarray:
    """y[t] = y[t-1] + c[t] (p[t] - y[t-1]), from y before the first; c below 0.5 or so."""
    out = np.empty(len(p))
    for k in range(0, len(p), BLOCK // 2):
        keep = np.cumprod(1 - c[k : k + BLOCK // 2])
        out[k : k + BLOCK // 2] = keep * (y + np.cumsum(c[k : k + BLOCK // 2] * p[k : k + BLOCK // 2] / keep))
        y = out[min(len(p), k + BLOCK // 2) - 1]
    return out


class Smooth:
    """y = a y + gain x, seeded with the sum of the first n values times `seed`; leading NaNs are passed over."""

    def __init__(self, n: int, a: float, gain: float, seed: float) -> None:
        self.n, self.a, self.gain, self.seed, self.seen, self.y = n, a, gain, seed, 0, 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        at = np.flatnonzero(~np.isnan(x))
        v = x[at]
        if self.seen < self.n:
            take = min(self.n - self.seen, len(v))
            self.y, self.seen = self.y + float(v[:take].sum()), self.seen + take
            if self.seen == self.n and take:
                self.y *= self.seed
                out[at[take - 1]] = self.y
            at, v = at[take:], v[take:]
        if len(v):
            out[at] = affine(v * self.gain, self.a, self.y)
            self.y = float(out[at[-1]])
        return out


def ema(n: int) -> Smooth:
    return Smooth(n, 1 - 2 / (n + 1), 2 / (n + 1), 1 / n)


def wilder(n: int) -> Smooth:
    return Smooth(n, 1 - 1 / n, 1 / n, 1 / n)


class Frame:
    """The last n values of every row, itself among them; NaN where there are fewer. Leading NaNs count as none."""

    def __init__(self, n: int) -> None:
        self.n, self.last = n, np.full(n - 1, np.nan)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        whole = np.concatenate([self.last, x])
        self.last = whole[len(whole) - self.n + 1 :]
        return sliding_window_view(whole, self.n)


class Instrument:
    """State of one instrument. `of` gives a named column of the rows at hand, made at most once."""

    def __init__(self) -> None:
        self.kept: dict[str, object] = {}

    def run(self, names: tuple[str, ...], **inputs: np.ndarray) -> list[np.ndarray]:
        self.now = dict(inputs)
        with np.errstate(all="ignore"):
            return [self.of(n) for n in names]

    def of(self, name: str) -> np.ndarray:
        if name not in self.now:
            self.now[name] = RULES[name](self)
        return self.now[name]

    def by(self, key: str, make: Callable[[], Callable], name: str) -> np.ndarray:
        """What the kept operator `key` makes of a column."""
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key](self.of(name))

    def before(self, name: str) -> np.ndarray:
        """A column's values one row earlier."""
        return self.by(f"before {name}", lambda: Frame(2), name)[:, 0]


def _tr(s: Instrument) -> np.ndarray:
    h, l, c = s.of("h"), s.of("l"), s.of("before p")
    return np.where(np.isnan(c), h - l, np.maximum(h - l, np.maximum(np.abs(h - c), np.abs(l - c))))


def _cross(s: Instrument, sign: int) -> np.ndarray:
    now, was = sign * (s.of("ema_5") - s.of("ema_20")), sign * s.of("before gap")
    return np.where(np.isnan(now) | np.isnan(was), np.nan, (was <= 0) & (now > 0))


def _rsi(n: int) -> Callable[[Instrument], np.ndarray]:
    def rule(s: Instrument) -> np.ndarray:
        gain, loss = s.by(f"gain {n}", lambda: wilder(n), "up"), s.by(f"loss {n}", lambda: wilder(n), "down")
        # A fixed value of the definition followed here: without losses the ratio is 100, not infinite.
        return 100 - 100 / (1 + np.where(np.isnan(gain), np.nan, np.where(loss > 1e-12, gain / loss, 100.0)))

    return rule


def _kama(s: Instrument) -> np.ndarray:
    w, p = s.by("kama frame", lambda: Frame(11), "p"), s.of("p")
    path = np.abs(np.diff(w, axis=1)).sum(axis=1)
    ratio = np.where(path > 1e-12, np.abs(w[:, -1] - w[:, 0]) / path, 0.0)
    c = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    out = np.full(len(p), np.nan)
    at = np.flatnonzero(~np.isnan(w[:, 0]))
    if len(at):
        y = s.kept.get("kama")
        if y is None:  # starts at the price itself
            out[at[0]] = y = p[at[0]]
            at = at[1:]
        if len(at):
            out[at] = faded(p[at], c[at], y)
            y = out[at[-1]]
        s.kept["kama"] = y
    return out


def _di(way: str) -> Callable[[Instrument], np.ndarray]:
    def rule(s: Instrument) -> np.ndarray:
        total, moves = s.of("moved tr"), s.of(f"moved {way}")
        return np.where(np.isnan(total), np.nan, np.where(total > 0, 100 * moves / total, 0.0))

    return rule


def _moved(name: str) -> Callable[[Instrument], np.ndarray]:
    return lambda s: s.by(f"sum {name}", lambda: Smooth(14, 1 - 1 / 14, 1.0, 1.0), name)


def _dx(s: Instrument) -> np.ndarray:
    p, m = s.of("pdi_14"), s.of("mdi_14")
    return np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.where(np.isnan(p), np.nan, 0.0))


def _supertrend(s: Instrument) -> np.ndarray:
    """Bands that only tighten until the close breaks them: a rule of each row's own, so row by row."""
    p, c, atr, mid = s.of("p"), s.of("before p"), s.of("atr_14"), (s.of("h") + s.of("l")) / 2
    out = np.full(len(p), np.nan)
    upper, lower, trend = s.kept.get("bands", (None, None, 1.0))
    for i in np.flatnonzero(~np.isnan(atr)):
        top, bottom = mid[i] + 3 * atr[i], mid[i] - 3 * atr[i]
        upper = top if upper is None or top < upper or c[i] > upper else upper
        lower = bottom if lower is None or bottom > lower or c[i] < lower else lower
        trend = 1.0 if p[i] > upper else -1.0 if p[i] < lower else trend
        out[i] = trend
    s.kept["bands"] = (upper, lower, trend)
    return out


def _cci(s: Instrument) -> np.ndarray:
    w = s.by("cci frame", lambda: Frame(20), "typical")
    mean = w.mean(axis=1)
    spread = np.abs(w - mean[:, None]).mean(axis=1)
    return np.where(spread > 1e-12, (s.of("typical") - mean) / (0.015 * spread), np.nan)


def _squeeze(s: Instrument) -> np.ndarray:
    w, k = s.by("squeeze frame", lambda: Frame(20), "p"), s.of("keltner_width_20")
    mean, sd = w.mean(axis=1), w.std(axis=1)
    return np.where(np.isnan(k) | ~(np.abs(mean) > 1e-12), np.nan, 4 * sd / mean < k)


def _hurst(s: Instrument) -> np.ndarray:
    w = s.by("hurst frame", lambda: Frame(100), "p")
    out = np.full(len(w), np.nan)
    for k in range(0, len(w), 1024):
        off = w[k : k + 1024] - w[k : k + 1024].mean(axis=1, keepdims=True)
        sums, sd = off.cumsum(axis=1), np.sqrt((off * off).mean(axis=1))
        reach = sums.max(axis=1) - sums.min(axis=1)
        out[k : k + 1024] = np.where((sd > 1e-12) & (reach > 0), np.log(reach / sd) / np.log(100), np.nan)
    return out


def _after_first(name: str, value: Callable[[Instrument], np.ndarray]) -> Callable[[Instrument], np.ndarray]:
    """A column that an instrument's first row has not."""
    return lambda s: np.where(np.isnan(s.of("before p")), np.nan, value(s))


RULES: dict[str, Callable[[Instrument], np.ndarray]] = {
    **{f"before {c}": (lambda c: lambda s: s.before(c))(c) for c in ("p", "h", "l", "gap")},
    "change": lambda s: s.of("p") - s.of("before p"),
    "up": lambda s: np.maximum(s.of("change"), 0.0),
    "down": lambda s: np.maximum(-s.of("change"), 0.0),
    "gap": lambda s: s.of("ema_5") - s.of("ema_20"),
    "tr": _tr,
    "tr2": _after_first("tr2", lambda s: s.of("tr")),
    "rise": _after_first("rise", lambda s: np.where((s.of("h") - s.of("before h") > s.of("before l") - s.of("l")) & (s.of("h") > s.of("before h")), s.of("h") - s.of("before h"), 0.0)),
    "fall": _after_first("fall", lambda s: np.where((s.of("before l") - s.of("l") > s.of("h") - s.of("before h")) & (s.of("before l") > s.of("l")), s.of("before l") - s.of("l"), 0.0)),
    "moved tr": _moved("tr2"), "moved rise": _moved("rise"), "moved fall": _moved("fall"),
    "dx": _dx,
    "force": lambda s: np.where(np.isnan(s.of("before p")), 0.0, s.of("change") * s.of("v")),
    "typical": lambda s: (s.of("h") + s.of("l") + s.of("p")) / 3,
    "double": lambda s: s.by("double", lambda: ema(20), "ema_20"),
    "triple": lambda s: s.by("triple", lambda: ema(20), "double"),
    "atr_20": lambda s: s.by("atr_20", lambda: wilder(20), "tr"),
    **{f"ema_{n}": (lambda n: lambda s: s.by(f"ema_{n}", lambda: ema(n), "p"))(n) for n in (5, 12, 20, 26, 50, 200)},
    "dema_20": lambda s: 2 * s.of("ema_20") - s.of("double"),
    "tema_20": lambda s: 3 * s.of("ema_20") - 3 * s.of("double") + s.of("triple"),
    "kama_10": _kama,
    "golden_cross": lambda s: _cross(s, 1),
    "death_cross": lambda s: _cross(s, -1),
    "adx_14": lambda s: s.by("adx frame", lambda: Frame(14), "dx").mean(axis=1),
    "pdi_14": _di("rise"),
    "mdi_14": _di("fall"),
    "supertrend_14": _supertrend,
    **{f"rsi_{n}": _rsi(n) for n in (7, 14, 21)},
    "macd_line": lambda s: s.of("ema_12") - s.of("ema_26"),
    "macd_signal": lambda s: s.by("macd_signal", lambda: ema(9), "macd_line"),
    "macd_hist": lambda s: s.of("macd_line") - s.of("macd_signal"),
    "cci_20": _cci,
    "keltner_width_20": lambda s: np.where(s.of("ema_20") > 1e-12, 3 * s.of("atr_20") / s.of("ema_20"), np.nan),
    "atr_14": lambda s: s.by("atr_14", lambda: wilder(14), "tr"),
    "natr_14": lambda s: np.where(s.of("p") > 1e-12, 100 * s.of("atr_14") / s.of("p"), np.nan),
    "squeeze_signal": _squeeze,
    "force_index_13": lambda s: s.by("force_index", lambda: ema(13), "force"),
    "hurst_100": _hurst,
}


#: Rows of a block of a long instrument, and those before it that warm its state. After so many rows nothing is left of what a
#: recursion began with: of the longest average 1e-35, of the adaptive one at its slowest 1e-15.
BLOCK_ROWS, WARM = 1 << 17, 1 << 13
#: Rules whose state need not fade: not for blocks.
WHOLE = frozenset({"supertrend_14"})


def folded(bars: DataFrame, names: tuple[str, ...], partitions: int | None = None, rows: int = BLOCK_ROWS, warm: int = WARM, keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, ts_us, seq, the columns of bars in `keep` and the named fold indicators, for every row of bars.

    Instruments of more than `rows` rows are dealt in blocks of time, each folded from `warm` rows before it; the rules in WHOLE
    go row by row all the same."""
    base = bars.select(*INPUTS, *keep)
    if base.groupBy("symbol").count().where(F.col("count") > rows).isEmpty():
        return _folded(base, names, partitions, keep=keep)
    keys, apart = ["symbol", "ts_us", "seq"], tuple(n for n in names if n in WHOLE)
    rest = tuple(n for n in names if n not in WHOLE)
    if not rest:
        return _folded(base, names, partitions, keep=keep)
    full = F.lit(True)
    for c in INPUTS[3:]:
        full = full & F.col(c).isNotNull() & ~F.isnan(c)
    cut = in_blocks(placed(base.where(full), ["symbol"], ["ts_us", "seq"], {"place": F.lit(True)}), "place", rows, warm)
    found = _folded(cut.withColumn("own", F.floor(F.col("place") / rows) == F.col("block")), rest, None, ["block", "own"], keep).where("own").drop("own", "block")
    out = found.unionByName(base.where(~full).select(*keys, *keep, *[F.lit(None).cast("double").alias(n) for n in rest]))
    if apart:
        out = out.join(_folded(base.select(*INPUTS), apart, partitions), keys)
    return out.select(*keys, *keep, *names)


def _folded(base: DataFrame, names: tuple[str, ...], partitions: int | None, extra: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fold of each instrument, or, with block among the extra columns, of each block of one. Extra columns and `keep` pass through."""
    extra, n = extra or [], len(INPUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            s = b.column(0).to_pandas().to_numpy()
            block = b.column(n).to_numpy() if extra else np.zeros(len(s), int)
            cols = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(INPUTS) if i >= 3}  # null as NaN
            out = np.full((len(names), len(s)), np.nan)
            cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (block[1:] != block[:-1])) + 1), len(s)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a < z:
                    if state is None or (s[a], block[a]) != key:
                        key, state = (s[a], block[a]), Instrument()
                    at = a + np.flatnonzero(~np.isnan(sum(c[a:z] for c in cols.values())))
                    if len(at):
                        out[:, at] = state.run(names, **{n: c[at] for n, c in cols.items()})
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *b.columns[n:], *(pa.array(x, pa.float64(), from_pandas=True) for x in out)], ["symbol", "ts_us", "seq", *extra, *keep, *names])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    by = ["symbol", *extra[:1]]
    dealt = base.repartition(partitions, *by) if partitions else base.repartition(*by)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("symbol", "ts_us", "seq", *extra, *keep)] + [f"{x} double" for x in names])
    return dealt.sortWithinPartitions(*by, "ts_us", "seq").select(*INPUTS, *extra, *keep).mapInArrow(run, schema)

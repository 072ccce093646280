"""Rank and regression statistics by group, as sums and windows; small solves in numpy on one row a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.operators.segments import before_segment, in_blocks, placed, segmented
from lobspark.sources.shared import settled


def finite(x: str) -> Column:
    c = F.col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def average_rank(x: str | Column, keys: list[str]) -> Column:
    """1-based rank within keys; ties share their mean rank."""
    by = W.partitionBy(*keys)
    x = F.col(x) if isinstance(x, str) else x
    return F.rank().over(by.orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, x)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null for fewer than two rows or without variance."""
    var = F.var_pop(x) * F.var_pop(y)
    return F.when((F.count(F.lit(1)) >= 2) & (var > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(var)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 2, digits: int | None = None) -> DataFrame:
    """(keys, ic, n): rank correlation of the pairs with both values finite; pairs are filtered before they are ranked."""
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    pairs = df.select(*keys, r(finite(x)).alias("__x"), r(finite(y)).alias("__y")).where("__x is not null and __y is not null")
    ranked = pairs.withColumns({"__rx": average_rank("__x", keys), "__ry": average_rank("__y", keys)})
    out = ranked.groupBy(*keys).agg(correlation("__rx", "__ry").alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def large_keys(df: DataFrame, keys: list[str], rows: int = 16_000_000) -> DataFrame | None:
    """The keys with more than `rows` rows, or None if there are none: what ic_table has to rank in parts. Takes a pass over df."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select(*keys)
    return None if found.isEmpty() else found


def rank_in_parts(df: DataFrame, keys: list[str], x: str, parts: int = 256) -> DataFrame:
    """df with `r:<x>`, the average rank of x within keys, without any key in one task. Values are counted first, so that ties are one
    row; distinct values are dealt by key and by which of the key's approximate quantiles they lie between, counts run up there
    and on from the parts below, and rows take the rank of their value."""
    counts = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10 * parts).alias("__cuts"))
    values = counts.join(cuts, keys).withColumn("__seg", F.size(F.filter("__cuts", lambda c: c < F.col(x)))).drop("__cuts")
    below = before_segment(values, keys, {"__below": F.sum("__n")})
    run = W.partitionBy(*keys, "__seg").orderBy(x).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = values.withColumn("__r", F.sum("__n").over(run) - (F.col("__n") - 1) / 2.0).join(below, [*keys, "__seg"])
    return df.join(ranks.select(*keys, x, (F.col("__r") + F.col("__below")).alias(f"r:{x}")), [*keys, x])


def middle(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, x): the upper median of each key's values. Values are counted first, and counts run up in parts, as in rank_in_parts."""
    counts = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__n"))
    values = segmented(counts, keys, x)
    below = before_segment(values, keys, {"__below": F.sum("__n")})
    run = W.partitionBy(*keys, "__seg").orderBy(x).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__m"))
    upto = values.withColumn("__upto", F.sum("__n").over(run)).join(below, [*keys, "__seg"]).join(total, keys)
    upto = upto.withColumn("__upto", F.col("__upto") + F.col("__below"))
    at = F.floor(F.col("__m") / 2) + 1
    return upto.where((F.col("__upto") >= at) & (F.col("__upto") - F.col("__n") < at)).select(*keys, x)


def spearman_in_parts(df: DataFrame, keys: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """(keys, ic, n) as spearman gives, for keys of any size."""
    pairs = df.select(*keys, finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    ranked = rank_in_parts(rank_in_parts(pairs, keys, "x"), keys, "y")
    out = ranked.groupBy(*keys).agg(correlation("`r:x`", "`r:y`").alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def ic_table(df: DataFrame, keys: list[str], signals: list[str], returns: list[str], least: int = 10, digits: int | None = 9, large: DataFrame | None = None) -> DataFrame:
    """(keys, indicator, horizon, ic, n) for every signal and return that have pairs; null for fewer than `least`.

    Rows are read in chunks. Of each chunk and column the sorted values go to one task a key and column, a few packed bytes a
    value; the ranks come back to the chunk in that order, where ranks of signals and returns meet row by row, as sums. A pair is ranked
    among the rows that have both values: beside a column's ranks come, for each column of the other side that lacks values, by how much
    its missing rows lower them. No task holds more of a key than a column or a chunk. Keys in `large` (from large_keys) are ranked
    in parts instead, by value; the results are the same.
    """
    if large is not None:
        rounded = (lambda c: F.round(finite(c), digits)) if digits is not None else finite
        some = df.join(F.broadcast(large), keys, "left_semi").select(*keys, *[rounded(c).alias(c) for c in dict.fromkeys([*returns, *signals])])
        long = some.unpivot([*keys, *returns], signals, "indicator", "__x").where("__x is not null").unpivot([*keys, "indicator", "__x"], returns, "horizon", "__y")
        split = spearman_in_parts(long, [*keys, "indicator", "horizon"], "__x", "__y", max(least, 2))
        rest = ic_table(df.join(F.broadcast(large), keys, "left_anti"), keys, signals, returns, least, digits)
        return rest.unionByName(split)
    r = (lambda c: F.round(finite(c), digits)) if digits is not None else finite
    # By place: a signal may be a return, too, and then is a column of either side.
    wide = df.select(*keys, *[r(c).alias(f"__v{i}") for i, c in enumerate([*signals, *returns])])
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    by = ", ".join(f"{k} {types[k]}" for k in keys)
    k, m, h = len(keys), len(signals), len(returns)
    other = lambda j: range(m, m + h) if j < m else range(m)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        for nth, t in enumerate(_gathered(batches, CHUNK)):
            codes = np.zeros(t.num_rows, np.int64)
            for c in t.columns[:k]:
                codes = np.unique(codes * (t.num_rows + 1) + c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                own = t.take(pa.array(at))
                values = [own.column(k + j).to_numpy() for j in range(m + h)]  # null as NaN
                lacks = [np.isnan(v) for v in values]
                out = []
                for j, v in enumerate(values):
                    place = np.argsort(v, kind="stable")[: len(v) - int(lacks[j].sum())]
                    missing = {int(o): _packed(np.flatnonzero(lacks[o][place])) for o in other(j) if lacks[o].any()}
                    out.append((j, _packed_values(v[place], digits), place.astype(np.uint16).tobytes(), list(missing), list(missing.values())))
                n = len(out)
                same = [pa.array([c[0].as_py()] * n, c.type) for c in own.columns[:k]]
                cols = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())))]
                yield pa.RecordBatch.from_arrays([*same, pa.array([task + nth] * n, pa.int64()), *cols], [*keys, *names])

    def rank(key: tuple, t: pa.Table) -> pa.Table:
        runs = [_unpacked_values(b.as_py()) for b in t.column("run")]
        sizes = np.array([len(v) for v in runs])
        whole = np.concatenate(runs)
        ends, total = np.cumsum(sizes), len(whole)
        twice = _twice_ranks(whole)
        lost: dict[int, list[np.ndarray]] = {}
        for v, cols, at in zip(runs, t.column("lacking").to_pylist(), t.column("missing").to_pylist(), strict=True):
            for o, b in zip(cols, at, strict=True):
                lost.setdefault(o, []).append(v[_unpacked(b)])
        lost = {o: np.sort(np.concatenate(v)) for o, v in lost.items()}
        lost = {o: v for o, v in lost.items() if len(v)}
        ranks, down = [], []
        for v, e in zip(runs, ends, strict=True):
            ranks.append(_packed(twice[e - len(v) : e]))
            down.append([_packed(np.searchsorted(z, v) + np.searchsorted(z, v, "right")) for z in lost.values()])
        n = t.num_rows
        cols = [pa.array(ranks, pa.binary()), pa.array([total] * n, pa.int64()), pa.array([list(lost)] * n, pa.list_(pa.int32())), pa.array(down, pa.list_(pa.binary()))]
        return pa.table([*(t.column(c) for c in [*keys, "chunk", "col", "place"]), *cols], [*keys, "chunk", "col", "place", "ranks", "total", "lacking", "down"])

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        found, size, out = {}, 1, []
        for j, place, ranks, total, lacking, down in zip(*(t.column(c).to_pylist() for c in ("col", "place", "ranks", "total", "lacking", "down")), strict=True):
            place = np.frombuffer(place, np.uint16)
            found[j] = (place, _unpacked(ranks) - total, {o: _unpacked(d) for o, d in zip(lacking, down, strict=True)})
            size = max(size, int(place.max(initial=0)) + 1)

        def column(j: int, o: int) -> np.ndarray:
            place, ranks, down = found[j]
            full = np.full(size, np.nan)
            full[place] = ranks - down[o] if o in down else ranks
            return full

        ys = {(j, o): column(j, o) for j in range(m, m + h) for o in {-1, *found[j][2]}}
        for i in range(m):
            xs = {o: column(i, o) for o in {-1, *found[i][2]}}
            for j in range(m, m + h):
                x, y = xs[j if j in xs else -1], ys[j, i if (j, i) in ys else -1]
                ok = ~(np.isnan(x) | np.isnan(y))
                if ok.any():
                    x, y = x[ok], y[ok]
                    out.append((i, j - m, len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y))
        same = [pa.array([c.as_py()] * len(out), t.schema.field(n).type) for c, n in zip(key, keys, strict=False)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
        return pa.table([*same, *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], [*keys, "i", "j", "n", "x", "y", "xx", "yy", "xy"])

    names = ["chunk", "col", "run", "place", "lacking", "missing"]
    # Kept, as a task that is run again may get its rows in another order, and a chunk's columns belong together.
    runs = settled(wide.mapInArrow(cut, f"{by}, chunk long, col int, run binary, place binary, lacking array<int>, missing array<binary>"))
    ranks = runs.groupBy(*keys, "col").applyInArrow(rank, f"{by}, chunk long, col int, place binary, ranks binary, total long, lacking array<int>, down array<binary>")
    sums = ranks.groupBy(*keys, "chunk").applyInArrow(meet, f"{by}, i int, j int, n long, x double, y double, xx double, yy double, xy double")
    sums = sums.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    # Twice the ranks, less a number that a column's rows share: equal ranks leave no more than what rounding does.
    part = lambda a, b: F.col(a + b) - F.col(a) * F.col(b) / F.col("n")
    varies = (part("x", "x") > 1e-11 * F.col("xx")) & (part("y", "y") > 1e-11 * F.col("yy"))
    ic = F.when((F.col("n") >= max(least, 2)) & varies, part("x", "y") / F.sqrt(part("x", "x")) / F.sqrt(part("y", "y")))
    named = lambda c, of: F.element_at(F.array(*map(F.lit, of)), F.col(c) + 1)
    return sums.select(*keys, named("i", signals).alias("indicator"), named("j", returns).alias("horizon"), ic.alias("ic"), "n")


#: Rows of a chunk; places in it are of two bytes.
CHUNK = 1 << 16


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches' rows, `rows` at once."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, rows - n))
            n, b = n + held[-1].num_rows, b.slice(rows - n)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _packed(v: np.ndarray) -> bytes:
    """Whole numbers in ascending order, as compressed differences."""
    d = np.diff(v.astype(np.int64), prepend=np.int64(0))
    return np.int64(len(d)).tobytes() + pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    if not n:
        return np.zeros(0, np.int64)
    d = pa.decompress(b[8:], 8 * n, "zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _packed_values(v: np.ndarray, digits: int | None) -> bytes:
    """Doubles in ascending order: as multiples of the last digit, if that gives just them, or as the numbers that their bits are, in their order."""
    if digits is not None and (not len(v) or max(abs(v[0]), abs(v[-1])) < 2.0**52 / 10.0**digits):
        whole = np.rint(v * 10.0**digits)
        if np.array_equal(whole / 10.0**digits, v):
            return int(digits).to_bytes(1, "little") + _packed(whole)
    bits = (v + 0.0).view(np.int64)  # -0.0 is 0.0
    return b"\xff" + _packed(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def _unpacked_values(b: bytes) -> np.ndarray:
    v = _unpacked(b[1:])
    return v / 10.0 ** b[0] if b[0] != 0xFF else (v ^ ((v >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _twice_ranks(v: np.ndarray) -> np.ndarray:
    """Twice the average rank of each value, a whole number."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(s))
    out = np.empty(len(v), np.int64)
    out[order] = np.repeat(first + last + 1, last - first)
    return out


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    pairs = df.select(*keys, finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    return pairs.groupBy(*keys).agg(correlation("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def icir(df: DataFrame, keys: list[str], ic: str = "ic") -> DataFrame:
    """Mean over sample deviation of ICs; null for fewer than two or without deviation."""
    sd = F.stddev_samp(ic)
    return df.where(F.col(ic).isNotNull()).groupBy(*keys).agg(F.when(sd > 0, F.avg(ic) / sd).alias("icir"), F.count(F.lit(1)).alias("n"))


def windowed(df: DataFrame, keys: list[str], order: list[str], window: int, step: int) -> DataFrame:
    """Rows with the window they are in: (window_idx, starting at window_idx * step), a row for each; only whole windows."""
    rows = placed(df, keys, order, {"__rn": F.lit(True)})
    first = F.greatest(F.lit(0), F.ceil((F.col("__rn") - window + 1) / step)).cast("int")
    last = F.floor(F.col("__rn") / step).cast("int")
    rows = rows.withColumns({"__a": first, "__b": last}).where("__a <= __b").withColumn("window_idx", F.explode(F.sequence("__a", "__b")))
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys, "window_idx")))
    return rows.where(F.col("__n") == window).drop("__a", "__b", "__rn", "__n")


def rolling_ic(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, window: int, step: int, digits: int | None = None) -> DataFrame:
    """(keys, window_idx, center, ic): rank correlation in sliding windows of finite pairs."""
    pairs = df.select(*keys, *order, finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    out = spearman(windowed(settled(pairs), keys, order, window, step), [*keys, "window_idx"], "x", "y", 2, digits)
    return out.select(*keys, "window_idx", (F.col("window_idx") * step + window // 2).alias("center"), "ic")


def regime_ic(df: DataFrame, keys: list[str], regime: str, x: str, y: str, digits: int | None = None) -> DataFrame:
    """(keys, quartile 1-4, ic): rank correlation by quartile of the regime; what four does not divide goes to the last."""
    rows = df.select(*keys, finite(regime).alias("g"), finite(x).alias("x"), finite(y).alias("y"), "ts_us", "seq").where("g is not null and x is not null and y is not null")
    by = W.partitionBy(*keys)
    rows = rows.withColumns({"__rn": F.row_number().over(by.orderBy("g", "ts_us", "seq")) - 1, "__n": F.count(F.lit(1)).over(by)}).where("__n >= 4")
    rows = rows.withColumn("quartile", F.least(F.floor(F.col("__rn") / F.floor(F.col("__n") / 4)), F.lit(3)).cast("int") + 1)
    return spearman(rows, [*keys, "quartile"], "x", "y", 2, digits)


def ols_sums(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """(keys, n, xtx, xty, yy): what a least-squares fit with a constant needs, as sums: one row a group, combined map-side."""
    cols = ["__one", *xs]
    rows = df.select(*keys, F.lit(1.0).alias("__one"), *[finite(c).alias(c) for c in dict.fromkeys([*xs, y])]).na.drop(subset=[*xs, y])
    xtx = [F.sum(F.col(a) * F.col(b)) for a in cols for b in cols]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*xtx).alias("xtx"), F.array(*[F.sum(F.col(a) * F.col(y)) for a in cols]).alias("xty"), F.sum(F.col(y) * F.col(y)).alias("yy"))


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """a x = b by elimination with row pivots; None if a pivot is below 1e-12."""
    m = np.concatenate([a, b.reshape(len(a), -1)], axis=1).astype(float)
    k = len(a)
    for i in range(k):
        j = i + int(np.argmax(np.abs(m[i:, i])))
        if abs(m[j, i]) < 1e-12:
            return None
        m[[i, j]] = m[[j, i]]
        m[i] /= m[i, i]
        rest = np.arange(k) != i
        m[rest] -= np.outer(m[rest, i], m[i])
    return m[:, k:].reshape(b.shape)


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """(keys, n, beta (constant first), ss_res): least squares by group; null beta if singular."""
    return solved_sums(ols_sums(df, keys, y, xs), keys, len(xs) + 1)


def solved_sums(sums: DataFrame, keys: list[str], k: int, row: int | None = None) -> DataFrame:
    """(keys, n, beta, ss_res) of ols_sums, and, if asked for, `inverse`: a row of the inverse of X'X."""

    def fit(batches):
        for b in batches:
            betas, res, rows = [], [], []
            for xtx, xty, yy in zip(b.column("xtx").to_pylist(), b.column("xty").to_pylist(), b.column("yy").to_pylist(), strict=True):
                v = np.array(xty)
                found = solved(np.array(xtx).reshape(k, k), np.column_stack([v, np.eye(k)]))
                betas.append(None if found is None else found[:, 0].tolist())
                res.append(None if found is None else float(yy - found[:, 0] @ v))
                rows.append(None if found is None or row is None else found[row, 1:].tolist())
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], b.column("n"), pa.array(betas, doubles), pa.array(res, pa.float64()), pa.array(rows, doubles)], [*keys, "n", "beta", "ss_res", "inverse"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in keys), "n long, beta array<double>, ss_res double, inverse array<double>"])
    out = sums.mapInArrow(fit, schema)
    return out if row is not None else out.drop("inverse")


#: Places of a block of a series: whole steps of a rolling window, and at least as long as any lag.
BLOCK = 63 * 128


def lagged(u: np.ndarray, own: int, lag: int) -> float:
    """sum of u_t u_(t-l) (1 - l / (lag + 1)) over l = 1..lag and the t from `own` on, by FFT."""
    w = np.concatenate([[0.0], 1 - np.arange(1, lag + 1) / (lag + 1)])
    size = 1 << (len(u) + lag).bit_length()
    past = np.fft.irfft(np.fft.rfft(u, size) * np.fft.rfft(w, size), size)[: len(u)]
    return float(u[own:] @ past[own:])


def ranked(v: np.ndarray) -> np.ndarray:
    """Average ranks."""
    _, at, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[at]


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    a, b = ranked(x), ranked(y)
    a, b = a - a.mean(), b - b.mean()
    var = (a @ a) * (b @ b)
    return float(a @ b / np.sqrt(var)) if var > 0 else None


def series_facts(df: DataFrame, keys: list[str], order: list[str], xs: list[str], ys: dict[str, int], window: int, step: int, parts: int | None = None) -> DataFrame:
    """(keys, feature, horizon, n, beta, nw_t, icir) for every x and y: slope, its t by HAC errors with Bartlett weights over the y's
    lags, and the mean over deviation of rank correlations in sliding windows; finite pairs alone.

    A pair's rows get their place among its finite rows, and are dealt in blocks of places, with the rows before that
    lags reach and the rows after that windows reach. For a slope, HAC errors need one number a row, (x - mean x) times the
    residual, and its lagged products, summed by block. No series is gathered.
    """
    if BLOCK % step or BLOCK < max([*ys.values(), window]):
        raise ValueError("windows start at whole blocks, and a block is at least as long as a lag or a window")
    base = df.select(*keys, *order, *[finite(c).alias(c) for c in dict.fromkeys([*xs, *ys])])
    pairs = {f"i:{x}:{y}": F.col(x).isNotNull() & F.col(y).isNotNull() for x in xs for y in ys}
    rows = settled(placed(settled(base), keys, order, pairs, **({} if parts is None else {"parts": parts, "least": 0})).drop(*order))
    one = [F.struct(F.lit(x).alias("feature"), F.lit(y).alias("horizon"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(f"`i:{x}:{y}`").alias("i"), F.lit(lag).alias("lag")) for x in xs for y, lag in ys.items()]
    long = rows.select(*keys, F.explode(F.array(*one)).alias("s")).select(*keys, "s.*").where("i is not null")
    by = [*keys, "feature", "horizon"]
    var, co = F.var_pop("x"), F.covar_pop("x", "y")
    n = F.count(F.lit(1))
    ok = (n >= 4) & (n * var >= 1e-12)
    fits = long.groupBy(*by).agg(n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), var.alias("vx"), F.when(ok, F.try_divide(co, var)).alias("beta"))
    rows = in_blocks(long, "i", BLOCK, F.col("lag"), window - step).join(fits, by)
    u = (F.col("x") - F.col("mx")) * (F.col("y") - F.col("my") - F.col("beta") * (F.col("x") - F.col("mx")))
    rows = rows.select(*by, "block", "i", "lag", "x", "y", u.alias("u"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(key: tuple, t: pa.Table) -> pa.Table:
        i, x, y, u = (t.column(c).to_numpy() for c in ("i", "x", "y", "u"))
        at = np.argsort(i)
        i, x, y, u = i[at], x[at], y[at], u[at]
        start = key[-1].as_py() * BLOCK
        own, end = np.searchsorted(i, [start, start + BLOCK])
        s = u[own:end] @ u[own:end] + 2 * lagged(u[:end], int(own), int(t.column("lag")[0].as_py())) if not np.isnan(u).any() else None
        ics = [rank_correlation(x[a : a + window], y[a : a + window]) for a in range(int(own), int(end), step) if a + window <= len(i)]
        out = [pa.array([k.as_py()], t.schema.field(c).type) for k, c in zip(key[:-1], by, strict=True)]
        return pa.table([*out, pa.array([s], pa.float64()), pa.array([[r for r in ics if r is not None]], pa.list_(pa.float64()))], [*by, "s", "ics"])

    done = rows.groupBy(*by, "block").applyInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in by) + ", s double, ics array<double>")
    sums = done.groupBy(*by).agg(F.sum("s").alias("s"), F.flatten(F.collect_list("ics")).alias("ics"))  # a number for each step of a series
    mean = F.try_divide(F.aggregate("ics", F.lit(0.0), lambda a, r: a + r), F.size("ics"))
    sd = F.sqrt(F.try_divide(F.aggregate("ics", F.lit(0.0), lambda a, r: a + (r - F.col("__m")) * (r - F.col("__m"))), F.size("ics") - 1))
    out = fits.join(sums, by).withColumn("__m", F.when(F.size("ics") > 1, mean))
    lag = F.element_at(F.create_map(*[v for y, k in ys.items() for v in (F.lit(y), F.lit(k))]), F.col("horizon"))
    se = F.try_divide(F.sqrt(F.greatest("s", F.lit(0.0))), F.col("n") * F.col("vx"))
    out = out.withColumns({"sd": F.when(F.size("ics") > 1, sd), "se": F.when(F.col("n") > 2 + lag, se)})
    return out.select(*by, "n", "beta", F.when(F.col("se") > 0, F.try_divide("beta", "se")).alias("nw_t"), F.when(F.col("sd") > 0, F.try_divide("__m", "sd")).alias("icir"))


def dickey_fuller(df: DataFrame, keys: list[str], order: list[str], xs: list[str], lags: int, parts: int | None = None, block: int = 1 << 16) -> DataFrame:
    """(keys, feature, t): augmented Dickey-Fuller t with a constant and HAC errors, null if a series is too short or singular.

    Differences and their lags are taken within blocks of places with a halo, the fit is sums of products, and the t
    needs one number a row: the row of the inverse that belongs to the level, times the regressors and the residual.
    """
    base = df.select(*keys, *order, *[finite(c).alias(c) for c in xs])
    rows = settled(placed(settled(base), keys, order, {f"i:{x}": F.col(x).isNotNull() for x in xs}, **({} if parts is None else {"parts": parts, "least": 0})).drop(*order))
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("x"), F.col(f"`i:{x}`").alias("i")) for x in xs])).alias("s")).select(*keys, "s.*").where("i is not null")
    by, back = [*keys, "feature"], max(lags, 1)
    w = W.partitionBy(*by, "block").orderBy("i")
    cut = in_blocks(long, "i", block, lags + 1 + back).withColumn("own", F.floor(F.col("i") / block) == F.col("block"))
    cut = cut.withColumn("y1", F.lag("x").over(w)).withColumn("d0", F.col("x") - F.col("y1"))
    names = ["y1", *[f"d{k}" for k in range(1, lags + 1)]]
    cut = cut.withColumns({f"d{k}": F.lag("d0", k).over(w) for k in range(1, lags + 1)}).withColumn("whole", F.col("i") > lags)
    fits = solved_sums(ols_sums(cut.where("own and whole"), by, "d0", names), by, len(names) + 1, 1)
    cut = cut.join(fits.select(*by, "n", "beta", "inverse"), by)
    terms = [F.lit(1.0), *map(F.col, names)]
    hat = sum((F.element_at("beta", j + 1) * c for j, c in enumerate(terms)), F.lit(0.0))
    v = sum((F.element_at("inverse", j + 1) * c for j, c in enumerate(terms)), F.lit(0.0))
    cut = cut.withColumn("u", F.when(F.col("whole"), v * (F.col("d0") - hat)))
    past = sum((F.coalesce(F.lag("u", k).over(w), F.lit(0.0)) * (2 * (1 - k / (back + 1))) for k in range(1, back + 1)), F.lit(0.0))
    cut = cut.withColumn("s", F.col("u") * (F.col("u") + past)).where("own and whole")
    out = cut.groupBy(*by).agg(F.first("n").alias("n"), F.first("beta").alias("beta"), F.sum("s").alias("s"))
    enough = (F.col("n") >= lags + 4) & (F.col("n") > len(names) + 1 + back) & (F.col("s") > 0)
    found = out.select(*by, F.when(enough, F.try_divide(F.element_at("beta", 2), F.sqrt("s"))).alias("t"))
    return long.select(*by).distinct().join(found, by, "left")


def ljung_box(df: DataFrame, keys: list[str], order: list[str], x: str, lags: int = 20) -> DataFrame:
    """(keys, n, q): n(n+2) sum rho_k^2 / (n-k), from lagged products in blocks of places with a halo of the rows that lags reach."""
    base = settled(df.select(*keys, *order, finite(x).alias("x")).where("x is not null"))
    means = base.groupBy(*keys).agg(F.avg("x").alias("__mean"))
    rows = in_blocks(placed(base, keys, order, {"__i": F.lit(True)}), "__i", BLOCK, lags).join(means, keys).withColumn("c", F.col("x") - F.col("__mean"))
    w = W.partitionBy(*keys, "block").orderBy("__i")
    rows = rows.select(*keys, "block", "__i", "c", *[F.lag("c", k).over(w).alias(f"c{k}") for k in range(1, lags + 1)]).where(F.floor(F.col("__i") / BLOCK) == F.col("block"))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c") * F.col("c")).alias("v"), *[F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    q = sum((F.pow(F.col(f"g{k}") / F.col("v"), 2) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return sums.select(*keys, "n", F.when((F.col("v") > 0) & (F.col("n") > lags), F.col("n") * (F.col("n") + 2) * q).alias("q"))


def vif(df: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """(keys, feature, vif): diagonal of the inverse of the correlation matrix of the complete rows; null if singular or n < k + 2."""
    rows = df.select(*keys, *[finite(c).alias(c) for c in xs]).na.drop(subset=xs)
    k = len(xs)
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.covar_pop(a, b) for a in xs for b in xs]).alias("cov"))

    def invert(batches):
        for b in batches:
            out = [[] for _ in range(len(keys) + 2)]
            for i in range(b.num_rows):
                cov, n = np.array(b.column("cov")[i].as_py()).reshape(k, k), b.column("n")[i].as_py()
                sd = np.sqrt(np.diag(cov))
                inv = None
                if n >= k + 2 and (sd > 0).all():
                    inv = solved(cov / np.outer(sd, sd), np.eye(k))
                for j, name in enumerate(xs):
                    for c, v in zip(out, [*[b.column(key)[i].as_py() for key in keys], name, None if inv is None else float(inv[j, j])], strict=True):
                        c.append(v)
            types = [b.schema.field(key).type for key in keys] + [pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [*keys, "feature", "vif"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in keys), "feature string, vif double"])
    return sums.mapInArrow(invert, schema)


def ic_decay(df: DataFrame, keys: list[str], tau: str = "tau", ic: str = "ic") -> DataFrame:
    """(keys, a, tau_star, offset, r2): ic = a exp(-tau / tau*) + offset by a grid of tau* from 0.5 to 600 in steps of 0.5;
    the smallest tau* of the best fit. Needs three points; null if they do not vary."""
    points = df.select(*keys, F.col(tau).cast("double").alias("t"), finite(ic).alias("y")).where("y is not null")
    sums = points.groupBy(*keys).agg(F.collect_list(F.struct("t", "y")).alias("pts")).where(F.size("pts") >= 3)
    grid = sums.withColumn("s", F.explode(F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: i * 0.5))).withColumn("pt", F.explode("pts"))
    fits = grid.withColumn("x", F.exp(-F.col("pt.t") / F.col("s"))).groupBy(*keys, "s").agg(F.var_pop("x").alias("vx"), F.var_pop("pt.y").alias("vy"), F.covar_pop("x", "pt.y").alias("c"), F.avg("x").alias("mx"), F.avg("pt.y").alias("my"))
    fits = fits.where("vx > 1e-24 and vy > 0").withColumn("r2", F.col("c") * F.col("c") / (F.col("vx") * F.col("vy")))
    best = fits.groupBy(*keys).agg(F.max_by(F.struct("s", "c", "vx", "mx", "my", "r2"), F.struct(F.col("r2"), -F.col("s"))).alias("b"))
    a = F.col("b.c") / F.col("b.vx")
    return best.select(*keys, a.alias("a"), F.col("b.s").alias("tau_star"), (F.col("b.my") - a * F.col("b.mx")).alias("offset"), F.col("b.r2").alias("r2"))

"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors are compared within their label (and number of components) only. The top of a label's tree is made of nested
levels: a cell of more than `block` rows that are not all alike is split into at most CELLS cells about rows of a bounded sample
by hash, each picked as the farthest from those before; every row goes to its nearest, and every cell keeps its exact covering radius; and so on, until cells are blocks. Pairs of
cells are made from the top down: only the children of a pair that its covering radii leave open are paired. What is then
still larger than a block (copies, or rows below the last level) is dealt by hash into blocks of about `block` rows;
two blocks that may link, and each block with itself, are
one task, so that no label or cell, however large, is gathered in one place. In a task each block becomes a
cover tree of nested levels whose radii halve: every node covers its rows within its level's radius of a
centre row, and keeps the exact covering radius. The two trees are walked together, level by level:
a pair of nodes is dropped if their centres are farther apart than the threshold and both covering radii
allow a link, taken whole if every row of one must link with every row of the other, and otherwise
split into its children. Leaves are so small that their rows all link; what is left between leaves is
compared row by row in double precision. Taken pairs are counted as products and tied by one link, so
a large group of copies makes neither pairs nor rows.

Distances are chords between unit vectors; bounds leave a margin of 1e-6, so that rounding never decides.
Null vectors, zero vectors, vectors with null or non-finite components and rows without a label link with
nothing and stay as their own components. A repeated vec_id is one more vector that links like any other, and
links are counted by rows; a row without a vec_id links too, but names a component only if no other row of it has an
id (then component_id and kept are null). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import in_batches, joined_small, min_components, settled
from lobspark.llm.forest import labels

COSINE = 0.93
#: Radii of the levels; the last is so small that two rows of one leaf are within the threshold.
RADII = (2.0, 1.0, 0.5, 0.25, 0.125)
MARGIN = 1e-6
BLOCK = 4096
#: Children of a cell, and levels of cells: a cell's number is its path, after a leading 1.
CELLS, LEVELS = 64, 5
#: Bits of a block's number in its cell.
SUB = 32


class Tree:
    """perm: rows in the order of the leaves. levels: (start, end, centre row, covering radius) of each level's nodes, by start."""

    def __init__(self, x: np.ndarray, radii: tuple[float, ...]) -> None:
        self.x = x
        groups = [np.arange(len(x))]
        self.levels = []
        for i, r in enumerate(radii):
            if i:
                groups = [g for group in groups for g in (cover(x, group, r) if len(group) > 1 else [group])]
            perm = np.concatenate(groups)
            end = np.cumsum([len(g) for g in groups])
            start = np.concatenate(([0], end[:-1]))
            centre = perm[start]
            far = chord(np.einsum("ij,ij->i", x[perm], x[np.repeat(centre, end - start)]))
            self.levels.append((start, end, centre, np.maximum.reduceat(far, start)))
        self.perm = perm


def chord(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))


def cover(x: np.ndarray, rows: np.ndarray, r: float) -> list[np.ndarray]:
    """rows in groups, each within r of its first; no two of these are within r."""
    out = []
    while len(rows):
        heads = rows[:64]
        near = chord(x[rows] @ x[heads].T) <= r
        near[np.arange(len(heads)), np.arange(len(heads))] = True
        chosen: list[int] = []
        for j in range(len(heads)):
            if not near[j, chosen].any():
                chosen.append(j)
        own = near[:, chosen]
        first = np.where(own.any(axis=1), own.argmax(axis=1), -1)
        for k in range(len(chosen)):
            out.append(rows[first == k])
        rows = rows[first < 0]
    return out


def children(level: tuple, below: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each node the range of its children."""
    return np.searchsorted(below[0], level[0]), np.searchsorted(below[0], level[1])


def walked(a: Tree, b: Tree, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of each row of a, and of b, and ties (row of a, row of b) that hold all linked rows together.
    With same, b is a, and counts are all in the first."""
    limit = np.sqrt(2.0 - 2.0 * cosine)
    ca, cb = np.zeros(len(a.x) + 1), np.zeros(len(b.x) + 1)
    ties: list[tuple[np.ndarray, np.ndarray]] = []
    u = v = np.zeros(1, int)
    last = len(a.levels) - 1

    def sift(la: tuple, lb: tuple, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes the pairs that link whole, and returns those left open."""
        slack = la[3][u] + lb[3][v]
        whole = d + slack <= limit - MARGIN
        if whole.any():
            p, q = u[whole], v[whole]
            na, nb = la[1][p] - la[0][p], lb[1][q] - lb[0][q]
            np.add.at(ca, la[0][p], nb)
            np.add.at(ca, la[1][p], -nb)
            if same:  # a pair of different nodes counts for both; a node's pair with itself not for a row and itself
                own = p == q
                np.add.at(ca, la[0][q], np.where(own, -1, na))
                np.add.at(ca, la[1][q], np.where(own, 1, -na))
            else:
                np.add.at(cb, lb[0][q], na)
                np.add.at(cb, lb[1][q], -na)
            # Every row of one side with the other's first row, and back.
            for i in np.unique(p, return_index=True)[1]:
                ties.append((a.perm[la[0][p[i]] : la[1][p[i]]], np.full(na[i], b.perm[lb[0][q[i]]])))
            for i in np.unique(q, return_index=True)[1]:
                ties.append((np.full(nb[i], a.perm[la[0][p[i]]]), b.perm[lb[0][q[i]] : lb[1][q[i]]]))
            ties.append((a.perm[la[0][p]], b.perm[lb[0][q]]))
        open_ = ~whole & (d - slack <= limit + MARGIN)
        return u[open_], v[open_]

    u, v = sift(a.levels[0], b.levels[0], u, v, chord(np.einsum("ij,ij->i", a.x[a.levels[0][2][u]], b.x[b.levels[0][2][v]])))
    for depth in range(1, last + 1):
        la, lb = a.levels[depth], b.levels[depth]
        (a0, a1), (b0, b1) = children(a.levels[depth - 1], la), children(b.levels[depth - 1], lb)
        us, vs = [], []
        size = (a1 - a0)[u] * (b1 - b0)[v]
        for i in np.flatnonzero(size > 4096):  # many children: by matrix products
            lo, hi, s, e = a0[u[i]], a1[u[i]], b0[v[i]], b1[v[i]]
            cols = b.x[lb[2][s:e]].T
            for k in range(lo, hi, 256):
                rows = np.arange(k, min(hi, k + 256))
                d = chord(a.x[la[2][rows]] @ cols)
                p, q = np.nonzero(d - la[3][rows][:, None] - lb[3][s:e][None, :] <= limit + MARGIN)
                d, p, q = d[p, q], rows[p], q + s
                if same and u[i] == v[i]:
                    d, p, q = d[p <= q], p[p <= q], q[p <= q]
                p, q = sift(la, lb, p, q, d)
                us.append(p)
                vs.append(q)
        small = np.flatnonzero(size <= 4096)
        for k in range(0, len(small), 1024):
            at = small[k : k + 1024]
            n = size[at]
            of = np.repeat(np.arange(len(at)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (b1 - b0)[v[at]][of]
            p, q = a0[u[at]][of] + place // wide, b0[v[at]][of] + place % wide
            if same:
                keep = (u[at] != v[at])[of] | (p <= q)
                p, q = p[keep], q[keep]
            for j in range(0, len(p), 1 << 16):
                pp, qq = p[j : j + (1 << 16)], q[j : j + (1 << 16)]
                pp, qq = sift(la, lb, pp, qq, chord(np.einsum("ij,ij->i", a.x[la[2][pp]], b.x[lb[2][qq]])))
                us.append(pp)
                vs.append(qq)
        u, v = np.concatenate(us) if us else np.zeros(0, int), np.concatenate(vs) if vs else np.zeros(0, int)
    na, nb = np.cumsum(ca)[:-1], np.cumsum(cb)[:-1]
    outa, outb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    outa[a.perm], outb[b.perm] = np.rint(na), np.rint(nb)
    # What is open between leaves. Rows of one leaf are all linked, so one link ties two leaves.
    la, lb = a.levels[last], b.levels[last]
    for p, q in zip(u.tolist(), v.tolist(), strict=True):
        cols = b.perm[lb[0][q] : lb[1][q]]
        for k in range(la[0][p], la[1][p], 512):
            rows = a.perm[k : min(la[1][p], k + 512)]
            hit = a.x[rows] @ b.x[cols].T >= cosine
            outa[rows] += hit.sum(axis=1)
            (outa if same else outb)[cols] += hit.sum(axis=0)
            if hit.any():
                i, j = np.unravel_index(hit.argmax(), hit.shape)
                ties.append((rows[i : i + 1], cols[j : j + 1]))
    return outa, outb, ties


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, unit: the unit vector's doubles, or null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, units = [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                x = None
                if label is not None and v.is_valid and not v.values.null_count and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    x = x / top if np.isfinite(top) and top > 0 else None  # so that no square overflows or vanishes
                dims.append(0 if x is None else len(x))
                units.append(None if x is None else (x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "label", "dim", "unit"])

    return in_batches(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")), run, "vec_id long, label string, dim long, unit binary")


def _split(rows: DataFrame, sizes: DataFrame, block: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """rows (label, dim, cell, row, unit) of the cells in sizes (with n) dealt to their children: label, dim, cell, row, unit and far, the distance
    from the child's centre; and the centres (label, dim, cell, centre)."""
    keys = ["label", "dim", "cell"]
    blocks = F.ceil(F.col("n") / block)
    sizes = sizes.select(*keys, "n", F.least(F.lit(fan), blocks).alias("cells"), blocks.alias("blocks"))
    sized = joined_small(rows, sizes, keys, "inner")
    # Some 16 times as many rows as children, whatever the cell's size; of these, one after the other, the farthest from all before.
    h = F.xxhash64(F.lit(1), "cell", "row")
    some = sized.where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) * F.col("n") < 16 * F.col("cells")).select(*keys, "cells", h.alias("h"), "row", "unit")

    def picked(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("row", "ascending")])
        unit = t.column("unit").to_pylist()
        x = np.frombuffer(b"".join(unit), np.float64).reshape(len(unit), -1)
        chosen, gap = [0], chord(x @ x[0])
        while len(chosen) < t.column("cells")[0].as_py() and gap.max() > RADII[-1]:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, chord(x @ x[chosen[-1]]))
        same = [pa.array([k.as_py()] * len(chosen), kind) for k, kind in zip(key, (pa.string(), pa.int64(), pa.int64()), strict=True)]
        return pa.table([*same, pa.array(range(len(chosen)), pa.int64()), pa.array([unit[i] for i in chosen], pa.binary())], [*keys, "k", "centre"])

    centres = settled(some.groupBy(*keys).applyInArrow(picked, "label string, dim long, cell long, k long, centre binary"))
    dealt = sized.select(*keys, F.pmod(F.xxhash64("row"), F.col("blocks")).alias("part"), "row", "unit")
    each = centres.join(sizes.select(*keys, "blocks"), keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def nearest(rows: pa.Table, heads: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, kinds, strict=True)})
        dim, up = rows.column("dim")[0].as_py(), rows.column("cell")[0].as_py()
        # A cell of which no row was picked has one child that is near to all.
        cell, far = np.full(rows.num_rows, up * fan, np.int64), np.full(rows.num_rows, 4.0)
        if heads.num_rows:
            heads = heads.sort_by("k")
            c = np.frombuffer(b"".join(heads.column("centre").to_pylist()), np.float64).reshape(-1, dim)
            for k in range(0, rows.num_rows, 4096):
                x = np.frombuffer(b"".join(rows.column("unit").slice(k, 4096).to_pylist()), np.float64).reshape(-1, dim)
                dot = x @ c.T
                best = dot.argmax(axis=1)
                cell[k : k + 4096] = up * fan + heads.column("k").to_numpy()[best]
                far[k : k + 4096] = chord(dot[np.arange(len(x)), best])
        return pa.table([rows.column("label"), rows.column("dim"), pa.array(cell), rows.column("row"), rows.column("unit"), pa.array(far)], names=names)

    names, kinds = ["label", "dim", "cell", "row", "unit", "far"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64()]
    by = [*keys, "part"]
    each = each.select(*[F.col(c).alias(c) for c in each.columns])  # columns of its own, not those that it shares with the rows
    out = dealt.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(nearest, "label string, dim long, cell long, row long, unit binary, far double")
    return settled(out), centres.select("label", "dim", (F.col("cell") * fan + F.col("k")).alias("cell"), "centre")


def celled(units: DataFrame, block: int, fan: int = CELLS) -> tuple[DataFrame, list[DataFrame]]:
    """label, dim, cell, row and unit of every row in its last cell; and by level its nodes (label, dim, cell, n, radius, centre, whether it is split)."""
    keys, done, levels = ["label", "dim", "cell"], [], []
    rows, centres = units.select("label", "dim", F.lit(1).cast("long").alias("cell"), "row", "unit", F.lit(4.0).alias("far")), None
    for level in range(LEVELS + 1):
        nodes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        nodes = nodes.withColumn("centre", F.lit(None).cast("binary")) if centres is None else nodes.join(centres, keys, "left")
        nodes = settled(nodes.withColumn("split", (F.col("n") > block) & (F.col("radius") > RADII[-1]) & F.lit(level < LEVELS)))
        levels.append(nodes)
        open_ = nodes.where("split").select(*keys, "n")
        if open_.isEmpty():
            done.append(rows)
            break
        done.append(joined_small(rows, nodes.where("not split").select(*keys), keys, "left_semi"))
        rows, centres = _split(rows.select("label", "dim", "cell", "row", "unit"), open_, block, fan)
    cells = done[0]
    for more in done[1:]:
        cells = cells.unionByName(more)
    return cells.select("label", "dim", "cell", "row", "unit"), levels


def paired(levels: list[DataFrame], cosine: float, block: int, fan: int = CELLS) -> DataFrame:
    """(label, dim, cell, blocks, other, other_blocks): for each last cell those that it may link with, itself among them."""
    limit = np.sqrt(2.0 - 2.0 * cosine) + MARGIN
    facts = ["n", "radius", "centre", "split"]
    node = lambda df, p: df.select("label", "dim", F.col("cell").alias(f"{p}cell"), *[F.col(c).alias(f"{p}{c}") for c in facts])
    schema = ", ".join(f"{p}cell long, {p}n long, {p}radius double, {p}centre binary, {p}split boolean" for p in "ab")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("acentre").to_pylist(), b.column("bcentre").to_pylist()
            ra, rb, same = b.column("aradius").to_pylist(), b.column("bradius").to_pylist(), b.column("acell").to_numpy() == b.column("bcell").to_numpy()
            keep = [i for i in range(b.num_rows) if same[i] or a[i] is None or c[i] is None or chord(np.frombuffer(a[i]) @ np.frombuffer(c[i])) - ra[i] - rb[i] <= limit]
            yield b.take(pa.array(keep, pa.int64()))

    first = levels[0]
    pairs = node(first, "a").join(node(first, "b"), ["label", "dim"])  # a label's root with itself
    for nodes in levels[1:]:
        # Children in place of a split cell; others stay.
        for p in "ab":
            kids = node(nodes, p).withColumn("up", F.expr(f"{p}cell div {fan}"))
            split = pairs.where(f"{p}split").withColumn("up", F.col(f"{p}cell")).drop(*[f"{p}{c}" for c in ("cell", *facts)])
            pairs = split.join(kids, ["label", "dim", "up"]).drop("up").unionByName(pairs.where(f"not {p}split"))
        order = ["label", "dim", *[f"{p}{c}" for p in "ab" for c in ("cell", *facts)]]
        pairs = settled(in_batches(pairs.select(*order), near, f"label string, dim long, {schema}"))
    blocks = lambda p: F.ceil(F.col(f"{p}n") / block)
    return pairs.select("label", "dim", F.col("acell").alias("cell"), blocks("a").alias("blocks"), F.col("bcell").alias("other"), blocks("b").alias("other_blocks"))


def linked(units: DataFrame, cosine: float = COSINE, block: int = BLOCK, fan: int = CELLS) -> DataFrame:
    """(row, n, root): partial link counts of rows, each tied to a root; from units (row, label, dim, unit)."""
    if np.sqrt(2 - 2 * cosine) - MARGIN < 2 * RADII[-1]:
        raise ValueError("the last level is too coarse for this threshold")
    cells, levels = celled(units.where("unit is not null"), block, fan)
    keys = ["label", "dim", "cell"]
    pairs = joined_small(cells, paired(levels, cosine, block, fan), keys, "inner")
    own = F.shiftleft("cell", SUB).bitwiseOR(F.pmod(F.xxhash64(F.lit(2), "row"), F.col("blocks")))
    pairs = pairs.withColumn("own", own).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1)))
    pairs = pairs.withColumn("__o", F.shiftleft("other", SUB).bitwiseOR(F.col("__k")))
    pairs = pairs.select("label", "dim", F.least("own", "__o").alias("i"), F.greatest("own", "__o").alias("j"), "own", "row", "unit")

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        dim, i, j = (k.as_py() for k in key[1:])
        t = t.sort_by("row")
        own, row = t.column("own").to_numpy(), t.column("row").to_numpy()
        x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(-1, dim)
        n = len(row)
        count, us, vs = np.zeros(n, np.int64), [np.zeros(0, int)], [np.zeros(0, int)]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if len(left) and len(right):
            a = Tree(x[left], RADII)
            b = a if i == j else Tree(x[right], RADII)
            na, nb, ties = walked(a, b, i == j, cosine)
            count[left] += na
            if i != j:
                count[right] += nb
            us += [left[p] for p, _ in ties]
            vs += [right[q] for _, q in ties]
        lab = labels(n, np.concatenate(us), np.concatenate(vs))
        some = (count > 0) | (lab != np.arange(n))
        return pa.table({"row": row[some], "n": count[some], "root": row[lab[some]]}, schema=pa.schema([("row", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return pairs.groupBy("label", "dim", "i", "j").applyInArrow(meet, "row long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, fan: int = CELLS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    # Rows are told apart by a number of their own, checkpointed with them, as ids may be null or repeated.
    units = settled(prepared(vectors).withColumn("row", F.monotonically_increasing_id()))
    found = settled(linked(units, cosine, block, fan))
    links = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    comps = min_components(found.select(F.col("row").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "row")
    out = units.select("row", "vec_id").join(links, "row", "left").join(comps, "row", "left").withColumn("component", F.coalesce("component", "row"))
    # A component's name is its smallest id; its rows are counted apart from it, so that AQE may split a large one.
    least = out.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = out.join(least, "component")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)

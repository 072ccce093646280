"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant that differs from either in at
most r/2 bits. Every fingerprint therefore emits its ball of variants, and fingerprints meet on equal
variants. A ball of radius 2 has 2081 variants; to ship them all would multiply the corpus, so a
fingerprint is shipped once for each value that the leading bits of its variants take, and the rest of
the ball is emitted where the variants of that route meet. With n fingerprints the routes have about
log2(n) - 15 bits, l of them make 1 + l + l(l-1)/2 copies of a fingerprint, in packed runs of some six bytes each: 11 up to some 1,500,000
fingerprints, 56 for 15 million, 301 for 50 billion. Routes that are still too full, as where a third of all
fingerprints are much alike, are split by further bits; a variant has at most 2081 fingerprints within reach,
so that ends.
All that meet on one variant are within r of one another by the triangle inequality, so a star to one
of them links the group; every star link is verified on the fingerprints all the same. No pair list is
made, and a task emits at most one link for each fingerprint that it holds.

Null texts count as empty; texts without words have fingerprint zero and link like any other;
repeated doc_ids are kept row by row; null doc_ids link like others, but are no component's name unless it
has no other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import in_batches, joined_small, min_components, settled
from lobspark.llm.forest import labels

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14
#: Rows that a route holds on average, for the choice of route_bits; routes of twice as many are split by so many further bits.
ROUTE_ROWS = 1 << 20
SPLIT = 4
#: Rows that a task deals to routes at once.
DEALT_ROWS = 1 << 20
#: Bits that routes may have: as many as leave room for the table in a long.
MOST_LEAD = 56
#: Variants that are sorted at once, and leading bits by which a route's fingerprints are split at a time until they are so few.
SORT_ROWS = 1 << 18
STEP = 4


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both act on ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    starts, stops = begins[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=False)], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            total += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return in_batches(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), run, "id long, fp long")


def flips(width: int, most: int) -> np.ndarray:
    """All masks of `width` bits with at most `most` bits set, fewest first, as uint64."""
    ones = np.left_shift(np.uint64(1), np.arange(width, dtype=np.uint64))
    level, last = np.zeros(1, np.uint64), np.full(1, -1)
    out = [level]
    for _ in range(most):
        at, bit = np.nonzero(last[:, None] < np.arange(width)[None, :])
        level, last = level[at] | ones[bit], bit
        out.append(level)
    return np.concatenate(out)


def route_bits(n: int, half: int = 2) -> int:
    """Leading bits by which n fingerprints are dealt out."""
    lead = 4
    while lead < MOST_LEAD and n * sum(math.comb(lead, c) for c in range(half + 1)) > ROUTE_ROWS << lead:
        lead += 1
    return lead


def met(fps: np.ndarray, flipped: np.ndarray, width: int, most: int, meetings: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Star links (positions in fps: the smallest on a variant, another) between those that meet on it: `flipped` holds each
    one's bits that this route has used; the lower `width` bits still vary, by at most `most` in all. With `meetings`, how many
    others each met on its variants is added to that, and there are no links."""
    lead = 0
    while lead < width and len(fps) * sum(math.comb(width, c) for c in range(most + 1)) >> lead > SORT_ROWS:
        lead += 1
    return _met(fps, np.arange(len(fps), dtype=np.int32), flipped.astype(np.int8), width, most, lead, meetings)


def _met(fps: np.ndarray, who: np.ndarray, left: np.ndarray, width: int, most: int, lead: int, meetings: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """fps: variants so far, alike but for their lower `width` bits. who: whose. left: flips that each may still make. lead: bits to split by,
    a few at a time and one part after the other, so that few variants are held at once."""
    us, vs = [], []
    if len(fps) > 1 and lead:
        step = min(STEP, lead)
        rest = width - step
        own = ((fps >> np.uint64(rest)) & np.uint64((1 << step) - 1)).astype(np.uint8)
        order = np.argsort(own, kind="stable")
        fps, who, left = fps[order] & np.uint64((1 << rest) - 1), who[order], left[order]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=1 << step))))
        heads = flips(step, most).astype(np.int64)
        for part in range(1 << step):
            v, w, f = [], [], []
            for m, c in zip(heads, np.bitwise_count(heads), strict=True):
                at = slice(cuts[part ^ m], cuts[(part ^ m) + 1])
                may = left[at] >= c
                v.append(fps[at][may])
                w.append(who[at][may])
                f.append(left[at][may] - c)
            u, v = _met(np.concatenate(v), np.concatenate(w), np.concatenate(f), rest, most, lead - step, meetings)
            us.append(u)
            vs.append(v)
    elif len(fps) > 1:
        vv, ww = [], []
        for c in range(most + 1):
            at = np.flatnonzero(left == c)
            if len(at):
                masks = flips(width, c)
                vv.append((fps[at][:, None] ^ masks[None, :]).ravel())
                ww.append(np.repeat(at, len(masks)))
        v, w = np.concatenate(vv), np.concatenate(ww)
        ids = int(len(fps) - 1).bit_length()
        if width + ids <= 64:  # one number of both is sorted faster than places are
            both = (v & np.uint64((1 << width) - 1)) << np.uint64(ids) | w.astype(np.uint64)
            both.sort()
            v, w = both >> np.uint64(ids), (both & np.uint64((1 << ids) - 1)).view(np.int64)
        else:
            order = np.argsort(v)
            v, w = v[order], w[order]
        same = v[1:] == v[:-1]
        some = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))  # variants that only one has are most
        if len(some):
            v, w = v[some], who[w[some]]
            begins = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            size = np.diff(np.append(begins, len(v)))
            if meetings is not None:
                np.add.at(meetings, w, np.repeat(size - 1, size))
            else:
                head = np.repeat(np.minimum.reduceat(w, begins), size)
                other = head != w
                pairs = np.unique(np.stack([head[other], w[other]]), axis=1)
                us.append(pairs[0])
                vs.append(pairs[1])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of longs, of one length, the last in ascending order."""
    rows = np.stack([*columns[:-1], np.diff(columns[-1].view(np.uint64), prepend=np.uint64(0)).view(np.int64)])
    return pa.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(rows.size, 8).T).tobytes(), "zstd", asbytes=True)


def _unpacked(run: bytes, n: int, k: int) -> list[np.ndarray]:
    whole = np.frombuffer(pa.decompress(run, 8 * n * k, "zstd", asbytes=True), np.uint8).reshape(8, n * k)
    rows = np.ascontiguousarray(whole.T).view(np.int64).reshape(k, n)
    return [*rows[:-1], np.cumsum(rows[-1].view(np.uint64)).view(np.int64)]


def _joined(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(node, fp) of packed runs."""
    parts = [_unpacked(b, n, 2) for b, n in zip(t.column("run").to_pylist(), t.column("n").to_pylist(), strict=True)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def routed(rows: DataFrame, old: int, new: int, bits: int, half: int) -> DataFrame:
    """(route, n, run): n packed (node, fp) of rows (route, node, fp), or of such runs, of routes by `old` leading bits, dealt by `new`
    ones. A route is its table and the leading bits of the variants that meet there. Packed, a row takes some six bytes."""
    masks = flips(new - old, half)
    costs = np.bitwise_count(masks).astype(np.int64)
    most = max(1 << 12, DEALT_ROWS // len(masks))
    kinds = "route long, n long, run binary"

    def deal(route: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        ones = fp.view(np.uint64)
        used = spent(route, ones, old, bits)
        own = (ones >> np.uint64(bits - new)) & np.uint64((1 << (new - old)) - 1)
        may = [np.flatnonzero(used + c <= half) for c in costs]
        to = np.concatenate([route[at] << (new - old) | (own[at] ^ m).view(np.int64) for m, at in zip(masks, may, strict=True)])
        at = np.concatenate(may)
        order = np.lexsort((ones[at], to))
        to, at = to[order], at[order]
        parts = np.split(at, np.flatnonzero(np.diff(to)) + 1) if len(at) else []
        runs = [_packed([node[p], fp[p]]) for p in parts]
        firsts = np.cumsum([0, *(len(p) for p in parts)])[:-1]
        return pa.RecordBatch.from_arrays([pa.array(to[firsts.astype(int)], pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(runs, pa.binary())], ["route", "n", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if "run" in b.schema.names:
                nodes, fps = _joined(b) if b.num_rows else (np.zeros(0, np.int64),) * 2
                own = [np.repeat(b.column(0).to_numpy(), b.column(1).to_numpy()), nodes, fps]
            else:
                own = [c.to_numpy() for c in b.columns]
            for i in range(0, len(own[0]), most):
                held.append([c[i : i + most] for c in own])
                n += len(held[-1][0])
                if n >= most:
                    yield deal(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield deal(*map(np.concatenate, zip(*held, strict=True)))

    return in_batches(rows, run, kinds, 512 if "run" in rows.columns else 1 << 14)


def middle(a: np.ndarray, b: np.ndarray, half: int) -> np.ndarray:
    """A variant within half of both: a with so many of the lowest bits that differ flipped as b is too far."""
    out, left = a.copy(), a ^ b
    over = np.bitwise_count(left).astype(np.int64) - half
    for k in range(half):
        low = left & (~left + np.uint64(1))
        out ^= np.where(over > k, low, np.uint64(0))
        left ^= low
    return out


def spent(route: np.ndarray, fp: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bits that a route of `level` leading bits flips of each fingerprint."""
    head = route.view(np.uint64) & np.uint64((1 << level) - 1)
    return np.bitwise_count((fp >> np.uint64(bits - level) if level else np.zeros_like(fp)) ^ head).astype(np.int64)


def routes(reps: DataFrame, radius: int, lead: int | None, bits: int, tables: int, meet: Callable[[int], Callable[[tuple, pa.Table], pa.Table]], schema: str) -> DataFrame:
    """What meet(level) makes of every route of reps (node, fp, and table if there are several), given as packed runs, with routes that are too full split."""
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even")
    table = F.col("table").cast("long") if "table" in reps.columns else F.lit(0).cast("long")
    lead = route_bits(-(-reps.count() // tables), half) if lead is None else lead
    rows, level, found = routed(reps.select(table.alias("route"), "node", "fp"), 0, lead, bits, half), lead, None
    while True:
        full = rows.groupBy("route").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * ROUTE_ROWS).select("route")
        full = settled(full) if level < min(bits, MOST_LEAD) else None
        more = full is not None and not full.isEmpty()
        here = joined_small(rows, full, ["route"], "left_anti") if more else rows
        here = here.groupBy("route").applyInArrow(meet(level), schema)
        found = here if found is None else found.unionByName(here)
        if not more:
            return found
        step = min(level + SPLIT, bits, MOST_LEAD)
        rows, level = settled(routed(joined_small(rows, full, ["route"], "left_semi"), level, step, bits, half)), step


def places(reps: DataFrame, radius: int = 4, lead: int | None = None, bits: int = BITS, tables: int = 1) -> DataFrame:
    """(level, route, node, fp, met): on which routes (of `level` leading bits) the nodes of reps meet others, and how many, counted by variants.
    Most nodes meet none on most routes, so that what else belongs to a node is to be joined to these rows, and not sent by every route."""
    half = radius // 2

    def meet(level: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, t: pa.Table) -> pa.Table:
            node, fp = _joined(t)
            ones, counted = fp.view(np.uint64), np.zeros(len(fp), np.int64)
            route = np.full(1, key[0].as_py())
            met(ones & np.uint64((1 << (bits - level)) - 1), half - spent(route, ones, level, bits), bits - level, half, counted)
            some = np.flatnonzero(counted)
            cols = [np.full(len(some), level, np.int32), np.repeat(route, len(some)), node[some], fp[some], counted[some]]
            return pa.table([pa.array(c) for c in cols], ["level", "route", "node", "fp", "met"])

        return run

    return routes(reps, radius, lead, bits, tables, meet, "level int, route long, node long, fp long, met long")


def drawn(rows: DataFrame, radius: int = 4, bits: int = BITS, out: str = "first", most: int | None = None) -> DataFrame:
    """(u, v): links between nodes that meet on a variant, of rows (level, route, node, fp, mark) from `places`. As `first`, each node's link to the
    node that it met of the largest `mark`, the smallest of equals; as `across`, all between nodes whose `mark` differs,
    to the node of a variant that has the largest `rank`, if rows have it, the smallest of equals.
    With `most`, rows also have `prints`, an array of longs a node, and those links are left whose prints differ in so many bits at most."""
    half = radius // 2

    def run(key: tuple, t: pa.Table) -> pa.Table:
        level = key[0].as_py()
        # Positions are in order of rank: links go to the first.
        first = [(c, "descending") for c in ("mark" if out == "first" else "rank",) if c in t.column_names]
        t = t.sort_by([*first, ("node", "ascending")])
        route, node, fp = (t.column(c).to_numpy() for c in ("route", "node", "fp"))
        fp = fp.view(np.uint64)
        u, v = met(fp & np.uint64((1 << (bits - level)) - 1), half - spent(route, fp, level, bits), bits - level, half)
        near = np.bitwise_count(fp[u] ^ fp[v]) <= radius
        u, v = u[near], v[near]
        if out == "first":
            first = np.arange(len(fp))
            np.minimum.at(first, v, u)
            u = np.flatnonzero(first != np.arange(len(fp)))
            v = first[u]
            # A pair meets on several routes; only that of its `middle` gives it, where a node's smallest is seen as such.
            own = (middle(fp[v], fp[u], half) >> np.uint64(bits - level)).view(np.int64) == route[u] & ((1 << level) - 1)
            u, v = u[own], v[own]
        else:
            marks = t.column("mark").to_numpy()
            apart = marks[u] != marks[v]
            u, v = np.unique(np.stack([u[apart], v[apart]]), axis=1)
        if most is not None and len(u):
            prints = t.column("prints").combine_chunks().flatten().to_numpy().reshape(len(fp), -1)
            close = np.bitwise_count(prints[u] ^ prints[v]).sum(axis=1, dtype=np.int64) <= most
            u, v = u[close], v[close]
        return pa.table({"u": node[u], "v": node[v]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    names = ["level", "route", "node", "fp", *(c for c in ("mark", "rank", "prints") if c in rows.columns)]
    return rows.select(*names).groupBy("level", "route").applyInArrow(run, "u long, v long")


def links(reps: DataFrame, radius: int = 4, lead: int | None = None, bits: int = BITS, tables: int = 1, out: str = "forest", most: int | None = None) -> DataFrame:
    """(u, v): links between the nodes of reps (node, fp, and table if there are several), a table's fp all
    different, of star links between fingerprints that meet on a variant: as a forest, those that hold each group
    together that chains of at most `radius` differing bits connect; as `first` and `across`, see drawn; `mark`, `rank` and `prints` are then columns of reps."""
    half = radius // 2
    if out != "forest":
        reps = reps.withColumn("table", F.col("table").cast("long") if "table" in reps.columns else F.lit(0).cast("long"))
        where = places(reps, radius, lead, bits, tables).withColumn("table", F.expr("shiftright(route, level)"))
        return drawn(where.join(reps.drop("fp"), ["table", "node"]), radius, bits, out, most)

    def meet(level: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, t: pa.Table) -> pa.Table:
            node, fp = _joined(t)
            order = np.argsort(node, kind="stable")
            node, fp = node[order], fp[order].view(np.uint64)
            u, v = met(fp & np.uint64((1 << (bits - level)) - 1), half - spent(np.full(1, key[0].as_py()), fp, level, bits), bits - level, half)
            near = np.bitwise_count(fp[u] ^ fp[v]) <= radius
            lab = labels(len(fp), u[near], v[near])
            u = np.flatnonzero(lab != np.arange(len(fp)))
            return pa.table({"u": node[u], "v": node[lab[u]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

        return run

    return routes(reps, radius, lead, bits, tables, meet, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    prints = settled(fingerprints(docs, text, id, width))
    reps = settled(prints.groupBy("fp").agg(F.min("id").alias("id")))
    comps = min_components(links(reps.select(F.col("fp").alias("node"), "fp"), radius)).withColumnRenamed("node", "fp")
    named = settled(reps.join(comps, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("root")))
    first = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return prints.join(named.join(first, "root").select("fp", "component_id"), "fp").select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

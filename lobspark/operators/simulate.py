"""Synthetic books: market makers quote, noise and informed traders take. One task a path, seeded by path.

A path is an event queue (quotes are renewed, orders arrive, snapshots are taken), not a loop over time
steps; the fundamental price is an Ornstein-Uhlenbeck process with jumps, drawn exactly between events.
Rows are book snapshots; features and labels come from the operators that real books use.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.operators.asof import labelled
from lobspark.operators.book import LEVELS, Book
from lobspark.operators.features import extracted


@dataclass(frozen=True)
class Params:
    duration_s: float = 28_800.0
    snapshot_s: float = 0.1
    kappa: float = 0.1
    mu: float = 100.0
    sigma: float = 0.01
    jump_rate: float = 0.02
    jump_sigma: float = 0.05
    tick: float = 0.01
    noise_mu: float = 5.0
    noise_alpha: float = 0.3
    noise_beta: float = 1.0
    noise_qty: float = 5.0
    informed_rate: float = 0.5
    refresh_rate: float = 2.0
    makers: int = 3
    quote_qty: float = 10.0
    risk: float = 0.005
    inventory_limit: float = 500.0

    def __post_init__(self) -> None:
        if not 0 <= self.noise_alpha < self.noise_beta:
            raise ValueError("arrivals explode unless alpha < beta")


def poisson(rng: np.random.Generator, rate: float, until: float) -> np.ndarray:
    """Arrival times of a constant rate."""
    n = rng.poisson(rate * until)
    return np.sort(rng.uniform(0, until, n))


def hawkes(rng: np.random.Generator, mu: float, alpha: float, beta: float, until: float) -> np.ndarray:
    """Arrival times whose rate jumps by alpha at each and decays with beta, as clusters: immigrants at rate mu,
    each arrival with Poisson(alpha / beta) children at exponential delays."""
    if not 0 <= alpha < beta:
        raise ValueError("arrivals explode unless alpha < beta")
    parents = poisson(rng, mu, until)
    out = [parents]
    while len(parents):
        children = np.repeat(parents, rng.poisson(alpha / beta, len(parents)))
        parents = children + rng.exponential(1 / beta, len(children))
        parents = parents[parents < until]
        out.append(parents)
    return np.sort(np.concatenate(out))


class Maker:
    """Quotes around the mid, shifted against its inventory."""

    def __init__(self, p: Params) -> None:
        self.p, self.inventory, self.quoted = p, 0.0, None

    def quote(self, mid: float) -> tuple[float, float, float, float]:
        """Bid price, bid quantity, ask price, ask quantity."""
        half, lean, least = 2 * self.p.tick, self.p.risk * self.inventory, 0.001 * mid
        bid, ask = mid - max(half + lean, least), mid + max(half - lean, least)
        return bid, 0.0 if self.inventory >= self.p.inventory_limit else self.p.quote_qty, ask, 0.0 if self.inventory <= -self.p.inventory_limit else self.p.quote_qty


def path_rows(path: int, p: Params) -> Iterator[tuple[int, float, list, list]]:
    """(ts_us, fundamental, bids, asks) of each snapshot."""
    rng = np.random.default_rng([20_251, path])
    book = Book()
    snap = lambda x: round(x / p.tick) * p.tick
    put = lambda side, price, qty, ts: book.apply("delta", side, snap(price), qty, ts, None, None)
    for i in range(5):
        put("bid", p.mu - (2 + i) * p.tick, 10.0, 0)
        put("ask", p.mu + (2 + i) * p.tick, 10.0, 0)
    makers = [Maker(p) for _ in range(p.makers)]
    queue = [(0.0, 0, "quote"), (0.0, 3, "snapshot")]
    queue += [(float(t), 1, "noise") for t in hawkes(rng, p.noise_mu, p.noise_alpha, p.noise_beta, p.duration_s)]
    queue += [(float(t), 2, "informed") for t in poisson(rng, p.informed_rate, p.duration_s)]
    heapq.heapify(queue)
    s, last, n = p.mu, 0.0, 0
    while queue:
        t, _, what = heapq.heappop(queue)
        if t >= p.duration_s:
            continue
        ts, full = int(round(t * 1e6)), bool(book.bids.keys and book.asks.keys)
        mid = (-book.bids.keys[0] + book.asks.keys[0]) / 2 if full else None
        if what == "quote":
            for m in makers:
                for side, price in zip(("bid", "ask"), m.quoted or (), strict=False):
                    put(side, price, 0.0, ts)
                m.quoted = None
                # Around the fundamental where a side is empty, so that a book that was swept comes back.
                bid, bq, ask, aq = m.quote(s if mid is None else mid)
                if snap(bid) < snap(ask) and bq > 0 and aq > 0:
                    put("bid", bid, bq, ts)
                    put("ask", ask, aq, ts)
                    m.quoted = (bid, ask)
            heapq.heappush(queue, (t + 1 / p.refresh_rate, 0, "quote"))
        elif what == "noise" and full:
            book.market_order(bool(rng.integers(2)), float(rng.lognormal(math.log(p.noise_qty) - 0.125, 0.5)))
        elif what == "informed" and full:
            signal = rng.normal(0, 15 * p.sigma)
            if abs(signal) >= 3 * p.sigma:
                book.market_order(signal > 0, p.noise_qty * abs(signal) / (15 * p.sigma))
        elif what == "snapshot":
            dt, keep = t - last, math.exp(-p.kappa * (t - last))
            sd = p.sigma * math.sqrt((1 - keep * keep) / (2 * p.kappa)) if dt else 0.0
            jumps = rng.poisson(p.jump_rate * dt) if dt else 0
            s = max(p.mu + (s - p.mu) * keep + sd * rng.normal() + rng.normal(0, p.jump_sigma, jumps).sum(), 0.001 * p.mu)
            last, n = t, n + 1
            yield ts, s, book.bids.top(10), book.asks.top(10)
            heapq.heappush(queue, (n * p.snapshot_s, 3, "snapshot"))


def simulated(spark: SparkSession, paths: int, p: Params = Params()) -> DataFrame:
    """symbol (one a path), ts_us, seq, fundamental, top_bids, top_asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = pa.list_(pa.struct([("price", pa.float64()), ("qty", pa.float64())]))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), levels, levels]
        names = ["symbol", "ts_us", "seq", "fundamental", "top_bids", "top_asks"]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for i, (ts, s, bids, asks) in enumerate(path_rows(path, p)):
                    rows.append((f"SIM{path}", ts, i, s, bids, asks))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ids = spark.range(0, paths, 1, min(paths, 10_000))
    return ids.mapInArrow(run, f"symbol string, ts_us long, seq long, fundamental double, top_bids {LEVELS}, top_asks {LEVELS}")


def feature_table(spark: SparkSession, paths: int, p: Params = Params()) -> DataFrame:
    """Features and forward returns of simulated books. Where a side is empty the fundamental stands for the mid."""
    f = extracted(simulated(spark, paths, p)).withColumns({"mid": F.coalesce("mid", "fundamental"), "exchange": F.lit("sim"), "data_source": F.lit("simulation"), "is_imputed": F.lit(False), "gap_flag": F.lit(False)})
    spread = F.coalesce("spread", 0.001 * F.col("mid"))
    return labelled(f.withColumn("__spread", spread), spread="__spread").drop("__spread")

"""The driver's tables as market data, in SQL that Spark and DuckDB share but for the timestamp."""

from __future__ import annotations

#: Of a timestamp without a zone, so that the session's does not matter.
MICROS = {"spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))", "duckdb": "epoch_us(ts)"}


def ticks(dialect: str) -> str:
    """Trades with quotes: symbol, ts_us, seq, price, qty, is_buy, bid, ask, bid_qty, ask_qty."""
    k = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
    return (
        f"select event_type as symbol, {MICROS[dialect]} as ts_us, event_id as seq, 100 + value / 100 as price, cast({k} + 1 as double) as qty, event_id % 2 = 0 as is_buy, "
        f"100 + value / 100 - (1 + {k} % 5) * 0.005e0 as bid, 100 + value / 100 + (1 + {k} % 5) * 0.005e0 as ask, cast(1 + {k} % 7 as double) as bid_qty, cast(1 + {k} % 11 as double) as ask_qty from events"
    )


def bars(dialect: str) -> str:
    """What the indicators read: symbol, ts_us, seq, p, h, l, o, v, sp, ofi."""
    run = "over (partition by symbol order by ts_us, seq)"
    return (
        f"select symbol, ts_us, seq, price as p, price + (ask - bid) / 2 as h, greatest(price - (ask - bid) / 2, 1e-10) as l, coalesce(lag(price, 1) {run}, price) as o, qty as v, ask - bid as sp, "
        f"coalesce((bid_qty - ask_qty) - lag(bid_qty - ask_qty, 1) {run}, 0e0) as ofi from ({ticks(dialect)}) t"
    )


def deltas(dialect: str) -> str:
    """Level changes of four books that never cross: symbol, ts_us, seq, side, price, qty."""
    k = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
    side = "case when event_id % 2 = 0 then 'bid' else 'ask' end"
    return (
        f"select concat('S', cast(user_id % 4 as string)) as symbol, {MICROS[dialect]} as ts_us, event_id as seq, {side} as side, "
        f"case when event_id % 2 = 0 then 100 - (1 + {k} % 10) * 0.01e0 else 100 + (1 + {k} % 10) * 0.01e0 end as price, case when event_type = 'error' then 0e0 else value end as qty from events"
    )


def feature_rows(dialect: str) -> str:
    """A feature table without books: what backtests and reports read, from ticks and their bars."""
    run = "over (partition by symbol order by ts_us, seq)"
    return (
        f"select symbol, ts_us, seq, (bid + ask) / 2 as mid, ask - bid as spread, (bid_qty - ask_qty) - lag(bid_qty - ask_qty, 1) {run} as ofi_1, (bid_qty - ask_qty) / (bid_qty + ask_qty) as depth_imb, "
        f"(ask_qty * bid + bid_qty * ask) / (bid_qty + ask_qty) - (bid + ask) / 2 as microprice_dev, bid_qty / (bid_qty + ask_qty) as queue_imb, qty as trade_intensity from ({ticks(dialect)}) t"
    )

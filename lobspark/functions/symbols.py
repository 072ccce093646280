"""Names of instruments and channels as feeds write them, as column expressions, and their subscriptions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quote currencies, in the order in which a name's end is tried.
QUOTES = ("USDT", "USDC", "USD", "EUR", "GBP", "BTC", "ETH")
#: Of other names the last three letters are the quote currency, if something is left before them.
LAST = 3


def _parted(symbol: Column, sep: str) -> Column:
    """BTCUSD as BTC<sep>USD; a name that has a separator keeps its parts."""
    s = F.regexp_replace(F.upper(symbol), "[-/_]", sep)
    out = F.when(F.length(s) > LAST, F.concat(F.substring(s, F.lit(1), F.length(s) - LAST), F.lit(sep), F.right(s, F.lit(LAST)))).otherwise(s)
    for q in reversed(QUOTES):
        out = F.when(s.endswith(q) & (F.length(s) > len(q)), F.concat(F.substring(s, F.lit(1), F.length(s) - len(q)), F.lit(f"{sep}{q}"))).otherwise(out)
    return F.when(F.contains(s, F.lit(sep)), s).otherwise(out)


def product_id(symbol: Column) -> Column:
    return _parted(symbol, "-")


def kraken_symbol(symbol: Column) -> Column:
    return _parted(symbol, "/")


def gemini_symbol(symbol: Column) -> Column:
    return F.upper(F.regexp_replace(symbol, "[-/_]", ""))


def bitstamp_channel(symbol: Column) -> Column:
    return F.concat(F.lit("order_book_"), F.lower(F.regexp_replace(symbol, "[-/_]", "")))


def inst_id(symbol: Column) -> Column:
    return F.upper(F.regexp_replace(symbol, "[/_]", "-"))


def file_name(symbol: Column) -> Column:
    return F.lower(F.regexp_replace(symbol, "[-/]", "_"))


def chart_interval(days: int) -> str:
    """The finest bars that a chart of so many days has."""
    return "1m" if days <= 7 else "5m" if days <= 60 else "1h"


def subscription(feed: str, symbols: list[str], depth: int | None = None) -> str:
    """The message that subscribes to a feed's books or trades."""
    forms = {
        "kraken": {"method": "subscribe", "params": {"channel": "book", "symbol": symbols, "depth": depth or 500}},
        "okx": {"op": "subscribe", "args": [{"channel": "books", "instId": s} for s in symbols]},
        "bybit": {"op": "subscribe", "args": [f"orderbook.{depth or 200}.{s}" for s in symbols]},
        "coinbase": {"type": "subscribe", "channel": "level2", "product_ids": symbols},
        "alpaca": {"action": "subscribe", "trades": symbols, "quotes": symbols},
        "bitstamp": [{"event": "bts:subscribe", "data": {"channel": f"order_book_{s.lower()}"}} for s in symbols],
        "tiingo": {"eventName": "subscribe", "eventData": {"thresholdLevel": 5, "tickers": [s.lower() for s in symbols]}},
        "finnhub": [{"type": "subscribe", "symbol": s} for s in symbols],
        "polygon": {"action": "subscribe", "params": ",".join(f"{k}.{s}" for s in symbols for k in ("Q", "T"))},
    }
    return json.dumps(forms[feed])

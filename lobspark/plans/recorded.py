"""The driver's ticks as messages of every feed, and as the events that each parser should make of them, in SQL.

A feed's messages are written by Spark and read back by its parser; what should come out is said in SQL of the
ticks alone, so the two share no code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.operators.segments import placed
from lobspark.plans import views
from lobspark.sources.feeds import FEEDS, OF_ONE_SYMBOL
from lobspark.sources.shared import fresh_dir

#: Ticks with rn, their number in the instrument, and, where a feed has one instrument, every, their number. Sequence numbers
#: jump at every seventh.
_NUMBERED = "select *, row_number() over (partition by symbol order by seq) as rn{every} from ({ticks}) t0"
_EVERY = ", row_number() over (order by seq) as every"
#: Feeds whose rules look at the message before: written to files and read from them.
RULED = frozenset({"binance", "dukascopy", "gemini", "okx", "bybit"})
#: As many files at least, and of so many lines at most or so.
FILES, FILE_LINES = 8, 500_000

_ISO = "date_format(timestamp_micros(ts_us), 'yyyy-MM-dd''T''HH:mm:ss.SSSSSS')"
_MS = "ts_us div 1000"
_LV = "array(named_struct('price', {p}, 'qty', {q}))"
_PAIR = "array(array(string({p}), string({q}), '0'))"
_BID, _ASK = (({"p": s, "q": f"{s}_qty"}) for s in ("bid", "ask"))
_STEP = "(rn + rn div 7)"

#: Messages of a tick, in order, as Spark SQL.
MESSAGES: dict[str, list[str]] = {
    "lobster": ["concat_ws(',', cast(ts_us / 1000000D as decimal(20,6)), element_at(array(1, 3, 4, 7), int(seq % 4) + 1), seq, qty, bigint(round(price * 10000)), if(is_buy, 1, -1))"],
    "lobster_book": ["concat_ws(',', bigint(round(ask * 10000)), ask_qty, bigint(round(bid * 10000)), bid_qty)"],
    "iex": [
        "to_json(named_struct('messageType', 'Q', 'symbol', symbol, 'bidPrice', bid, 'bidSize', bid_qty, 'askPrice', ask, 'askSize', ask_qty, 'lastUpdated', ts_us * 1000))",
        "concat('data: ', to_json(named_struct('type', 'T', 'symbol', symbol, 'price', price, 'size', qty, 'flags', if(is_buy, 1, 0), 'timestamp', ts_us * 1000)))",
    ],
    "dukascopy": [f"concat_ws(',', {_ISO}, ask, bid, ask_qty, bid_qty)"],
    "binance": [
        f"concat('{{\"e\":\"depthUpdate\",\"E\":', {_MS}, ',\"s\":\"', symbol, '\",\"U\":', rn + {_STEP} - 1, ',\"u\":', rn + {_STEP}, ',\"b\":[[\"', bid, '\",\"', bid_qty, '\"]],\"a\":[[\"', ask, '\",\"', ask_qty, '\"]]}}')",
        f"concat('{{\"stream\":\"', lower(symbol), '@aggTrade\",\"data\":{{\"e\":\"aggTrade\",\"T\":', {_MS}, ',\"p\":\"', price, '\",\"q\":\"', qty, '\",\"m\":', string(not is_buy), '}}}}')",
    ],
    "binance_klines": [f"to_json(array(array('0', string(price), '0', '0', string(ask), string(qty * 1000), string({_MS}))))"],
    "coinbase": [f"to_json(named_struct('channel', 'l2_data', 'timestamp', concat({_ISO}, 'Z'), 'events', array(named_struct('type', if(is_buy, 'snapshot', 'update'), 'product_id', symbol, 'updates', array(named_struct('side', 'bid', 'price_level', string(bid), 'new_quantity', string(bid_qty)), named_struct('side', 'offer', 'price_level', string(ask), 'new_quantity', string(ask_qty)))))))"],
    "kraken": [f"to_json(named_struct('channel', 'book', 'type', if(is_buy, 'snapshot', 'update'), 'data', array(named_struct('symbol', symbol, 'bids', {_LV.format(**_BID)}, 'asks', {_LV.format(**_ASK)}, 'timestamp_ms', {_MS}))))"],
    "gemini": [f"to_json(named_struct('type', 'update', 'timestampms', {_MS}, 'socket_sequence', every + every div 7, 'events', array(named_struct('type', 'change', 'reason', if(is_buy, 'initial', 'place'), 'price', string(bid), 'remaining', string(bid_qty), 'side', 'bid'), named_struct('type', 'change', 'reason', if(is_buy, 'initial', 'place'), 'price', string(ask), 'remaining', string(ask_qty), 'side', 'ask'))))"],
    "bitstamp": [f"to_json(named_struct('event', 'data', 'channel', concat('order_book_', symbol), 'data', named_struct('microtimestamp', string(ts_us), 'bids', {_PAIR.format(**_BID)}, 'asks', {_PAIR.format(**_ASK)})))"],
    "okx": [f"to_json(named_struct('action', if(rn = 1, 'snapshot', 'update'), 'arg', named_struct('channel', 'books', 'instId', symbol), 'data', array(named_struct('bids', {_PAIR.format(**_BID)}, 'asks', {_PAIR.format(**_ASK)}, 'ts', string({_MS}), 'seqId', {_STEP}, 'prevSeqId', {_STEP} - 1))))"],
    "bybit": [f"to_json(named_struct('topic', 'orderbook', 'type', if(rn = 1, 'snapshot', 'delta'), 'ts', {_MS}, 'data', named_struct('s', symbol, 'b', {_PAIR.format(**_BID)}, 'a', {_PAIR.format(**_ASK)}, 'u', {_STEP})))"],
    "alpaca": [f"concat('[{{\"T\":\"t\",\"S\":\"', symbol, '\",\"p\":', price, ',\"s\":', qty, ',\"t\":\"', {_ISO}, 'Z\"}},{{\"T\":\"q\",\"S\":\"', symbol, '\",\"bp\":', bid, ',\"bs\":', bid_qty, ',\"ap\":', ask, ',\"as\":', ask_qty, ',\"t\":\"', {_ISO}, 'Z\"}}]')"],
    "polygon": [f"concat('[{{\"ev\":\"T\",\"sym\":\"', symbol, '\",\"p\":', price, ',\"s\":', qty, ',\"t\":', {_MS}, '}},{{\"ev\":\"Q\",\"sym\":\"', symbol, '\",\"bp\":', bid, ',\"bs\":', bid_qty, ',\"ap\":', ask, ',\"as\":', ask_qty, ',\"t\":', {_MS}, '}}]')"],
    "polygon_rest": ["concat('{\"tickers\":[{\"ticker\":\"', symbol, '\",\"lastQuote\":{\"p\":', bid, ',\"s\":', bid_qty, ',\"P\":', ask, ',\"S\":', ask_qty, ',\"t\":', ts_us * 1000, '},\"lastTrade\":{\"p\":', price, ',\"s\":', qty, ',\"t\":', ts_us * 1000, '}}]}')"],
    "tiingo": [f"concat('{{\"messageType\":\"A\",\"data\":[\"T\",\"', symbol, '\",null,', price, ',', qty, ',null,', bid, ',', bid_qty, ',', ask, ',', ask_qty, ',\"', {_ISO}, '+00:00\"]}}')"],
    "finnhub": [f"to_json(named_struct('type', 'trade', 'data', array(named_struct('p', price, 's', symbol, 't', {_MS}, 'v', qty))))"],
    "yahoo_chart": ["to_json(named_struct('chart', named_struct('result', array(named_struct('meta', named_struct('symbol', symbol), 'timestamp', array(ts_us div 1000000), 'indicators', named_struct('quote', array(named_struct('close', array(price), 'volume', array(qty)))))))))"],
    "yahoo_quote": ["to_json(named_struct('quoteResponse', named_struct('result', array(named_struct('symbol', symbol, 'bid', bid, 'ask', ask, 'bidSize', bid_qty, 'askSize', ask_qty, 'regularMarketPrice', price, 'regularMarketVolume', qty, 'regularMarketTime', ts_us div 1000000)))))"],
}

_OUT = ("symbol", "kind", "ts_us", "side", "price", "qty", "is_buy", "bid", "bid_qty", "ask", "ask_qty", "is_imputed")


def read_back(spark: SparkSession, ticks: DataFrame, feed: str) -> DataFrame:
    """Events of a feed's messages: the fields, and the best levels of snapshots."""
    each = MESSAGES[feed]
    numbered = ticks
    for name, by in (("rn", ["symbol"]), ("every", ["__all"])):
        if any(re.search(rf"\b{name}\b", m) for m in each):
            numbered = placed(numbered.withColumn("__all", F.lit(0)), by, ["seq"], {"__place": F.lit(True)}).withColumn(name, (F.col("__place") + 1).cast("int")).drop("__place", "__all")
    raw = numbered.select(F.col("seq").alias("s"), F.posexplode(F.array(*map(F.expr, each))).alias("p", "value")).select((F.col("s") * len(each) + F.col("p")).alias("line"), "value")
    if feed in RULED:
        out = fresh_dir(spark, f"messages-{feed}")
        files = max(FILES, -(-ticks.count() * len(each) // FILE_LINES))
        raw.repartitionByRange(files, "line").sortWithinPartitions("line").select("value").write.text(out)
        raw = spark.read.text(out)
    e = FEEDS[feed](raw, *(["X"] if feed in OF_ONE_SYMBOL else []), **({"levels": 1} if feed == "lobster_book" else {}))
    best = {n: F.get(c, F.lit(0))[f] for n, c, f in (("bid", "bids", "price"), ("bid_qty", "bids", "qty"), ("ask", "asks", "price"), ("ask_qty", "asks", "qty"))}
    return e.withColumns(best).select(*_OUT)


def expected(feed: str) -> str:
    """SQL for DuckDB of what read_back gives."""
    up, x = "upper(symbol)", "'X'"
    ms, sec = "ts_us // 1000 * 1000", "ts_us // 1000000 * 1000000"

    def row(kind: str, symbol: str, ts: str, where: str = "true", **f: str) -> str:
        kinds = {"side": "varchar", "is_buy": "boolean"}
        fields = {"symbol": symbol, "kind": f"'{kind}'", "ts_us": ts, "is_imputed": "true" if kind == "gap" else "false"}
        cols = [f"{fields[c]} as {c}" if c in fields else f"({f[c]}){'::double' if c not in kinds else ''} as {c}" if c in f else f"null::{kinds.get(c, 'double')} as {c}" for c in _OUT]
        return f"select {', '.join(cols)} from n where {where}"

    def quote(symbol: str, ts: str, where: str = "true") -> list[str]:
        return [row("delta", symbol, ts, where, side=f"'{s}'", price=s, qty=f"{s}_qty") for s in ("bid", "ask")]

    def whole(symbol: str, ts: str, where: str = "true", **f: str) -> list[str]:
        return [row("snapshot", symbol, ts, where, **({"bid": "bid", "bid_qty": "bid_qty", "ask": "ask", "ask_qty": "ask_qty"} | f))]

    def deal(symbol: str, ts: str, buy: str, **f: str) -> list[str]:
        return [row("trade", symbol, ts, is_buy=buy, **({"price": "price", "qty": "qty"} | f))]

    def jumps(symbol: str, count: str, first: str, rest: str) -> list[str]:
        lost = f"{count} > 1 and {count} % 7 = 0"
        return [row("gap", symbol, ms, lost), *whole(symbol, ms, f"{first} and not ({lost})"), *quote(symbol, ms, f"{rest} and not ({lost})")]

    side = "case when is_buy then 'bid' else 'ask' end"
    tenth = "round(price * 10000)::bigint / 10000.0::double"
    rows = {
        "lobster": [row("delta", x, "ts_us", "seq % 4 = 0", side=side, price=tenth, qty="qty"), row("delta", x, "ts_us", "seq % 4 = 1", side=side, price=tenth, qty="0"), row("trade", x, "ts_us", "seq % 4 = 2", price=tenth, qty="qty", is_buy="not is_buy"), row("gap", x, "ts_us", "seq % 4 = 3")],
        "lobster_book": whole(x, "0", "every = 1", bid=tenth.replace("price", "bid"), ask=tenth.replace("price", "ask")),
        "iex": quote("symbol", "ts_us") + deal("symbol", "ts_us", "is_buy"),
        "dukascopy": quote(x, "max_ts"),
        "binance": [row("gap", up, ms, "rn > 1 and rn % 7 = 0"), *quote(up, ms), *deal(up, ms, "is_buy")],
        "binance_klines": deal(x, ms, "ask >= price", price="ask", qty="qty * 1000") + whole(x, ms, bid="ask - greatest(ask * 1e-4::double, 0.01)", ask="ask + greatest(ask * 1e-4::double, 0.01)", bid_qty="greatest(qty, 1)", ask_qty="greatest(qty, 1)"),
        "coinbase": whole("symbol", "ts_us", "is_buy") + quote("symbol", "ts_us", "not is_buy"),
        "kraken": whole("symbol", ms, "is_buy") + quote("symbol", ms, "not is_buy"),
        "gemini": jumps(x, "every", "is_buy", "not is_buy"),
        "bitstamp": whole(up, "ts_us"),
        "okx": jumps("symbol", "rn", "rn = 1", "rn > 1"),
        "bybit": jumps("symbol", "rn", "rn = 1", "rn > 1"),
        "alpaca": deal("symbol", "ts_us", "true") + quote("symbol", "ts_us"),
        "polygon": deal("symbol", ms, "false") + quote("symbol", ms),
        "polygon_rest": quote("symbol", "ts_us") + deal("symbol", "ts_us", "false"),
        "tiingo": quote(up, "ts_us") + deal(up, "ts_us", "false"),
        "finnhub": deal(up, ms, "false"),
        "yahoo_chart": deal(up, sec, "false") + whole(up, sec, bid="price - 0.01::double", ask="price + 0.01::double", bid_qty="1000", ask_qty="1000"),
        "yahoo_quote": deal(up, sec, "false") + whole(up, sec, bid_qty="bid_qty * 100", ask_qty="ask_qty * 100"),
    }[feed]
    numbered = _NUMBERED.format(ticks=views.ticks("duckdb"), every=_EVERY).replace("select *,", "select *, max(ts_us) over (order by seq) as max_ts,")
    rounded = ", ".join(f"round({c}, 9) + 0.0 as {c}" if c in ("price", "qty", "bid", "bid_qty", "ask", "ask_qty") else c for c in _OUT)
    return f"with n as ({numbered}), e as ({' union all '.join(rows)}) select {rounded} from e"

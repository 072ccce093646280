"""Parsers of market feeds: raw messages (a `value` column of text, and `line` for their order) to events.

Each is a DataFrame transformation, the same for files and streams; messages that cannot be read give no
event, and a message may hold any number of events. Rules of sequence numbers look at the message before: by a
window in batches, by a state for each instrument in streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.sources.events import deltas_of, delta, emitted, flat, gap, held, level, none, number, pairs, sequenced, snapshot, trade, with_line

Parser = Callable[..., DataFrame]


def _json(raw: DataFrame, schema: str) -> DataFrame:
    return with_line(raw).withColumn("m", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where("m is not null")


def _ruled(raw: DataFrame, parse: Callable[[DataFrame], DataFrame], key: str = "s") -> DataFrame:
    """Messages as parse reads them (line, value, key, until, grows, and what it needs), with `before`."""
    m = sequenced(parse(with_line(raw)), key)
    return parse(m) if raw.isStreaming else m


def _whole(ns: Column) -> Column:
    """Nanoseconds to microseconds in whole numbers: as doubles they would lose the last ones."""
    return F.call_function("div", ns, F.lit(1000))


def _ms(x: Column) -> Column:
    return F.coalesce(x.try_cast("bigint"), F.lit(0)) * 1000


def micros(text: Column) -> Column:
    """ISO time to microseconds; an offset is not applied; 0 if it cannot be read."""
    plain = F.regexp_replace(text, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.concat(F.regexp_replace(F.substring(plain, 1, 26), " ", "T"), F.lit("Z")))), F.lit(0))


def _quote(symbol: Column, ts: Column, bp: Column, bq: Column, ap: Column, aq: Column) -> Column:
    """The level changes of a quote: a side needs a positive price and a size; sizes are not negative."""
    sides = F.array(F.when((bp > 0) & bq.isNotNull(), delta(symbol, ts, "bid", bp, F.greatest(bq, F.lit(0.0)))), F.when((ap > 0) & aq.isNotNull(), delta(symbol, ts, "ask", ap, F.greatest(aq, F.lit(0.0)))))
    return F.filter(sides, lambda x: x.isNotNull())


def lobster(raw: DataFrame, symbol: str) -> DataFrame:
    """Message file: time_s, type, order_id, size, price * 10000, direction."""
    c = F.transform(F.split("value", ","), lambda x: F.trim(x))
    f = with_line(raw).select("line", *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("t", "kind", "id", "size", "price", "dir"))])
    # Nanoseconds as decimals: doubles would lose microseconds.
    ts = F.floor(F.col("t").try_cast("decimal(20,9)") * 1_000_000).cast("bigint")
    f = f.select("line", ts.alias("ts"), F.col("kind").try_cast("int").alias("kind"), number(F.col("size")).alias("size"), (F.col("price").try_cast("bigint") / 1e4).alias("price"), F.col("dir").try_cast("int").alias("dir")).where("ts is not null and kind is not null and size is not null and price is not null and dir is not null")
    s, side = F.lit(symbol), F.when(F.col("dir") == 1, "bid").when(F.col("dir") == -1, "ask")
    event = (
        F.when(F.col("kind") == 7, gap(s, F.col("ts"))).when(side.isNull(), F.lit(None))
        .when(F.col("kind").isin(1, 2, 3), delta(s, F.col("ts"), side, F.col("price"), F.when(F.col("kind") == 3, 0.0).otherwise(F.col("size"))))
        .when(F.col("kind").isin(4, 5), trade(s, F.col("ts"), F.col("price"), F.col("size"), F.col("dir") == -1))
    )
    return emitted(f, F.filter(F.array(event), lambda x: x.isNotNull()), "lobster")


def lobster_book(raw: DataFrame, symbol: str, levels: int = 10) -> DataFrame:
    """The first row of a book file as a snapshot: (ask price, ask size, bid price, bid size) for each level."""
    first = with_line(raw).where(F.trim("value") != "").orderBy("line").limit(1)
    c = F.split("value", ",")
    short = F.size(c) < 4 * levels
    at = lambda i: number(F.trim(F.get(c, F.lit(i))))
    side = lambda o: held(F.array(*[level(at(4 * i + o) / 1e4, at(4 * i + o + 1)) for i in range(levels)]))
    checked = F.when(short, F.raise_error(F.lit(f"a book row needs {4 * levels} columns"))).otherwise(F.lit(0).cast("bigint"))
    return emitted(first, F.array(snapshot(F.lit(symbol), checked, side(2), side(0))), "lobster")


def iex(raw: DataFrame) -> DataFrame:
    """JSON lines: quotes (Q) and trades (T); blanks and comments are skipped. Server-sent events may keep their prefix, and hold
    one message or an array of them."""
    clean = with_line(raw).withColumn("value", F.regexp_replace(F.trim("value"), r"^data:\s*", "")).where("value != '' and not startswith(value, '#')")
    clean = clean.withColumn("value", F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))))

    def one(**f: Column) -> Column:
        us = lambda *c: _whole(F.coalesce(*[f[x].try_cast("bigint") for x in c], F.lit(0)))
        s, n = f["s"], {c: number(f[c]) for c in ("bp", "bs", "ap", "aq", "p", "q")}
        side = lambda name, p, q: F.when((n[p] > 0) & (n[q] >= 0), delta(s, us("updated", "time"), name, n[p], n[q]))
        quote = F.filter(F.array(side("bid", "bp", "bs"), side("ask", "ap", "aq")), lambda x: x.isNotNull())
        buy = F.coalesce(f["flags"].try_cast("bigint").bitwiseAND(1) == 1, F.lit(False))
        deal = F.when((n["p"] > 0) & (n["q"] > 0), F.array(trade(s, us("time", "updated"), n["p"], n["q"], buy)))
        kind = F.coalesce(f["kind"], f["type"])
        return F.when(kind == "Q", quote).when(kind == "T", F.coalesce(deal, none())).otherwise(none())

    paths = {"kind": "messageType", "type": "type", "s": "symbol", "bp": "bidPrice", "bs": "bidSize", "ap": "askPrice", "aq": "askSize", "p": "price", "q": "size", "flags": "flags", "updated": "lastUpdated", "time": "timestamp"}
    return _listed(clean, "iex", one, **paths)


def dukascopy(raw: DataFrame, symbol: str, clamp: bool = True) -> DataFrame:
    """Tick CSV: time, ask, bid, ask volume, bid volume (or one volume); a header is skipped. With clamp, time never runs back."""
    c = F.split("value", ",")
    at = lambda i: F.trim(F.get(c, F.lit(i)))
    iso = F.regexp_replace(F.regexp_replace(at(0), r"^(\d{4})[.-](\d{2})[.-](\d{2})", "$1-$2-$3"), r"^(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1")
    iso = F.regexp_replace(iso, " ", "T")

    def parse(m: DataFrame) -> DataFrame:
        f = m.withColumns({"until": F.unix_micros(F.try_to_timestamp(F.concat(F.regexp_replace(iso, "Z$", ""), F.lit("Z")))), "ask": number(at(1)), "bid": number(at(2)), "aq": F.coalesce(number(at(3)), F.lit(1.0)), "bq": F.coalesce(number(at(4)), number(at(3)), F.lit(1.0)), "s": F.lit(symbol), "grows": F.lit(True)})
        return f.where("until is not null and bid > 0 and ask > bid")

    f = _ruled(raw, parse) if clamp else parse(with_line(raw)).withColumn("before", F.lit(None).cast("bigint"))
    f = f.withColumn("ts", F.greatest("until", "before"))
    s = F.lit(symbol)
    return emitted(f, F.array(delta(s, F.col("ts"), "bid", F.col("bid"), F.col("bq")), delta(s, F.col("ts"), "ask", F.col("ask"), F.col("aq"))), "dukascopy")


def binance(raw: DataFrame) -> DataFrame:
    """Depth updates and aggregate trades, alone or in a stream's envelope; symbols in upper case. Depth follows
    U <= last u + 1 <= u; older updates are dropped, jumps are gaps."""
    # Names of fields differ by case alone, so each is taken by its path.
    fields = {"kind": "e", "event_ms": "E", "s": "s", "first_id": "U", "until": "u", "b": "b", "a": "a", "trade_ms": "T", "p": "p", "q": "q", "maker": "m"}

    def parse(m: DataFrame) -> DataFrame:
        m = m.withColumns({"d": F.coalesce(F.get_json_object("value", "$.data"), "value"), "stream": F.get_json_object("value", "$.stream")})
        m = m.withColumns({n: F.get_json_object("d", f"$.{path}") for n, path in fields.items()})
        levels = {c: F.from_json(c, "array<array<string>>") for c in ("b", "a")}
        m = m.withColumns({"s": F.upper(F.coalesce("s", F.split("stream", "@")[0])), **{c: F.col(c).try_cast("bigint") for c in ("first_id", "until")}, "grows": F.lit(True), **levels})
        return m.withColumn("until", F.when(F.col("b").isNotNull() | F.col("a").isNotNull(), F.col("until")))

    m = _ruled(raw, parse)
    ts, s, before = _ms(F.col("event_ms")), F.col("s"), F.col("before")
    lost = F.coalesce(before.isNotNull() & (F.col("first_id") > before + 1), F.lit(False))
    old = F.coalesce(F.col("until") <= before, F.lit(False))
    change = F.concat(deltas_of(pairs(F.col("b")), s, ts, "bid"), deltas_of(pairs(F.col("a")), s, ts, "ask"))
    book = F.when(old, none()).when(lost, F.concat(F.array(gap(s, ts)), change)).otherwise(change)
    price, qty = number(F.col("p")), number(F.col("q"))
    is_deal = ((F.col("kind") == "aggTrade") | (F.col("p").isNotNull() & F.col("b").isNull())) & (price > 0) & (qty > 0)
    deal = F.when(F.coalesce(is_deal, F.lit(False)), F.array(trade(s, _ms(F.col("trade_ms")), price, qty, ~F.coalesce(F.col("maker") == "true", F.lit(False))))).otherwise(none())
    return emitted(m, F.concat(F.when(F.col("b").isNotNull() | F.col("a").isNotNull(), book).otherwise(none()), deal), "binance")


def binance_klines(raw: DataFrame, symbol: str) -> DataFrame:
    """Bars: a trade at the close, buy if it is not below the open, and a book around it."""
    m, s = with_line(raw).withColumn("rows", F.from_json("value", "array<array<string>>")), F.lit(symbol.upper())

    def bar(k: Column) -> Column:
        at = lambda i: number(F.get(k, F.lit(i)))
        o, c, v, ms = at(1), at(4), at(5), F.get(k, F.lit(6)).try_cast("bigint")
        half, size, ts = F.greatest(c * 1e-4, F.lit(0.01)), F.greatest(v / 1000, F.lit(1.0)), ms * 1000
        both = F.array(trade(s, ts, c, v, c >= o), snapshot(s, ts, F.array(level(c - half, size)), F.array(level(c + half, size))))
        return F.when(o.isNotNull() & c.isNotNull() & v.isNotNull() & ms.isNotNull(), both).otherwise(none())

    return emitted(m, flat(F.transform("rows", bar)), "binance_rest")


def coinbase(raw: DataFrame) -> DataFrame:
    """Channel l2_data; the message's own time, where it has one."""
    m = _json(raw, "channel string, timestamp string, events array<struct<type:string,product_id:string,updates:array<struct<side:string,price_level:string,new_quantity:string,event_time:string>>>>").where("m.channel = 'l2_data'")
    ts = micros(F.col("m.timestamp"))

    def one(e: Column) -> Column:
        ups = F.transform(e["updates"], lambda x: F.struct(F.when(x["side"] == "bid", "bid").when(x["side"].isin("offer", "ask"), "ask").alias("side"), number(x["price_level"]).alias("price"), number(x["new_quantity"]).alias("qty")))
        ups = F.coalesce(F.filter(ups, lambda x: x["side"].isNotNull() & (x["price"] > 0) & (x["qty"] >= 0)), F.array().cast("array<struct<side:string,price:double,qty:double>>"))
        side = lambda n: F.transform(F.filter(ups, lambda x: x["side"] == n), lambda x: level(x["price"], x["qty"]))
        s = e["product_id"]
        return F.when(e["type"] == "snapshot", F.array(snapshot(s, ts, side("bid"), side("ask")))).otherwise(F.transform(ups, lambda x: delta(s, ts, x["side"], x["price"], x["qty"])))

    return emitted(m, flat(F.transform("m.events", one)), "coinbase")


def kraken(raw: DataFrame) -> DataFrame:
    """Book channel, version 2: the first data element."""
    lv = "array<struct<price:double,qty:double>>"
    m = _json(raw, f"channel string, type string, method string, data array<struct<symbol:string,bids:{lv},asks:{lv},checksum:bigint,timestamp_ms:bigint>>")
    m = m.where("coalesce(m.channel, '') not in ('heartbeat', 'status') and coalesce(m.method, '') != 'subscribe' and size(m.data) > 0").withColumn("d", F.get("m.data", F.lit(0)))
    empty = F.array().cast(lv)
    b, a, ts, s = F.coalesce("d.bids", empty), F.coalesce("d.asks", empty), _ms(F.col("d.timestamp_ms")), F.col("d.symbol")
    return emitted(m, F.when(F.col("m.type") == "snapshot", F.array(snapshot(s, ts, held(b), held(a)))).otherwise(F.concat(deltas_of(b, s, ts, "bid"), deltas_of(a, s, ts, "ask"))), "kraken")


def gemini(raw: DataFrame, symbol: str) -> DataFrame:
    """Market data, version 1: a batch of initial changes is a snapshot; a socket_sequence that is not the one after the last is a gap."""
    schema = "type string, timestampms bigint, socket_sequence bigint, events array<struct<type:string,reason:string,price:string,remaining:string,side:string>>"
    m = _ruled(raw, lambda r: _json(r, schema).withColumns({"until": F.col("m.socket_sequence"), "s": F.lit(symbol), "grows": F.lit(False)}))
    lost = F.coalesce(F.col("until") != F.col("before") + 1, F.lit(False))
    ups = F.transform("m.events", lambda x: F.struct((x["reason"] == "initial").alias("initial"), x["side"].alias("side"), number(x["price"]).alias("price"), F.coalesce(number(x["remaining"]), F.lit(0.0)).alias("qty"), (x["type"] == "change").alias("change")))
    ups = F.filter(ups, lambda x: x["change"] & (x["price"] > 0) & x["side"].isin("bid", "ask"))
    m = m.withColumn("u", F.coalesce(ups, F.array().cast("array<struct<initial:boolean,side:string,price:double,qty:double,change:boolean>>")))
    s, ts = F.lit(symbol), _ms(F.col("m.timestampms"))
    side = lambda n: F.transform(F.filter("u", lambda x: x["initial"] & (x["side"] == n) & (x["qty"] > 0)), lambda x: level(x["price"], x["qty"]))
    first = F.exists("u", lambda x: F.coalesce(x["initial"], F.lit(False)))
    change = F.when(first, F.array(snapshot(s, ts, side("bid"), side("ask")))).otherwise(F.transform("u", lambda x: delta(s, ts, x["side"], x["price"], x["qty"])))
    return emitted(m, F.when(lost, F.array(gap(s, ts))).when(F.col("m.type") == "update", change).otherwise(none()), "gemini")


def channel_symbol(channel: Column) -> Column:
    return F.upper(F.regexp_replace(channel, "^(?:diff_|detail_)?order_book_", ""))


def bitstamp(raw: DataFrame) -> DataFrame:
    """Every message is a whole book."""
    m = _json(raw, "event string, channel string, data struct<timestamp:string,microtimestamp:string,bids:array<array<string>>,asks:array<array<string>>>").where("m.event = 'data' and m.channel != '' and m.data is not null")
    ts = F.when(F.col("m.data.microtimestamp").isNotNull(), F.coalesce(F.col("m.data.microtimestamp").try_cast("bigint"), F.lit(0))).otherwise(F.coalesce(F.col("m.data.timestamp").try_cast("bigint"), F.lit(0)) * 1_000_000)
    return emitted(m, F.array(snapshot(channel_symbol(F.col("m.channel")), ts, held(pairs(F.col("m.data.bids")), True), held(pairs(F.col("m.data.asks")), True))), "bitstamp")


def okx(raw: DataFrame) -> DataFrame:
    """Channel books: an update's prevSeqId must be the instrument's last seqId."""
    schema = "event string, action string, arg struct<channel:string,instId:string>, data array<struct<bids:array<array<string>>,asks:array<array<string>>,ts:string,seqId:bigint,prevSeqId:bigint>>"
    m = _ruled(raw, lambda r: _json(r, schema).where("m.event is null and m.data is not null").withColumns({"s": F.coalesce("m.arg.instId", F.lit("")), "until": F.element_at(F.filter("m.data.seqId", lambda x: x.isNotNull()), -1), "grows": F.lit(False)}))
    first, s = F.col("m.action") == "snapshot", F.col("s")

    def one(d: Column, i: Column) -> Column:
        last = F.when(i == 0, F.col("before")).otherwise(F.get("m.data", i - 1)["seqId"])
        ts, b, a = _ms(d["ts"]), pairs(d["bids"]), pairs(d["asks"])
        lost = F.coalesce(~first & (d["prevSeqId"] != last), F.lit(False))
        return F.when(lost, F.array(gap(s, ts))).when(first, F.array(snapshot(s, ts, held(b), held(a)))).otherwise(F.concat(deltas_of(b, s, ts, "bid"), deltas_of(a, s, ts, "ask")))

    return emitted(m, flat(F.transform("m.data", one)), "okx")


def bybit(raw: DataFrame) -> DataFrame:
    """Order book topics: an update's u must be the one after the symbol's last."""
    schema = "topic string, type string, op string, ts bigint, data struct<s:string,b:array<array<string>>,a:array<array<string>>,u:bigint,seq:bigint>"
    m = _ruled(raw, lambda r: _json(r, schema).where("m.op is null and m.data is not null").withColumns({"s": F.col("m.data.s"), "until": F.col("m.data.u"), "grows": F.lit(False)}))
    first = F.col("m.type") == "snapshot"
    lost = ~first & (F.col("until") != F.col("before") + 1)
    ts, s, b, a = _ms(F.col("m.ts")), F.col("s"), pairs(F.col("m.data.b")), pairs(F.col("m.data.a"))
    return emitted(m, F.when(F.coalesce(lost, F.lit(False)), F.array(gap(s, ts))).when(first, F.array(snapshot(s, ts, held(b), held(a)))).otherwise(F.concat(deltas_of(b, s, ts, "bid"), deltas_of(a, s, ts, "ask"))), "bybit")


def _listed(raw: DataFrame, exchange: str, one: Callable[..., Column], source: Column | str = "value", **paths: str) -> DataFrame:
    """Events of messages that are arrays; one() makes an element's from fields taken by path, as names may differ by case alone."""
    m = with_line(raw).withColumn("ms", F.from_json(source, "array<string>"))
    return emitted(m, flat(F.transform("ms", lambda k: one(**{n: F.get_json_object(k, f"$.{p}") for n, p in paths.items()}))), exchange)


_STOCK = {"p": "p", "s": "s", "t": "t", "bp": "bp", "bs": "bs", "ap": "ap", "aq": "as"}


def _stock(symbol: Column, ts: Column, is_trade: Column, is_quote: Column, buy: bool, f: dict[str, Column]) -> Column:
    p, q = number(f["p"]), number(f["s"])
    deal = F.when((p > 0) & (q > 0), F.array(trade(symbol, ts, p, q, buy)))
    return F.when(is_trade, F.coalesce(deal, none())).when(is_quote, _quote(symbol, ts, *[number(f[c]) for c in ("bp", "bs", "ap", "aq")])).otherwise(none())


def alpaca(raw: DataFrame) -> DataFrame:
    """Trades (t) and quotes (q)."""
    return _listed(raw, "alpaca", lambda kind, sym, **f: _stock(sym, micros(f["t"]), kind == "t", kind == "q", True, f), kind="T", sym="S", **_STOCK)


def polygon(raw: DataFrame) -> DataFrame:
    """Quotes (Q) and trades (T); aggregates and status are ignored."""
    return _listed(raw, "polygon", lambda kind, sym, **f: _stock(F.coalesce(sym, F.lit("")), _ms(f["t"]), kind == "T", kind == "Q", False, f), kind="ev", sym="sym", **_STOCK)


def polygon_rest(raw: DataFrame) -> DataFrame:
    """Snapshots of tickers: last quote and last trade, in nanoseconds."""

    def one(s: Column, **f: Column) -> Column:
        us = lambda c: _whole(F.coalesce(f[c].try_cast("bigint"), F.lit(0)))
        p, q = number(f["p"]), number(f["q"])
        deal = F.when((p > 0) & q.isNotNull(), F.array(trade(s, us("tt"), p, q, False)))
        return F.concat(_quote(s, us("qt"), *[number(f[c]) for c in ("bp", "bq", "ap", "aq")]), F.coalesce(deal, none()))

    last = {"bp": "lastQuote.p", "bq": "lastQuote.s", "ap": "lastQuote.P", "aq": "lastQuote.S", "qt": "lastQuote.t", "p": "lastTrade.p", "q": "lastTrade.s", "tt": "lastTrade.t"}
    return _listed(raw, "polygon_rest", one, F.get_json_object("value", "$.tickers"), s="ticker", **last)


def tiingo(raw: DataFrame) -> DataFrame:
    """Positional messages of type A: a quote's two sides and the last trade."""
    m = _json(raw, "messageType string, data array<string>").where("m.messageType = 'A'").withColumn("d", F.col("m.data")).where("get(d, 0) = 'T' and get(d, 1) is not null")
    at = lambda i: F.coalesce(number(F.get("d", F.lit(i))), F.lit(0.0))
    m = m.select("line", F.upper(F.get("d", F.lit(1))).alias("s"), at(3).alias("p"), at(4).alias("q"), at(6).alias("bp"), at(7).alias("bq"), at(8).alias("ap"), at(9).alias("aq"), micros(F.get("d", F.lit(10))).alias("ts")).where("bp > 0 and ap > 0 and p > 0")
    s, ts = F.col("s"), F.col("ts")
    return emitted(m, F.array(delta(s, ts, "bid", F.col("bp"), F.col("bq")), delta(s, ts, "ask", F.col("ap"), F.col("aq")), trade(s, ts, F.col("p"), F.col("q"), False)), "tiingo")


def finnhub(raw: DataFrame) -> DataFrame:
    """Trades; a missing volume is 1."""
    m = _json(raw, "type string, data array<struct<p:double,s:string,t:bigint,v:double>>").where("m.type = 'trade'")
    deals = F.transform(F.filter("m.data", lambda x: x["p"] > 0), lambda x: trade(F.upper(x["s"]), x["t"] * 1000, x["p"], F.coalesce(x["v"], F.lit(1.0)), False))
    return emitted(m, F.coalesce(deals, none()), "finnhub")


def yahoo_chart(raw: DataFrame) -> DataFrame:
    """Bars of the first result: a trade at the close, then a book a cent around it."""
    m = _json(raw, "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>,volume:array<double>>>>>>>").withColumn("r", F.get("m.chart.result", F.lit(0)))
    q = F.get("r.indicators.quote", F.lit(0))
    bars = F.filter(F.arrays_zip(F.col("r.timestamp").alias("t"), q["close"].alias("c"), q["volume"].alias("v")), lambda x: x["t"].isNotNull() & (x["c"] > 0))
    s = F.upper("r.meta.symbol")
    both = F.flatten(F.transform(bars, lambda x: F.array(trade(s, x["t"] * 1_000_000, x["c"], F.coalesce(x["v"], F.lit(0.0)), False), snapshot(s, x["t"] * 1_000_000, F.array(level(x["c"] - 0.01, F.lit(1000.0))), F.array(level(x["c"] + 0.01, F.lit(1000.0)))))))
    return emitted(m, F.coalesce(both, none()), "yahoo")


def yahoo_quote(raw: DataFrame) -> DataFrame:
    """Quotes: the last trade, then a book with sizes in lots of 100. Bid, ask and last must be positive."""
    m = _json(raw, "quoteResponse struct<result:array<struct<symbol:string,bid:double,ask:double,bidSize:double,askSize:double,regularMarketPrice:double,regularMarketVolume:double,regularMarketTime:bigint>>>")
    ok = F.filter("m.quoteResponse.result", lambda x: (x["bid"] > 0) & (x["ask"] > 0) & (x["regularMarketPrice"] > 0))

    def both(x: Column) -> Column:
        s, ts = F.upper(x["symbol"]), F.coalesce(x["regularMarketTime"], F.lit(0)) * 1_000_000
        lot = lambda c: F.coalesce(x[c], F.lit(1.0)) * 100
        return F.array(trade(s, ts, x["regularMarketPrice"], F.coalesce(x["regularMarketVolume"], F.lit(0.0)), False), snapshot(s, ts, F.array(level(x["bid"], lot("bidSize"))), F.array(level(x["ask"], lot("askSize")))))

    return emitted(m, F.coalesce(F.flatten(F.transform(ok, both)), none()), "yahoo")


#: Parsers by feed. Those that take a symbol read files or sockets of one instrument.
FEEDS: dict[str, Parser] = {
    "lobster": lobster, "lobster_book": lobster_book, "iex": iex, "dukascopy": dukascopy, "binance": binance, "binance_klines": binance_klines, "coinbase": coinbase, "kraken": kraken,
    "gemini": gemini, "bitstamp": bitstamp, "okx": okx, "bybit": bybit, "alpaca": alpaca, "polygon": polygon, "polygon_rest": polygon_rest, "tiingo": tiingo, "finnhub": finnhub, "yahoo_chart": yahoo_chart, "yahoo_quote": yahoo_quote,
}
OF_ONE_SYMBOL = frozenset({"lobster", "lobster_book", "dukascopy", "binance_klines", "gemini"})

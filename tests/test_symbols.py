"""Names of instruments, subscriptions, tick files, and reports as text."""

import json
import lzma
import struct

import pytest

from lobspark.functions import symbols
from lobspark.plans import report
from lobspark.sources import files, sinks


def test_names(spark):
    df = spark.createDataFrame([("btcusd",), ("ETH-USDT",), ("sol/eur",), ("linkjpy",), ("xbt",)], "s string")
    of = lambda f: [r[0] for r in df.select(f(df.s)).collect()]
    assert of(symbols.product_id) == ["BTC-USD", "ETH-USDT", "SOL-EUR", "LINK-JPY", "XBT"]
    assert of(symbols.kraken_symbol) == ["BTC/USD", "ETH/USDT", "SOL/EUR", "LINK/JPY", "XBT"]
    assert of(symbols.gemini_symbol) == ["BTCUSD", "ETHUSDT", "SOLEUR", "LINKJPY", "XBT"]
    assert of(symbols.bitstamp_channel)[1] == "order_book_ethusdt" and of(symbols.inst_id)[2] == "SOL-EUR" and of(symbols.file_name)[1] == "eth_usdt"
    assert [symbols.chart_interval(d) for d in (1, 7, 8, 60, 61)] == ["1m", "1m", "5m", "5m", "1h"]


@pytest.mark.parametrize("feed", ["kraken", "okx", "bybit", "coinbase", "alpaca", "polygon", "bitstamp", "tiingo", "finnhub"])
def test_subscriptions_name_their_instruments(feed):
    text = symbols.subscription(feed, ["BTCUSD"])
    assert "btcusd" in text.lower() and json.loads(text)


def test_damaged_tick_files_stop_the_job(spark, tmp_path):
    day = tmp_path / "EURUSD" / "2024" / "00" / "15"
    day.mkdir(parents=True)
    tick = struct.pack(">IIIff", 0, 110010, 110000, 1.5, 2.5)
    (day / "10h_ticks.bi5").write_bytes(lzma.compress(tick + struct.pack(">IIIff", 1, 0, 110000, 1.5, 2.5), format=lzma.FORMAT_ALONE))
    assert files.dukascopy_hours(spark, str(tmp_path)).count() == 1
    (day / "11h_ticks.bi5").write_bytes(lzma.compress(tick[:-3], format=lzma.FORMAT_ALONE))
    with pytest.raises(Exception, match="damaged"):
        files.dukascopy_hours(spark, str(tmp_path)).count()


def test_backtest_text(spark, tmp_path):
    rows = [("A", w, k, 12, 0.25, 3, 0.5 * k, 0.1, 0.2, 0.3) for w in range(300) for k in (0.5, 1.0)]
    results = spark.createDataFrame(rows, "symbol string, window_idx int, k double, test_rows long, oos_ic double, n_trades long, total_pnl_net double, period_sharpe double, max_drawdown double, turnover double")
    from lobspark.operators.backtest import summarised

    sinks.write_lines(spark, report.backtest_text(results, summarised(results)), str(tmp_path / "out" / "report.txt"))
    text = (tmp_path / "out" / "report.txt").read_text()
    assert text.count("\n") == 300 + 2 + 600 + 3 * 3 and "k=0.5 +0.250000  k=1.0 +0.500000" in text and "1. Windows" in text

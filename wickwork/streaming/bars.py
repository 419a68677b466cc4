"""Closed-bar streaming: events to bars in append mode, bars to recursive indicators with state per symbol."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "symbol_id bigint, ts timestamp, close double, ema double, rsi double"


def closed_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of ``events`` (ts, event_id, user_id, value) that the watermark has closed; a bar is never sent twice.

    Events later than ``late`` are dropped; the query's progress counts them.
    """
    key = F.struct("ts", "event_id")
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("user_id").cast("bigint").alias("symbol_id"))
    bars = g.agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


class RunningIndicators(StatefulProcessor):
    """EMA and RSI of closed bars, one small state row a symbol."""

    def __init__(self, ema_period: int = 20, rsi_period: int = 14):
        self.ema_period, self.rsi_period = ema_period, rsi_period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n bigint, close double, ema double, gain double, loss double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        n, last, ema, gain, loss = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0)
        bars = pd.concat(list(rows)).sort_values("ts")
        out = []
        for ts, close in zip(bars["ts"], bars["close"], strict=True):
            n += 1
            # Seeds are running means until a period is full.
            ema = ema + (close - ema) / n if n <= self.ema_period else ema + (close - ema) * 2 / (self.ema_period + 1)
            if n > 1:
                up, down = max(close - last, 0.0), max(last - close, 0.0)
                k = min(n - 1, self.rsi_period)
                gain, loss = gain + (up - gain) / k, loss + (down - loss) / k
            last = close
            rsi = None if n <= self.rsi_period else (50.0 if gain == 0 else 100.0) if loss == 0 else 100 - 100 / (1 + gain / loss)
            out.append((key[0], ts, close, ema if n >= self.ema_period else None, rsi))
        self.state.update((n, last, ema, gain, loss))
        yield pd.DataFrame(out, columns=["symbol_id", "ts", "close", "ema", "rsi"])

    def close(self) -> None:
        pass


def running_indicators(bars: DataFrame) -> DataFrame:
    return bars.select("symbol_id", "ts", "close").groupBy("symbol_id").transformWithStateInPandas(statefulProcessor=RunningIndicators(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")

"""One bad series or calendar gap leaves the rest alone."""

import datetime

from pyspark.sql import functions as F

from tests.test_indicators import candles
from wickwork.config import QualityOptions
from wickwork.operators import context, indicators
from wickwork.schema import SERIES


def wave(n):
    return [(10 + k % 5, 12 + k % 7, 8 - k % 3, 9 + k % 4, 100 + k) for k in range(n)]


def test_a_missing_price_ends_its_own_series(spark):
    sound, bad = candles(spark, wave(60), symbol=1), candles(spark, wave(60), symbol=2)
    day = datetime.date(2026, 1, 1) + datetime.timedelta(days=40)
    both = sound.unionByName(bad.withColumn("close", F.when(F.col("ts") != F.lit(day), F.col("close"))))
    for block in (indicators.BLOCK, 16):
        got = {(r["symbol_id"], r["rn"]): r for r in indicators.fold_indicators(indicators.prepared(both), ("ema_20", "rsi_14"), block).collect()}
        assert all(got[1, k]["error"] is None and got[1, k]["ema_20"] is not None for k in range(20, 61))
        for k in range(1, 61):
            if k <= 40:
                assert got[2, k]["error"] is None and got[2, k]["ema_20"] == got[1, k]["ema_20"]
            else:
                assert got[2, k]["error"] == f"null close on {day}" and got[2, k]["ema_20"] is None and got[2, k]["rsi_14"] is None


def test_a_failing_fold_is_a_message(spark, monkeypatch):
    bars = indicators.prepared(candles(spark, wave(20)))
    got = indicators.fold_indicators(bars.withColumn("tr", F.lit(None).cast("double")), ("atr_14",)).collect()
    assert [r["atr_14"] for r in got] == [None] * 20  # nothing to average is no failure


def test_missing_days_as_of_every_candle(spark):
    days = [0, 1, 2, 4, 5, 8, 9, 10, 15]
    start = datetime.date(2026, 1, 1)
    at = lambda k: start + datetime.timedelta(days=k)
    c = spark.createDataFrame([(1, "Daily", at(k), 1) for k in days], "symbol_id long, timeframe string, ts date, volume long")
    calendar = [1, 3, 4, 6, 7, 12, 13, 14, 20]
    cal = spark.createDataFrame([(at(k),) for k in [*calendar, 3]], "day date")
    for window in (1, 3, 60):
        got = {r["ts"]: r["n_missing"] for r in context.with_missing(c, cal, QualityOptions(window=window, min_traded_days=0)).collect()}
        for i, k in enumerate(days):
            first = days[max(0, i - window + 1)]
            assert got[at(k)] == len([x for x in calendar if first <= x <= k and x not in days]), (window, k)
    assert {r["n_missing"] for r in context.with_missing(c, None, QualityOptions()).collect()} == {0}
    assert context.with_missing(c.limit(0), cal, QualityOptions()).select(*SERIES).count() == 0

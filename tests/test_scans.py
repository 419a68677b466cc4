"""Recurrences in blocks against plain loops and against the one-pass fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wickwork.operators import indicators, scans
from wickwork.schema import SERIES
from wickwork.sources import derived

SF = "/root/testdata/sf0.001"


def plain_hold(x, low, high, reset):
    out = []
    for a, b, r in zip(low, high, reset):
        if a is not None and (a > b or (x is not None and not a <= x <= b)):
            x = r
        out.append(x)
    return out


def test_hold_maps_compose():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randrange(1, 12)
        rows = [(None, None, None) if rng.random() < 0.2 else (a := rng.randrange(10), a + rng.randrange(-1, 6), rng.randrange(12)) for _ in range(n)]
        if rng.random() < 0.3:
            rows[0] = (math.inf, -math.inf, rng.randrange(12))
        columns = list(zip(*rows))
        folded = scans.HoldMap.folded(*columns)
        for x in [None, *range(-1, 14)]:
            if x is None and any(a is not None and a > b and a != math.inf for a, b, _ in rows):
                continue  # a value starts at an empty band from infinity on
            want = plain_hold(x, *columns)
            assert scans.HoldMap.values(x, *columns) == want
            assert scans.HoldMap.after(x, folded) == want[-1], (rows, x)


def test_affine_maps_compose():
    rng = random.Random(4)
    for _ in range(500):
        rows = [(None, None) if rng.random() < 0.2 else (0.0, 5.0) if rng.random() < 0.1 else (rng.random(), rng.random()) for _ in range(rng.randrange(1, 9))]
        for x in (None, 1.5):
            want = scans.AffineMap.values(x, *zip(*rows))[-1]
            got = scans.AffineMap.after(x, scans.AffineMap.folded(*zip(*rows)))
            assert got == want if want is None or got is None else got == pytest.approx(want, rel=1e-12)


def compared(spark, candles, block, columns=None):
    bars = indicators.prepared(candles)
    keys = [*SERIES, "ts"]
    a = {tuple(r[k] for k in keys): r for r in indicators.fold_indicators(bars, columns).collect()}
    b = {tuple(r[k] for k in keys): r for r in indicators.fold_indicators(bars, columns, block).collect()}
    assert a.keys() == b.keys() and a
    for k, r in a.items():
        for c in columns or indicators.FOLD_COLUMNS:
            assert (r[c] is None) == (b[k][c] is None), (k, c, r[c], b[k][c])
            assert r[c] is None or b[k][c] == pytest.approx(r[c], rel=1e-7, abs=1e-7), (k, c)


def test_blocks_of_seven_candles_give_the_same_indicators(spark):
    c = derived.daily_candles(spark, SF)
    compared(spark, c.join(c.groupBy("symbol_id").count().orderBy("symbol_id").limit(3).select("symbol_id"), "symbol_id"), 7)


def test_only_what_is_asked_for_is_scanned(spark):
    c = derived.daily_candles(spark, SF).filter("symbol_id = 1")
    for columns in (("supertrend",), ("tema_20", "trix_15"), ("stoch_rsi_d",), ("keltner_upper",), ("volume_ema", "adx_14")):
        compared(spark, c, 50, columns)


def test_series_around_a_block_border(spark):
    rows = [(s, "Daily", k, 10.0 + (k * 7 + s) % 5, 9.0 - (k + s) % 3, 9.5 + (k * k + s) % 2, 100 + k) for s, n in ((1, 19), (2, 20), (3, 21), (4, 41)) for k in range(n)]
    c = spark.createDataFrame(rows, "symbol_id long, timeframe string, ts int, high double, low double, close double, volume long").withColumn("ts", F.date_add(F.lit("2020-01-01").cast("date"), F.col("ts")))
    compared(spark, c, 20, ("atr_14", "supertrend", "supertrend_up", "ema_20", "rsi_14"))

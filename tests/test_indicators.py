import datetime

import pytest
from pyspark.sql import functions as F

from wickwork.operators import indicators as I
from wickwork.schema import CANDLES
from wickwork.sources import derived

SF = "/root/testdata/sf0.001"


def candles(spark, rows, symbol=1):
    """rows: (open, high, low, close[, volume])."""
    day = datetime.date(2026, 1, 1)
    data = [(symbol, "Daily", day + datetime.timedelta(days=k), *map(float, r[:4]), float(r[3]), int(r[4]) if len(r) > 4 else 1000) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, CANDLES)


def flat(spark, closes, volumes=None):
    return candles(spark, [(c, c + 1, c - 1, c, v) for c, v in zip(closes, volumes or [1000] * len(closes), strict=True)])


def test_rsi_golden():
    assert I._rsi([20.0, 22, 21, 23, 24, 26], 5)[-1] == pytest.approx(87.5)
    assert round(I._rsi([20.0, 22, 21, 23, 24, 26, 25], 5)[-1], 2) == 75.68


def test_atr_golden():
    assert I._wilder([10.0, 10, 8, 6], 3) == [None, None, pytest.approx(28 / 3), pytest.approx((28 / 3 * 2 + 6) / 3)]


def test_obv_golden(spark):
    c = flat(spark, [100, 105, 103], [1000, 2000, 1500])
    assert [r["obv"] for r in I.indicator(c, "OBV").orderBy("ts").collect()] == [0, 2000, 500]


def test_constant_prices(spark):
    c = candles(spark, [(50, 50, 50, 50)] * 70)
    frame = I.indicator_frame(c).orderBy(F.desc("ts")).first()
    for k in ("sma_20", "wma_20", "hma_20", "dema_20", "tema_20", "kama_10", "vwap", "bollinger"):
        assert frame[k] == pytest.approx(50)
    for k, v in {"cci_20": 0, "roc_12": 0, "williams_r": -50, "trix_15": 0, "cmf_20": 0, "mfi_14": 50, "stoch_rsi_k": 50, "rsi_14": 50, "range_ratio": 1, "stochastic_k": 50}.items():
        assert frame[k] == pytest.approx(v)


def test_first_value_of_each_indicator(spark):
    frame = I.indicator_frame(derived.daily_candles(spark, SF)).cache()
    for i in I.REGISTRY.values():
        early = frame.filter((F.col("rn") < i.first) & F.col(i.columns[0]).isNotNull()).count()
        late = frame.filter((F.col("rn") == i.first) & F.col(i.columns[0]).isNull()).count()
        assert (early, late) == (0, 0), i.key


def test_prefix_gives_the_same_values(spark):
    """No look-ahead: values on a prefix equal those on the whole series."""
    c = derived.daily_candles(spark, SF).filter("symbol_id <= 3")
    cols = [x for i in I.REGISTRY.values() for x in i.columns]
    whole = I.indicator_frame(c).filter("rn = 200").select("symbol_id", *cols).orderBy("symbol_id").collect()
    first = I.prepared(c).filter("rn <= 200").select(*c.columns)
    part = I.indicator_frame(first).filter("rn = 200").select("symbol_id", *cols).orderBy("symbol_id").collect()
    assert len(whole) == 4
    for a, b in zip(whole, part, strict=True):
        for k in cols:
            assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9), k


def test_empty_table(spark):
    assert I.indicator_frame(spark.createDataFrame([], CANDLES)).count() == 0


def test_regression_equals_sliding_regressions_without_their_frame(spark):
    from wickwork.functions.scalars import last_n

    c = candles(spark, [(50 + (k * k) % 17, 80, 40, 50 + (k * k) % 17) for k in range(60)])
    c = c.withColumn("close", F.when(~F.dayofmonth("ts").isin(9, 10), F.col("close")))
    bars = I.window_indicators(I.prepared(c), ["RegressionChannel_20"])
    assert "regr_" not in bars._jdf.queryExecution().analyzed().toString()
    w = last_n(20)
    slope, at = F.regr_slope("close", "rn").over(w), F.regr_intercept("close", "rn").over(w)
    rest = F.sqrt(F.greatest(F.regr_syy("close", "rn").over(w) - slope * slope * F.regr_sxx("close", "rn").over(w), F.lit(0.0)) / 20)
    rows = bars.withColumns({"s": slope, "v": at + slope * F.col("rn"), "r": rest}).filter("rn >= 20").collect()
    for r in rows:
        assert (r["regression_slope"], r["regression"], r["regression_upper"], r["regression_lower"]) == pytest.approx((r["s"], r["v"], r["v"] + 2 * r["r"], r["v"] - 2 * r["r"]), abs=1e-9)
    assert len(rows) == 41

"""Candles: validation, resampling, derived values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.functions.scalars import ratio, series
from wickwork.schema import SERIES


def validate(candles: DataFrame) -> DataFrame:
    """``candles`` with invalid_reason: the first rule a candle breaks, null for a valid one."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    reason = (
        F.when(h < lo, "high_below_low").when((o < lo) | (o > h), "open_outside_range").when((c < lo) | (c > h), "close_outside_range")
        .when(v < 0, "negative_volume").when((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0), "non_positive_price")
    )
    return candles.withColumn("invalid_reason", reason)


def resample(candles: DataFrame, unit: str = "week", timeframe: str = "Weekly") -> DataFrame:
    """Candles of a longer timeframe: first open, extremes, last close, summed volume."""
    g = candles.withColumn("w", F.date_trunc(unit, "ts").cast("date")).groupBy("symbol_id", "w")
    return g.agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.max_by("adj_close", "ts").alias("adj_close"), F.sum("volume").alias("volume"),
    ).select("symbol_id", F.lit(timeframe).alias("timeframe"), F.col("w").alias("ts"), "open", "high", "low", "close", "adj_close", "volume")


def true_range():
    pc = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def derived_values(candles: DataFrame) -> DataFrame:
    """Typical and median price, true range, log return, gap, body, wicks and shares of every candle."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    pc, rng = F.lag("close").over(series()), h - lo
    return candles.select(
        *SERIES, "ts", ((h + lo + c) / 3).alias("typical"), ((h + lo) / 2).alias("median"), true_range().alias("true_range"),
        F.when(pc > 0, F.log(c / pc)).alias("log_return"), F.coalesce(o - pc, F.lit(0.0)).alias("gap"), F.abs(c - o).alias("body"),
        (h - F.greatest(o, c)).alias("upper_wick"), (F.least(o, c) - lo).alias("lower_wick"), ratio(F.abs(c - o) * 100, rng, 0).alias("body_pct"), ratio(rng * 100, o, 0).alias("range_pct"),
    )

"""Candle psychology: shares of body and wicks, and one- to three-candle patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.config import PatternOptions
from wickwork.functions.scalars import ratio, series
from wickwork.schema import SERIES

BULLISH_SET = ("EngulfingBullish", "MorningStar", "ThreeWhiteSoldiers")
BEARISH_SET = ("EngulfingBearish", "EveningStar", "ThreeBlackCrows")


def metrics(frame: DataFrame, atr: str = "atr_14", volume_sma: str = "volume_sma") -> DataFrame:
    """``frame`` with body and wick shares, range over ATR, volume over its mean, and the close's place in the range."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - lo
    return frame.withColumns(
        {
            "body_pct": ratio(F.abs(c - o) * 100, rng, 0), "upper_wick_pct": ratio((h - F.greatest(o, c)) * 100, rng, 0), "lower_wick_pct": ratio((F.least(o, c) - lo) * 100, rng, 0),
            "range_to_atr": F.when(F.col(atr) > 0, rng / F.col(atr)), "relative_volume": F.when(F.col(volume_sma) > 0, F.col("volume") / F.col(volume_sma)), "close_location": ratio(c - lo, rng, 0.5),
        }
    )


def patterns(candles: DataFrame, options: PatternOptions | None = None) -> DataFrame:
    """``candles`` with ``patterns``: the names of all patterns that end at each candle."""
    p, w = options or PatternOptions(), series()
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - lo
    bars = candles.withColumns({"_b": ratio(F.abs(c - o) * 100, rng, 0), "_u": ratio((h - F.greatest(o, c)) * 100, rng, 0), "_l": ratio((F.least(o, c) - lo) * 100, rng, 0)})
    past = {f"_{x}{k}": F.lag(col, k).over(w) for k in (1, 2) for x, col in (("o", "open"), ("h", "high"), ("lo", "low"), ("c", "close"), ("b", "_b"), ("u", "_u"), ("l", "_l"))}
    bars = bars.withColumns(past)
    g = lambda name: F.col("_" + name)
    up0, down0, up1, down1, up2, down2 = c > o, c < o, g("c1") > g("o1"), g("c1") < g("o1"), g("c2") > g("o2"), g("c2") < g("o2")
    top, low, top1, low1 = F.greatest(o, c), F.least(o, c), F.greatest("_o1", "_c1"), F.least("_o1", "_c1")
    mid2 = (g("o2") + g("c2")) / 2
    solid = (g("b") > p.soldier_min_body) & (g("b1") > p.soldier_min_body) & (g("b2") > p.soldier_min_body)
    opposite = (up0 & down1) | (down0 & up1)
    found: dict[str, Column] = {
        "Doji": g("b") < p.doji_max_body,
        "Marubozu": g("b") > p.marubozu_min_body,
        "PinBar": (rng != 0) & (g("b") < p.pin_max_body) & (((g("u") > p.pin_min_wick) & (g("l") < p.pin_max_other_wick)) | ((g("l") > p.pin_min_wick) & (g("u") < p.pin_max_other_wick))),
        "EngulfingBullish": down1 & up0 & (low <= low1) & (top >= top1),
        "EngulfingBearish": up1 & down0 & (low <= low1) & (top >= top1),
        "Harami": opposite & (low >= low1) & (top <= top1),
        "InsideBar": (h <= g("h1")) & (lo >= g("lo1")),
        "OutsideBar": (h >= g("h1")) & (lo <= g("lo1")),
        "MorningStar": down2 & (g("b2") > 90 - p.star_small_body) & (top1 < g("c2")) & (g("b1") < p.star_small_body) & up0 & (c > mid2),
        "EveningStar": up2 & (g("b2") > 90 - p.star_small_body) & (low1 > g("c2")) & (g("b1") < p.star_small_body) & down0 & (c < mid2),
        "ThreeWhiteSoldiers": up2 & up1 & up0 & (g("c1") > g("c2")) & (c > g("c1")) & solid & (g("u") < p.pin_min_wick) & (g("u1") < p.pin_min_wick) & (g("u2") < p.pin_min_wick),
        "ThreeBlackCrows": down2 & down1 & down0 & (g("c1") < g("c2")) & (c < g("c1")) & solid & (g("l") < p.pin_min_wick) & (g("l1") < p.pin_min_wick) & (g("l2") < p.pin_min_wick),
    }
    names = F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in found.items()))
    return bars.withColumn("patterns", F.array_compact(names)).drop("_b", "_u", "_l", *past)


def pattern_rows(candles: DataFrame) -> DataFrame:
    return patterns(candles).select(*SERIES, "ts", F.explode("patterns").alias("pattern"))

"""Context of a series: data quality, circuit locks, timeframe alignment, market regime, relative strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.config import QualityOptions, TimeframeWeights
from wickwork.functions.scalars import last_n, ratio, series
from wickwork.operators.indicators import fold_indicators, prepared, window_indicators
from wickwork.operators.structure import with_breaks, with_swings
from wickwork.schema import SERIES


def quality_columns(bars: DataFrame, o: QualityOptions) -> DataFrame:
    """Adds traded_days and zero_run (longest run without volume) of the last ``window`` candles."""
    volumes = F.collect_list("volume").over(last_n(o.window))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))
    step = lambda a, v: F.struct(F.when(v == 0, a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["most"], F.when(v == 0, a["run"] + 1).otherwise(0)).alias("most"))
    # Most windows hold no candle without volume, and need no look at each of theirs.
    out = bars.withColumns({"traded_days": F.sum((F.col("volume") > 0).cast("int")).over(last_n(o.window)), "_zeros": F.max((F.col("volume") == 0).cast("int")).over(last_n(o.window)), "_volumes": volumes})
    return out.withColumn("zero_run", F.when(F.col("_zeros") == 1, F.aggregate("_volumes", start, step)["most"]).otherwise(0)).drop("_zeros", "_volumes")


def missing_days(candles: DataFrame, calendar: DataFrame) -> DataFrame:
    """series, day: days of ``calendar`` (day) inside a series' first and last candle that have none."""
    span = candles.groupBy(*SERIES).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    expected = span.select(*SERIES, F.explode(F.sequence("a", "b")).alias("day")).join(calendar.select("day").distinct(), "day").select(*SERIES, "day")
    return expected.join(candles.select(*SERIES, F.col("ts").alias("day")), [*SERIES, "day"], "left_anti")


def with_missing(bars: DataFrame, calendar: DataFrame | None, o: QualityOptions, candles: DataFrame | None = None) -> DataFrame:
    """Adds n_missing: days of ``calendar`` (day) within the last ``window`` candles, as of each, that have no candle.

    Days are counted by ordinals: what lies between two candles is the difference of their ordinals. The calendar and the
    days of candles are one short table of dates (a century has 36,525), numbered in one order and joined by the day.
    ``candles`` may name a table with the same candles that is cheaper to read for their days.
    """
    if calendar is None:
        return bars.withColumn("n_missing", F.lit(0).cast("bigint"))
    days = (bars if candles is None else candles).select(F.col("ts").cast("date").alias("_day"), F.lit(0).alias("_on")).distinct().unionByName(calendar.select(F.col("day").alias("_day"), F.lit(1).alias("_on")).distinct())
    days = days.groupBy("_day").agg(F.max("_on").alias("_on"))
    days = days.withColumn("_ordinal", F.sum("_on").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)))
    w = last_n(o.window)
    rows = bars.withColumn("_day", F.col("ts").cast("date")).join(F.broadcast(days), "_day")  # a table of dates
    expected = F.col("_ordinal") - F.first("_ordinal").over(w) + F.first("_on").over(w)
    return rows.withColumn("n_missing", expected - F.sum("_on").over(w)).drop("_day", "_on", "_ordinal")


def quality_gate(candles: DataFrame, calendar: DataFrame | None = None, options: QualityOptions | None = None) -> DataFrame:
    """One row a series: passed, reasons, traded_days, zero_run and missing days of its last ``window`` candles."""
    o = options or QualityOptions()
    w = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
    bars = quality_columns(candles, o).withColumn("_k", F.row_number().over(w))
    last = bars.filter("_k = 1").select(*SERIES, "ts", "traded_days", "zero_run")
    recent = bars.filter(F.col("_k") <= o.window).select(*SERIES, "ts")
    if calendar is None:
        last = last.withColumns({"n_missing": F.lit(0).cast("bigint"), "_days": F.lit(None).cast("array<date>")})
    else:
        gone = missing_days(recent, calendar).groupBy(*SERIES).agg(F.count("*").alias("n_missing"), F.slice(F.sort_array(F.collect_list("day")), 1, 5).alias("_days"))
        last = last.join(gone, SERIES, "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("traded_days") < o.min_traded_days, F.concat(F.lit("Only "), F.col("traded_days").cast("string"), F.lit(" traded days"))),
            F.when(F.col("zero_run") > o.max_zero_run, F.concat(F.lit("Run of "), F.col("zero_run").cast("string"), F.lit(" days without volume"))),
            F.when(F.col("n_missing") > 0, F.concat(F.lit("Missing days: "), F.array_join(F.transform("_days", lambda d: d.cast("string")), ", "))),
        )
    )
    return last.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0).drop("_days")


def circuit_state(band: Column | None = None, tolerance: float = 0.002, previous: Column | None = None) -> Column:
    """None, UpperLocked or LowerLocked of each candle; needs columns of one series, or the ``previous`` close."""
    pc, c = F.lag("close").over(series()) if previous is None else previous, F.col("close")
    locked = (F.col("high") == F.col("low")) & (F.col("low") == c)
    out = F.when(pc.isNull(), "None").when(locked, F.when(c > pc, "UpperLocked").otherwise("LowerLocked"))
    if band is not None:
        move = ratio(c - pc, pc)
        out = out.when((band > 0) & (move >= band - tolerance), "UpperLocked").when((band > 0) & (move <= -(band - tolerance)), "LowerLocked")
    return out.otherwise("None")


def best_bands(rows: DataFrame) -> DataFrame:
    """One band a symbol from (line_no, symbol, series, band): series EQ first, then the first line."""
    key = F.upper(F.trim("symbol"))
    pct = F.expr("try_cast(trim(band) as double)")
    usable = rows.filter((F.trim("symbol") != "") & pct.isNotNull()).select(key.alias("symbol"), (pct / 100).alias("band"), F.struct((F.upper(F.trim("series")) != "EQ").alias("other"), "line_no").alias("_k"))
    return usable.groupBy("symbol").agg(F.min_by("band", "_k").alias("band"))


def trend_of(candles: DataFrame) -> DataFrame:
    """The trend (1, -1, 0) at every candle of each series."""
    return with_breaks(with_swings(prepared(candles))).select(*SERIES, "ts", "trend")


def last_trend(candles: DataFrame) -> DataFrame:
    return trend_of(candles).groupBy(*SERIES).agg(F.max_by("trend", "ts").alias("trend"))


def mtf_alignment(trends: DataFrame, proposed: DataFrame, weights: TimeframeWeights | None = None) -> DataFrame:
    """symbol_id, alignment: the weight of timeframes whose trend is ``proposed``'s, of those available, in percent."""
    table = trends.sparkSession.createDataFrame(list((weights or TimeframeWeights()).items()), "timeframe string, weight double")
    rows = trends.join(F.broadcast(table), "timeframe").join(proposed.select("symbol_id", "direction"), "symbol_id")  # five weights
    g = rows.groupBy("symbol_id").agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("trend") == F.col("direction"), F.col("weight")).otherwise(0.0)).alias("a"), F.count("*").alias("timeframes"))
    return g.select("symbol_id", "timeframes", ratio(F.col("a") * 100, F.col("w"), 0).alias("alignment"))


def market_states(index: DataFrame) -> DataFrame:
    """ts, regime of an index at each of its candles: Neutral, Bull, Bear, StrongBull or StrongBear."""
    bars = fold_indicators(prepared(index).withColumn("sma", F.avg("close").over(last_n(20))), ("atr_14",))
    bars = with_breaks(with_swings(bars))
    far = F.abs(F.col("close") - F.col("sma")) / F.when(F.col("atr_14") > 0, F.col("atr_14"))
    name = F.concat(F.when(far >= 1, "Strong").otherwise(""), F.when(F.col("trend") == 1, "Bull").otherwise("Bear"))
    return bars.select("ts", F.when((F.col("trend") == 0) | far.isNull(), "Neutral").otherwise(name).alias("regime"))


def suppressed(direction: Column, regime: Column) -> Column:
    """Long proposals are suppressed in a bearish market; shorts never are."""
    return (direction == 1) & F.coalesce(regime.isin("Bear", "StrongBear"), F.lit(False))


def simple_return(k: int) -> Column:
    start = F.lag("adj_close", k).over(series())
    return F.when(start > 0, F.col("adj_close") / start - 1)


def relative_strength(candles: DataFrame, index: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    """series, ts, rs_short, rs_long: returns over those of the index the same number of candles back."""
    return with_strength(candles, index, short, long).select(*SERIES, "ts", "rs_short", "rs_long")


def with_strength(candles: DataFrame, index: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    """``candles`` with rs_short and rs_long."""
    own = candles.withColumns({"_s": simple_return(short), "_l": simple_return(long)})
    bench = index.select("timeframe", "ts", simple_return(short).alias("_bs"), simple_return(long).alias("_bl"))
    rows = own.join(F.broadcast(bench), ["timeframe", "ts"], "left")  # a table of dates
    return rows.withColumns({"rs_short": F.when(F.col("_bs") != 0, F.col("_s") / F.col("_bs")), "rs_long": F.when(F.col("_bl") != 0, F.col("_l") / F.col("_bl"))}).drop("_s", "_l", "_bs", "_bl")


__all__ = ["best_bands", "circuit_state", "last_trend", "market_states", "missing_days", "mtf_alignment", "quality_gate", "relative_strength", "suppressed", "window_indicators"]

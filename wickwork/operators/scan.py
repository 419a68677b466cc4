"""The two-stage universe scan, and its ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.config import EngineOptions
from wickwork.functions.scalars import is_confirmation_only
from wickwork.functions.staging import staged
from wickwork.operators.context import last_trend, mtf_alignment
from wickwork.operators.decision import LAYERS, candle_frame, decide, frame_zones, last_states, reasoning
from wickwork.operators.ends import long_series_of, series_ends
from wickwork.operators.risk import plan_inputs, trade_plan
from wickwork.operators.structure import legs
from wickwork.schema import SERIES

PLAN = ("entry", "stop_loss", "target1", "target2", "target3", "risk_percent", "risk_reward", "duration_days")


def stage1(
    daily: DataFrame, index: DataFrame, options: EngineOptions | None = None, members: DataFrame | None = None, bands: DataFrame | None = None, calendar: DataFrame | None = None,
) -> DataFrame:
    """One row a symbol: decision at its last candle, and a plan where it is Buy or StrongBuy.

    ``members`` (symbol_id) are the symbols to scan, all without them; ``bands`` (symbol_id, band) their circuit bands;
    ``calendar`` (day) the market's days. A symbol that fails the quality gate is excluded, with the gate's name as the
    reason.
    """
    o = options or EngineOptions()
    if members is not None:
        daily = daily.join(members.select("symbol_id").distinct(), "symbol_id", "left_semi")
    decided, live, turns = _decided(daily, index, o, bands, calendar)
    planned = trade_plan(plan_inputs(decided.filter(F.col("outcome").isin("Buy", "StrongBuy")), live, turns, o.risk), o.risk)
    plan = planned.select(*SERIES, *PLAN)
    out = decided.join(plan, SERIES, "left")
    # A series that failed is excluded with its message, and leaves the others alone.
    failed = F.col("error").isNotNull()
    excluded = failed | F.coalesce(F.col("hard_gate_failed") == "DataQuality", F.lit(False))
    sound = [F.when(~failed, F.col(c)).alias(c) for c in ("direction", "regime", "hard_gate_failed", "outcome", "confidence", *(f"score_{k}" for k in LAYERS), *PLAN)]
    reason = F.when(failed, F.concat(F.lit("Failed: "), "error")).otherwise(F.col("reasoning"))
    return out.select("symbol_id", "ts", *sound, excluded.alias("excluded"), reason.alias("reasoning"))


def _decided(daily: DataFrame, index: DataFrame, o: EngineOptions, bands: DataFrame | None, calendar: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the decision at each series' last candle, the zones that live there, the series' legs).

    Series that a task can hold take two ordered passes; longer ones the frame of all candles, by scans of blocks.
    """
    long = long_series_of(daily)
    some = not long.isEmpty()
    state, zones, turns = series_ends(daily.join(long, SERIES, "left_anti") if some else daily, index, o, calendar, bands)
    turns = legs(turns)
    if some:
        frame = candle_frame(daily.join(long, SERIES, "left_semi"), index, o, bands=bands, calendar=calendar)
        mitigated = frame_zones(frame)
        state = state.unionByName(last_states(frame, mitigated, o).select(*state.columns))
        zones = zones.unionByName(mitigated.select(*zones.columns))
        turns = turns.unionByName(legs(frame))
    # Written once: a filter by outcome would else be worked out below the joins, on every candle, wherever rows are read.
    return staged(reasoning(decide(state, o)), "decided"), zones.filter(F.col("full_rn").isNull()), turns


def shortlist(scanned: DataFrame, options: EngineOptions | None = None) -> DataFrame:
    """The symbols of highest confidence that are not excluded; ties go to the smaller id."""
    n = (options or EngineOptions()).scan.shortlist
    return scanned.filter(~F.col("excluded")).orderBy(F.desc("confidence"), "symbol_id").limit(n)


def stage2(listed: DataFrame, daily: DataFrame, weekly: DataFrame, intraday: DataFrame | None = None, options: EngineOptions | None = None) -> DataFrame:
    """``listed`` with the alignment of the timeframes that each symbol has, their number and the stage that it reached.

    Only the shortlist's longer and shorter candles are read. Weights are those of a symbol's own timeframes, so one that
    lacks some is judged by the rest; a symbol without any intraday candles keeps its Stage 1 row, as Stage1Only.
    """
    o = options or EngineOptions()
    ids = listed.select("symbol_id")
    trends = last_trend(daily.join(ids, "symbol_id", "left_semi")).unionByName(last_trend(weekly.join(ids, "symbol_id", "left_semi")))
    if intraday is not None:
        trends = trends.unionByName(last_trend(intraday.join(ids, "symbol_id", "left_semi")))
    trends = staged(trends, "trends")
    aligned = mtf_alignment(trends, listed.select("symbol_id", "direction"), o.weights)
    reached = trends.groupBy("symbol_id").agg(F.max(is_confirmation_only(F.col("timeframe"))).alias("_intraday"))
    out = listed.join(aligned.select("symbol_id", "alignment", "timeframes"), "symbol_id", "left").join(reached, "symbol_id", "left")
    stage = F.when(F.col("_intraday"), "Stage2").otherwise("Stage1Only")
    return out.withColumns({"alignment": F.coalesce("alignment", F.lit(0.0)), "timeframes": F.coalesce("timeframes", F.lit(0)), "stage": stage}).drop("_intraday")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` of a shortlist with rank: confidence, momentum, trend, reward, expected return, strength; then the id."""
    gain = F.abs(F.col("target1") - F.col("entry")) / F.col("entry")
    w = Window.orderBy(F.desc("confidence"), F.desc("score_momentum"), F.desc("score_trend"), F.desc(F.coalesce("risk_reward", F.lit(0.0))), F.desc(F.coalesce(gain, F.lit(0.0))), F.desc("score_strength"), "symbol_id")
    return rows.withColumn("rank", F.row_number().over(w))


def counts(scanned: DataFrame, listed: DataFrame) -> DataFrame:
    """Symbols scanned, excluded and shortlisted."""
    marked = scanned.select("symbol_id", "excluded").join(listed.select("symbol_id", F.lit(1).alias("_in")), "symbol_id", "left")
    return marked.agg(F.count("*").alias("scanned"), F.count_if("excluded").alias("excluded"), F.count("_in").alias("shortlisted"))

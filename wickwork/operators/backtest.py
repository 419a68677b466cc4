"""Walk-forward backtest: every candle is decided once, as-of rows are picked, and later candles give the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.config import EngineOptions
from wickwork.functions.scalars import series
from wickwork.operators.risk import plan_inputs, trade_plan
from wickwork.operators.walks import CHOSEN, walked
from wickwork.schema import SERIES

__all__ = ["CHOSEN", "as_of_rows", "buckets", "marked_as_of", "simulate", "trades"]


def marked_as_of(rows: DataFrame, options: EngineOptions | None = None, start=None, end=None) -> DataFrame:
    """Adds _asked: every ``cadence``-th candle of each series in the window that has ``min_bars`` behind it."""
    o, ts = (options or EngineOptions()).backtest, F.col("ts")
    k, inside = F.col("rn"), F.lit(True)
    if start is not None:  # without a start the candle's own number counts
        inside = ts >= F.lit(start)
        k = k - F.min(F.when(inside, F.col("rn"))).over(Window.partitionBy(*SERIES)) + 1
    if end is not None:
        inside = inside & (ts <= F.lit(end))
    return rows.withColumn("_asked", F.coalesce(inside & ((k - 1) % o.cadence == 0) & (F.col("rn") >= o.min_bars), F.lit(False)))


def as_of_rows(state: DataFrame, options: EngineOptions | None = None, start=None, end=None) -> DataFrame:
    """The rows that ``marked_as_of`` asks for."""
    return marked_as_of(state, options, start, end).filter("_asked").drop("_asked")


def simulate(plans: DataFrame, candles: DataFrame, default_horizon: int = 40) -> DataFrame:
    """``plans`` (series, ts, rn, direction, plan) with result, exit_price, exit_ts, holding_days, r_multiple.

    Each later candle inside the horizon is tested for the stop first, then the third, second and first target. Plans are
    dealt to the numbers of those candles, so the join is on equality and grows with plans times horizon.
    """
    horizon = F.when(F.col("duration_days").isNotNull(), F.greatest(F.lit(1), F.ceil(F.col("duration_days") * 5 / 7).cast("int"))).otherwise(default_horizon)
    p = plans.withColumn("_h", horizon)
    bars = candles.select(*SERIES, F.col("rn").alias("b_rn"), F.col("ts").alias("b_ts"), F.col("high").alias("b_high"), F.col("low").alias("b_low"), F.col("close").alias("b_close"))
    up = F.col("direction") == 1
    hit = lambda level: F.when(up, F.col("b_high") >= F.col(level)).otherwise(F.col("b_low") <= F.col(level))
    stopped = F.when(up, F.col("b_low") <= F.col("stop_loss")).otherwise(F.col("b_high") >= F.col("stop_loss"))
    kind = F.when(stopped, "HitStop").when(hit("target3"), "HitTarget3").when(hit("target2"), "HitTarget2").when(hit("target1"), "HitTarget1")
    price = F.when(kind == "HitStop", F.col("stop_loss")).when(kind == "HitTarget3", F.col("target3")).when(kind == "HitTarget2", F.col("target2")).when(kind == "HitTarget1", F.col("target1"))
    keys = [*SERIES, "ts"]
    ahead = p.select(*keys, "rn", "_h", "direction", "stop_loss", "target1", "target2", "target3").withColumn("b_rn", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + F.col("_h")))).join(bars, [*SERIES, "b_rn"])
    ahead = ahead.withColumns({"_kind": kind, "_price": price})
    end = F.struct(F.lit("TimedOut").alias("k"), F.col("b_close").alias("p"), F.col("b_ts").alias("t"), F.col("b_rn").alias("r"))
    exit_ = F.when(F.col("_kind").isNotNull(), F.struct(F.col("_kind").alias("k"), F.col("_price").alias("p"), F.col("b_ts").alias("t"), F.col("b_rn").alias("r")))
    found = ahead.groupBy(*keys).agg(F.min_by(exit_, F.when(F.col("_kind").isNotNull(), F.col("b_rn"))).alias("_x"), F.max_by(end, "b_rn").alias("_e"))
    out = p.join(found, keys, "left").withColumn("_o", F.when(F.col("entry") != F.col("stop_loss"), F.coalesce("_x", "_e")))
    move = F.when(up, F.col("_o.p") - F.col("entry")).otherwise(F.col("entry") - F.col("_o.p"))
    risk = F.abs(F.col("entry") - F.col("stop_loss"))
    return out.withColumns(
        {
            "result": F.coalesce("_o.k", F.lit("InsufficientForwardData")), "exit_price": F.coalesce("_o.p", "entry"), "exit_ts": F.col("_o.t"),
            "holding_days": F.coalesce(F.col("_o.r") - F.col("rn"), F.lit(0)), "r_multiple": F.coalesce(move / F.when(risk != 0, risk), F.lit(0.0)),
        }
    ).drop("_h", "_x", "_e", "_o")


def trades(daily: DataFrame, index: DataFrame, options: EngineOptions | None = None, start=None, end=None, calendar: DataFrame | None = None) -> DataFrame:
    """One row a Buy or StrongBuy decision of the walk: decision, plan and simulated outcome."""
    o = options or EngineOptions()
    chosen, zones, turns = walked(daily, index, lambda rows: marked_as_of(rows, o, start, end), o, calendar)
    planned = trade_plan(plan_inputs(chosen, zones, turns, o.risk), o.risk).filter(F.col("plan_error").isNull())
    numbered = daily.select(*SERIES, F.row_number().over(series()).alias("rn"), "ts", "high", "low", "close")
    out = simulate(planned, numbered, o.backtest.default_horizon)
    return out.select("symbol_id", "ts", "outcome", "confidence", "direction", "entry", "stop_loss", "target1", "target2", "target3", "risk_reward", "result", "exit_price", "exit_ts", "holding_days", "r_multiple")


def buckets(trade_rows: DataFrame) -> DataFrame:
    """Statistics of StrongBuy and Buy; both are always there."""
    done = trade_rows.filter(F.col("result") != "InsufficientForwardData")
    r, timed = F.col("r_multiple"), F.col("result") == "TimedOut"
    g = done.groupBy("outcome").agg(F.count("*").alias("simulated"), F.count_if(r > 0).alias("wins"), F.count_if((r <= 0) & ~timed).alias("losses"), F.count_if(timed).alias("timed_out"), F.avg(r).alias("avg_r"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r <= 0, r)).alias("avg_loss"))
    n = trade_rows.groupBy("outcome").agg(F.count("*").alias("signals"))
    both = trade_rows.sparkSession.createDataFrame([("StrongBuy",), ("Buy",)], "outcome string")
    out = both.join(n, "outcome", "left").join(g, "outcome", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select("outcome", *(zero(c).cast("bigint").alias(c) for c in ("signals", "simulated", "wins", "losses", "timed_out")), *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("avg_r", "avg_win", "avg_loss")))
    rate = F.when(F.col("simulated") > 0, F.col("wins") / F.col("simulated")).otherwise(0.0)
    return out.withColumn("win_rate", rate).withColumn("expected_r", F.col("win_rate") * F.col("avg_win") + (1 - F.col("win_rate")) * F.col("avg_loss"))

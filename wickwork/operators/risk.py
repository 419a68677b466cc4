"""Trade plans and portfolio limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.config import RiskOptions
from wickwork.operators.intervals import next_above
from wickwork.schema import SERIES


def plan_inputs(decided: DataFrame, mitigated: DataFrame, leg_rows: DataFrame, options: RiskOptions | None = None) -> DataFrame:
    """``decided`` rows with next_zone (nearest live opposing zone beyond the close) and the mean duration of impulse legs."""
    o = options or RiskOptions()
    z = mitigated.filter(~F.col("kind").startswith("Fvg"))
    above = F.col("kind").isin("SupplyZone", "OrderBlockBearish")
    below = F.col("kind").isin("DemandZone", "OrderBlockBullish")
    # Below the close of a short position is above, with the prices' signs turned.
    z = z.filter(above | below).select(*SERIES, F.when(above, 1).otherwise(-1).alias("side"), F.col("created_rn").alias("from_rn"), F.col("full_rn").alias("to_rn"), F.when(above, F.col("lower")).otherwise(-F.col("upper")).alias("price"))
    side = F.when(F.col("direction") == 1, 1).when(F.col("direction") == -1, -1)
    points = decided.select(*SERIES, "rn", side.alias("side"), (side * F.col("close")).alias("price")).filter(F.col("side").isNotNull() & F.col("price").isNotNull())
    near = next_above(points, z).select(*SERIES, "rn", (F.col("side") * F.col("found")).alias("next_zone"))
    # Legs and decisions in one order of days: the frame takes the legs that ended in the last months, the day included.
    impulse = leg_rows.filter(F.col("kind") == "Impulse").select(*SERIES, F.col("end_ts").alias("day"), F.datediff("end_ts", "start_ts").alias("_days"), F.lit(None).cast("int").alias("rn"))
    rows = impulse.unionByName(decided.select(*SERIES, F.col("ts").alias("day"), F.lit(None).cast("int").alias("_days"), F.col("rn").cast("int").alias("rn")))
    names = ", ".join(SERIES)
    frame = f"over (partition by {names} order by day range between interval '{o.leg_months}' month preceding and current row)"
    spans = rows.withColumns({"_mean": F.expr(f"avg(_days) {frame}"), "_legs": F.expr(f"count(_days) {frame}")}).filter("rn is not null")
    out = decided.join(near, [*SERIES, "rn"], "left").join(spans.select(*SERIES, "rn", "_mean", "_legs"), [*SERIES, "rn"], "left")
    return out.withColumn("duration_days", F.when(F.col("_legs") >= o.min_legs_for_duration, F.col("_mean"))).drop("_mean", "_legs")


def trade_plan(rows: DataFrame, options: RiskOptions | None = None) -> DataFrame:
    """``rows`` (close, direction, atr_14, low_swing, high_swing, next_zone, duration_days) with the plan's columns.

    A plan whose stop equals its entry is null, with plan_error.
    """
    o = options or RiskOptions()
    entry, up, zone = F.col("close"), F.col("direction") == 1, F.col("next_zone")
    sign = F.when(up, 1.0).otherwise(-1.0)
    floor = entry - sign * o.stop_atr_multiple * F.coalesce("atr_14", F.lit(0.0))
    stop = F.when(up, F.least(floor, "low_swing")).otherwise(F.greatest(floor, "high_swing"))
    out = rows.withColumns({"entry": entry, "stop_loss": stop}).withColumn("_risk", F.abs(F.col("entry") - F.col("stop_loss")))
    out = out.withColumn("plan_error", F.when(F.col("_risk") <= 0, "ZeroRisk"))
    sane = F.col("_risk") > 0

    def target(k: int):
        plain = entry + sign * k * F.col("_risk")
        nearer = (F.abs(zone - entry) < k * F.col("_risk")) & (sign * (zone - entry) > 0)
        return F.when(sane, F.when(F.coalesce(nearer, F.lit(False)), zone).otherwise(plain))

    out = out.withColumns({f"target{k}": target(k) for k in (1, 2, 3)})
    return out.withColumns(
        {
            "risk_percent": F.when(sane, F.col("_risk") / entry),
            "risk_reward": F.when(sane, F.abs(F.col("target1") - entry) / F.when(sane, F.col("_risk"))),
            "invalidation": F.when(F.when(up, F.col("low_swing")).otherwise(F.col("high_swing")).isNotNull(), F.concat(F.lit("Structure break beyond "), F.when(up, F.col("low_swing")).otherwise(F.col("high_swing")).cast("string"))).otherwise("No confirmed structural invalidation level available"),
            "duration_flag": F.when(F.col("duration_days").isNull(), "InsufficientHistoryForDurationEstimate"),
        }
    ).drop("_risk")


def portfolio_limits(candidates: DataFrame, positions: DataFrame, options: RiskOptions | None = None) -> DataFrame:
    """symbol_id, breaches of each candidate (symbol_id, sector, capital, returns) against open ``positions`` alike.

    Positions are a book held by one trader, so a candidate meets all of them. Returns align by place; series of
    different lengths, of under two values or without variance have no correlation.
    """
    o = options or RiskOptions()
    p = positions.select(F.col("symbol_id").alias("p_id"), F.col("sector").alias("p_sector"), F.col("capital").alias("p_capital"), F.col("returns").alias("p_returns"))
    totals = p.agg(F.count("*").alias("open"), F.coalesce(F.sum("p_capital"), F.lit(0.0)).alias("total"))
    sectors = p.groupBy(F.col("p_sector").alias("sector")).agg(F.sum("p_capital").alias("in_sector"))
    c = candidates.select("symbol_id", "sector", "capital", "returns")
    moved = c.select("symbol_id", F.size("returns").alias("n"), F.posexplode("returns").alias("at", "x"))
    held = p.select("p_id", F.size("p_returns").alias("n"), F.posexplode("p_returns").alias("at", "y"))
    m = moved.join(held, ["n", "at"]).groupBy("symbol_id", "p_id").agg(F.count("*").alias("k"), F.corr("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    alike = m.filter((F.col("k") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0) & (F.col("r") > o.correlation)).groupBy("symbol_id").agg(F.count("*").alias("alike"))
    rows = c.join(F.broadcast(totals), F.lit(True)).join(sectors, "sector", "left").join(alike, "symbol_id", "left")  # totals: one row
    share = (F.coalesce("in_sector", F.lit(0.0)) + F.col("capital")) / F.when(F.col("total") + F.col("capital") != 0, F.col("total") + F.col("capital")) * 100
    breaches = F.array_compact(F.array(F.when(F.col("open") + 1 > o.max_positions, "MaxPositions"), F.when(share > o.max_sector_percent, "SectorConcentration"), F.when(F.coalesce("alike", F.lit(0)) + 1 > o.max_correlated, "CorrelatedExposure")))
    return rows.select("symbol_id", share.alias("sector_percent"), F.coalesce("alike", F.lit(0)).alias("correlated"), breaches.alias("breaches"))

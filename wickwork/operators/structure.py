"""Market structure: swings, breaks, ranges, legs, zones and events, as windows over one ordered series.

``structure_frame`` gives one row a candle with everything known at its close; the row operators select from it.
Zones live as rows of their own; what becomes of them is a search over the later candles of their series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.config import StructureOptions
from wickwork.functions.scalars import before, ratio, series, so_far
from wickwork.operators.indicators import fold_indicators, prepared, window_indicators
from wickwork.operators.intervals import overlapping
from wickwork.schema import SERIES


def _last(value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window)


def with_swings(bars: DataFrame) -> DataFrame:
    """Adds the swing confirmed at each candle (its centre two candles back) and the last swing of each type."""
    w = series()
    # Each earlier value is one column, however often it is read.
    past = {f"_{x}{k}": F.lag(x, k).over(w) for x in ("high", "low") for k in (1, 2, 3, 4)} | {"_ts2": F.lag("ts", 2).over(w)}
    at = lambda col, k: F.col(f"_{col}{k}" if k else col)
    high = (at("high", 2) > at("high", 4)) & (at("high", 2) > at("high", 3)) & (at("high", 2) > at("high", 1)) & (at("high", 2) > F.col("high"))
    low = (at("low", 2) < at("low", 4)) & (at("low", 2) < at("low", 3)) & (at("low", 2) < at("low", 1)) & (at("low", 2) < F.col("low"))
    out = bars.withColumns(past).withColumn("swing", F.when(high & ~low, "High").when(low & ~high, "Low"))
    out = out.withColumns({"swing_price": F.when(F.col("swing") == "High", at("high", 2)).when(F.col("swing") == "Low", at("low", 2)), "swing_ts": F.when(F.col("swing").isNotNull(), at("ts", 2))}).drop(*past)
    is_high, is_low = F.col("swing") == "High", F.col("swing") == "Low"
    out = out.withColumns(
        {
            "high_swing": _last(F.when(is_high, F.col("swing_price")), so_far()), "high_id": _last(F.when(is_high, F.col("rn")), so_far()),
            "low_swing": _last(F.when(is_low, F.col("swing_price")), so_far()), "low_id": _last(F.when(is_low, F.col("rn")), so_far()),
            "_ph": _last(F.when(is_high, F.col("swing_price")), before()), "_pl": _last(F.when(is_low, F.col("swing_price")), before()),
        }
    )
    # A first swing of its type has nothing to be compared with.
    return out.withColumn("is_higher_or_lower", F.when(is_high, F.coalesce(F.col("swing_price") > F.col("_ph"), F.lit(False))).when(is_low, F.coalesce(F.col("swing_price") < F.col("_pl"), F.lit(False)))).drop("_ph", "_pl")


def with_breaks(bars: DataFrame) -> DataFrame:
    """Adds break_dir (1, -1), break_kind, broken_price, the trend after each candle, and candles since the last BOS."""

    def first_of(cond: str, key: str) -> Column:
        """The first candle with ``cond`` since candle ``key``: the one before it, if any, is older."""
        return F.col(cond) & (F.coalesce(_last(F.when(F.col(cond), F.col("rn")), before()), F.lit(0)) < F.col(key))

    out = bars.withColumn("_up", F.coalesce(F.col("close") > F.col("high_swing"), F.lit(False)))
    out = out.withColumn("_bull", first_of("_up", "high_id"))
    out = out.withColumn("_down", F.coalesce(F.col("close") < F.col("low_swing"), F.lit(False)) & ~F.col("_bull"))
    out = out.withColumn("_bear", first_of("_down", "low_id"))
    out = out.withColumn("break_dir", F.when(F.col("_bull"), 1).when(F.col("_bear"), -1))
    out = out.withColumns({"_prev": _last(F.col("break_dir"), before()), "trend": F.coalesce(_last(F.col("break_dir"), so_far()), F.lit(0)), "broken_price": F.when(F.col("_bull"), F.col("high_swing")).when(F.col("_bear"), F.col("low_swing"))})
    out = out.withColumn("break_kind", F.when(F.col("break_dir").isNull(), None).when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("break_dir")), "CHoCH").otherwise("BOS"))
    bos = F.when(F.col("break_kind") == "BOS", F.col("rn"))
    out = out.withColumn("since_bos", F.col("rn") - F.coalesce(_last(bos, so_far()), F.lit(0)))
    return out.drop("_up", "_bull", "_down", "_bear", "_prev")


def with_range(bars: DataFrame, o: StructureOptions) -> DataFrame:
    """Adds the run of candles inside the last swings' band since the last break, and whether that is a range."""
    inside = F.col("break_dir").isNull() & F.coalesce((F.col("high") <= F.col("high_swing")) & (F.col("low") >= F.col("low_swing")), F.lit(False))
    out = bars.withColumn("_in", inside)
    out = out.withColumn("range_run", (F.col("rn") - F.coalesce(_last(F.when(~F.col("_in"), F.col("rn")), so_far()), F.lit(0))).cast("bigint")).drop("_in")
    out = out.withColumn("is_ranging", F.col("range_run") >= o.range_min_candles)
    return out.withColumn("was_ranging", F.coalesce(F.lag("is_ranging").over(series()), F.lit(False)))


def turns() -> dict[str, Column]:
    """Close and day of the last candle that confirmed a swing before each."""
    turn = F.col("swing").isNotNull()
    return {"_sc": _last(F.when(turn, F.col("close")), before()), "_st": _last(F.when(turn, F.col("ts")), before())}


def leg_columns(o: StructureOptions) -> dict[str, Column]:
    """Start and direction of the leg completed at each candle that confirms a swing, and whether it is an impulse."""
    done = F.col("swing").isNotNull() & F.col("_st").isNotNull()
    atr = F.col("atr_14") if o.mode == "as_specified" else F.lit(None).cast("double")
    strong = F.coalesce((atr > 0) & (F.abs(F.col("close") - F.col("_sc")) >= o.impulse_atr_multiple * atr), F.lit(False)) | (F.col("since_bos") <= o.impulse_bos_lookahead)
    return {"leg_start_ts": F.when(done, F.col("_st")), "leg_start": F.when(done, F.col("_sc")), "leg_dir": F.when(done, F.when(F.col("close") >= F.col("_sc"), 1).otherwise(-1)), "_impulse": F.when(done, strong.cast("int"))}


def with_legs(bars: DataFrame, o: StructureOptions) -> DataFrame:
    """Adds the leg completed at each candle that confirms a swing, and the run of like trend legs before it."""
    out = bars.withColumns(turns()).withColumns(leg_columns(o))
    # After an impulse, legs against it are corrections until one goes its way; that one and later ones are trend legs.
    impulse = F.col("_impulse") == 1
    out = out.withColumns({"_from": _last(F.when(impulse, F.col("rn")), so_far()), "_dir": _last(F.when(impulse, F.col("leg_dir")), so_far())})
    out = out.withColumn("_back", _last(F.when((F.col("_impulse") == 0) & (F.col("leg_dir") == F.col("_dir")), F.col("rn")), so_far()))
    against = F.coalesce(F.coalesce(F.col("_back"), F.lit(0)) < F.col("_from"), F.lit(False))
    out = out.withColumn("leg_kind", F.when(impulse, "Impulse").when(F.col("_impulse") == 0, F.when(against, "Correction").otherwise("Trend")))
    trend = F.col("leg_kind") == "Trend"
    out = out.withColumn("_pt", _last(F.when(trend, F.col("leg_dir")), before()))
    out = out.withColumn("_trends", F.sum(F.when(trend, 1).otherwise(0)).over(so_far()))
    # Trend legs before the last turn are not of the run.
    out = out.withColumn("_turn", _last(F.when(trend & (F.col("_pt").isNull() | (F.col("_pt") != F.col("leg_dir"))), F.col("_trends") - 1), so_far()))
    out = out.withColumn("_run", F.col("_trends") - F.coalesce(F.col("_turn"), F.lit(0)))
    out = out.withColumn("trend_leg_run", F.coalesce(F.lag("_run").over(series()), F.lit(0)))
    return out.drop("_sc", "_st", "_impulse", "_from", "_dir", "_back", "_pt", "_trends", "_turn", "_run")


def structure_frame(candles: DataFrame, options: StructureOptions | None = None, indicators: DataFrame | None = None) -> DataFrame:
    """One row a candle with swings, breaks, trend, range and legs; ``indicators`` may bring atr_14 and volume_sma along."""
    o = options or StructureOptions()
    bars = indicators if indicators is not None else window_indicators(fold_indicators(prepared(candles), ("atr_14",)), ["VolumeSMA_20"])
    return with_legs(with_range(with_breaks(with_swings(bars)), o), o)


def swings(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("swing").isNotNull()).select(*SERIES, F.col("swing_ts").alias("ts"), F.col("ts").alias("confirmed_ts"), "swing", F.col("swing_price").alias("price"), "is_higher_or_lower")


def breaks(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("break_dir").isNotNull()).select(*SERIES, "ts", F.col("break_kind").alias("kind"), F.col("break_dir").alias("direction"), "broken_price", "close")


def legs(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("leg_kind").isNotNull()).select(*SERIES, F.col("leg_start_ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.col("leg_start").alias("start_price"), F.col("close").alias("end_price"), F.col("leg_kind").alias("kind"), F.col("leg_dir").alias("direction"))


def fvg_of(h2: Column, l2: Column) -> Column:
    """The gap (kind, upper, lower) between a candle and the prices two before it, or null."""
    bullish = F.struct(F.lit("FvgBullish").alias("kind"), F.col("low").alias("upper"), h2.alias("lower"))
    return F.when(h2 < F.col("low"), bullish).when(l2 > F.col("high"), F.struct(F.lit("FvgBearish").alias("kind"), l2.alias("upper"), F.col("high").alias("lower")))


def fvg_zones(frame: DataFrame) -> DataFrame:
    z = frame.select(*SERIES, "ts", "rn", fvg_of(F.lag("high", 2).over(series()), F.lag("low", 2).over(series())).alias("z"))
    return z.filter(F.col("z").isNotNull()).select(*SERIES, "z.kind", F.col("ts").alias("formed_ts"), F.col("ts").alias("created_ts"), F.col("rn").alias("created_rn"), "z.upper", "z.lower")


def leg_zones_of() -> Column:
    """The zones (kind, upper, lower) of an impulse leg, from leg_dir and the prices p_<name> of the candle before its end."""
    up = F.col("leg_dir") == 1
    body = F.struct(F.when(up, "SupplyZone").otherwise("DemandZone").alias("kind"), F.greatest("p_open", "p_close").alias("upper"), F.least("p_open", "p_close").alias("lower"))
    block = F.when(F.when(up, F.col("p_close") < F.col("p_open")).otherwise(F.col("p_close") > F.col("p_open")), F.struct(F.when(up, "OrderBlockBullish").otherwise("OrderBlockBearish").alias("kind"), F.col("p_high").alias("upper"), F.col("p_low").alias("lower")))
    return F.array_compact(F.array(body, block))


def leg_zones(frame: DataFrame) -> DataFrame:
    """Supply or demand zones and order blocks of completed impulse legs, from the candle before the leg's end."""
    w = series()
    p = {x: F.lag(x).over(w) for x in ("open", "high", "low", "close")}
    rows = frame.select(*SERIES, "ts", "rn", "leg_kind", "leg_dir", "leg_start_ts", *(v.alias(f"p_{k}") for k, v in p.items()))
    rows = rows.filter((F.col("leg_kind") == "Impulse") & F.col("p_open").isNotNull())
    return rows.select(*SERIES, "leg_start_ts", "ts", "rn", F.explode(leg_zones_of()).alias("z")).select(*SERIES, "z.kind", F.col("leg_start_ts").alias("formed_ts"), F.col("ts").alias("created_ts"), F.col("rn").alias("created_rn"), "z.upper", "z.lower")


def zones(frame: DataFrame) -> DataFrame:
    return fvg_zones(frame).unionByName(leg_zones(frame))


def first_hits(high, low, start, under, over, block: int = 256):
    """For many zones of one series the first candle from ``start`` on with low <= under and high >= over, or -1: the next
    blocks of candles of all zones at once; beyond them zone by zone, without blocks whose extremes rule it out.
    """
    import numpy as np

    n, out = len(high), np.full(len(start), -1, "i8")
    edges: list = []

    def first(at: int, under: float, over: float) -> int:
        if not edges:
            cuts = np.arange(0, n, block)
            edges.extend((np.fmax.reduceat(high, cuts), np.fmin.reduceat(low, cuts)))
        k = at // block
        for j in (k + np.flatnonzero((edges[1][k:] <= under) & (edges[0][k:] >= over))).tolist():
            a = max(at, j * block)
            hit = np.flatnonzero((low[a : (j + 1) * block] <= under) & (high[a : (j + 1) * block] >= over))
            if len(hit):
                return a + int(hit[0])
        return -1

    for s in range(0, len(start), 2048):
        left = np.arange(s, min(s + 2048, len(start)))
        for ahead in range(0, 8 * block, block):
            left = left[start[left] + ahead < n]
            if not len(left):
                break
            at = start[left, None] + ahead + np.arange(block)
            inside, at = at < n, np.minimum(at, n - 1)
            hit = inside & (low[at] <= under[left, None]) & (high[at] >= over[left, None])
            found = hit.any(1)
            out[left[found]] = at[found, hit[found].argmax(1)]
            left = left[~found]
        else:
            for k in left.tolist():
                if start[k] + 8 * block < n:
                    out[k] = first(int(start[k]) + 8 * block, under[k], over[k])
    return out


def with_mitigation(zone_rows: DataFrame, frame: DataFrame) -> DataFrame:
    """Adds the first later candle that trades into each zone (partial_rn) and that covers it (full_rn).

    Blocks of candles whose extremes rule a zone out are passed over, so a zone costs a look at each block and at the
    candles of the blocks that may hold its hit.
    """
    import numpy as np
    import pyarrow as pa

    def run(z: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("rn")
        rn, high, low = (b.column(x).to_numpy() for x in ("rn", "high", "low"))  # a missing price is NaN and hits nothing

        def firsts(start, under, over) -> list:
            return [int(rn[k]) if k >= 0 else None for k in first_hits(high, low, start, under, over).tolist()]

        start = np.searchsorted(rn, z.column("created_rn").to_numpy(), "right")
        up, down = z.column("upper").to_numpy(), z.column("lower").to_numpy()
        full, partial = firsts(start, down, up), firsts(start, up, down)
        return z.append_column("partial_rn", pa.array(partial, pa.int32())).append_column("full_rn", pa.array(full, pa.int32()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in zone_rows.schema.fields)
    return zone_rows.groupBy(*SERIES).cogroup(frame.select(*SERIES, "rn", "high", "low").groupBy(*SERIES)).applyInArrow(run, f"{fields}, partial_rn int, full_rn int")


def zone_status(rn: Column | None = None) -> Column:
    """Fresh, PartiallyMitigated or FullyMitigated, as known at bar ``rn`` (the end without one)."""
    seen = (lambda c: F.col(c).isNotNull()) if rn is None else (lambda c: F.coalesce(F.col(c) <= rn, F.lit(False)))
    return F.when(seen("full_rn"), "FullyMitigated").when(seen("partial_rn"), "PartiallyMitigated").otherwise("Fresh")


def _event(kind: str, cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(kind))


def _rows(frame: DataFrame, *events: Column) -> DataFrame:
    return frame.select(*SERIES, "ts", F.explode(F.array_compact(F.array(*events))).alias("event"))


def liquidity_grabs(frame: DataFrame) -> DataFrame:
    h, lo, c, hs, ls = (F.col(x) for x in ("high", "low", "close", "high_swing", "low_swing"))
    return _rows(frame, _event("LiquidityGrabHigh", (h > hs) & (c <= hs)), _event("LiquidityGrabLow", (lo < ls) & (c >= ls)))


def traps(frame: DataFrame, options: StructureOptions | None = None) -> DataFrame:
    """BOS that close back through the broken swing in the look-ahead, which counts the BOS candle itself."""
    o, w = options or StructureOptions(), series()
    back = lambda close: F.when(F.col("break_dir") == 1, close < F.col("broken_price")).otherwise(close > F.col("broken_price"))
    hit = F.lit(None).cast("date")
    for k in range(o.trap_lookahead - 1, 0, -1):
        hit = F.when(F.coalesce(back(F.lead("close", k).over(w)), F.lit(False)), F.lead("ts", k).over(w)).otherwise(hit)
    rows = frame.withColumn("_hit", hit).filter((F.col("break_kind") == "BOS") & F.col("_hit").isNotNull())
    return rows.select(*SERIES, F.col("_hit").alias("ts"), F.when(F.col("break_dir") == 1, "BullTrap").otherwise("BearTrap").alias("event"))


def false_breakouts(frame: DataFrame, options: StructureOptions | None = None) -> DataFrame:
    o = options or StructureOptions()
    h, lo, c, hs, ls = (F.col(x) for x in ("high", "low", "close", "high_swing", "low_swing"))
    ranging = F.col("was_ranging" if o.mode == "as_specified" else "is_ranging")
    return _rows(frame, _event("FalseBreakout", ranging & (h > hs) & (c <= hs)), _event("FailedBreakdown", ranging & (lo < ls) & (c >= ls)))


def volume_absorption(frame: DataFrame, mitigated: DataFrame, options: StructureOptions | None = None) -> DataFrame:
    """Heavy volume in a small body at a live zone or at a swing price seen so far."""
    return absorbing(frame, mitigated, options).drop("rn")


def is_heavy(options: StructureOptions | None = None) -> Column:
    """Heavy volume in a small body."""
    o = options or StructureOptions()
    sma = F.col("volume_sma") if o.mode == "as_specified" else F.lit(None).cast("double")
    rng = F.col("high") - F.col("low")
    return (sma > 0) & (F.col("volume") >= o.absorption_multiple * sma) & (rng != 0) & (ratio(F.abs(F.col("close") - F.col("open")) * 100, rng, 0) < o.absorption_max_body)


def absorbing(frame: DataFrame, mitigated: DataFrame, options: StructureOptions | None = None, at: DataFrame | None = None) -> DataFrame:
    """The rows of ``volume_absorption`` with the candle's number; of the candles ``at`` alone, at most one a series."""
    heavy = (frame if at is None else at).filter(is_heavy(options)).select(*SERIES, "ts", "rn", "high", "low")
    z = mitigated.select(*SERIES, F.col("created_rn").alias("from_rn"), F.col("full_rn").alias("to_rn"), F.col("upper").alias("top"), F.col("lower").alias("bottom"))
    s = frame.filter(F.col("swing").isNotNull()).select(*SERIES, F.col("rn").alias("from_rn"), F.lit(None).cast("int").alias("to_rn"), F.col("swing_price").alias("top"), F.col("swing_price").alias("bottom"))
    z = z.unionByName(s)
    if at is not None:  # a candle a series: most zones are gone by then, and need not be dealt to nodes
        z = z.join(heavy.select(*SERIES, F.col("rn").alias("_at")), SERIES).filter((F.col("from_rn") <= F.col("_at")) & (F.col("to_rn").isNull() | (F.col("_at") < F.col("to_rn")))).drop("_at")
    hits = overlapping(heavy, z)
    return hits.select(*SERIES, "ts", "rn", F.lit("VolumeAbsorption").alias("event"))


def is_exhaustion(options: StructureOptions | None = None) -> Column:
    o = options or StructureOptions()
    atr = F.col("atr_14") if o.mode == "as_specified" else F.lit(None).cast("double")
    rng = F.col("high") - F.col("low")
    place = ratio(F.col("close") - F.col("low"), rng, None)
    against = F.when(F.col("trend") == 1, place <= o.exhaustion_outer).when(F.col("trend") == -1, place >= 1 - o.exhaustion_outer)
    return F.coalesce((atr > 0) & (rng >= o.exhaustion_atr_multiple * atr) & against, F.lit(False))


def exhaustion(frame: DataFrame, options: StructureOptions | None = None) -> DataFrame:
    return _rows(frame, _event("ExhaustionCandle", is_exhaustion(options)))


def gap_events(frame: DataFrame, options: StructureOptions | None = None) -> DataFrame:
    """Breakaway, continuation and exhaustion gaps; the last are stamped at the CHoCH that confirms them."""
    o, w = options or StructureOptions(), series()
    rows = frame.withColumn("_gap", F.signum(F.col("open") - F.col("close_1")).cast("int"))
    live = F.col("_gap").isNotNull() & (F.col("_gap") != 0)
    breakaway = live & (F.col("leg_kind") == "Impulse") & (F.col("leg_dir") == F.col("_gap")) & F.col("is_ranging")
    with_trend = live & (F.col("_gap") == F.col("trend"))
    rows = rows.withColumn("_kind", F.when(breakaway, "GapBreakaway").when(with_trend & ~F.col("is_ranging"), "GapContinuation").when(with_trend & (F.col("trend_leg_run") >= o.gap_min_trend_legs), "candidate"))
    hit = F.lit(None).cast("date")
    for k in range(o.gap_reversal_lookahead - 1, -1, -1):
        hit = F.when(F.coalesce(F.lead("break_kind", k).over(w) == "CHoCH", F.lit(False)), F.lead("ts", k).over(w)).otherwise(hit)
    late = F.col("_kind") == "candidate"
    rows = rows.withColumn("_hit", hit).filter(F.col("_kind").isNotNull() & (~late | F.col("_hit").isNotNull()))
    return rows.select(*SERIES, F.when(late, F.col("_hit")).otherwise(F.col("ts")).alias("ts"), F.when(late, "GapExhaustion").otherwise(F.col("_kind")).alias("event"))


def candle_events(frame: DataFrame, options: StructureOptions | None = None) -> DataFrame:
    """The event rows that no zone has a part in: series, ts, event."""
    out = liquidity_grabs(frame)
    for more in (traps(frame, options), false_breakouts(frame, options), exhaustion(frame, options), gap_events(frame, options)):
        out = out.unionByName(more)
    return out


def events(frame: DataFrame, mitigated: DataFrame, options: StructureOptions | None = None) -> DataFrame:
    """All event rows: series, ts, event."""
    return candle_events(frame, options).unionByName(volume_absorption(frame, mitigated, options))

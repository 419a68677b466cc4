"""The state of every candle in one movement of the candles: what decisions and backtests read.

All windows of a series come first, over candles that are moved and sorted once. What recurs (indicators) and what asks when a
zone ends go over whole series in two ordered passes; between them and after them each row stands alone. So nothing else is
shuffled, and no frame, zones or states are written. Series of more candles than a task holds take the frame of all candles.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.config import EngineOptions
from wickwork.functions.scalars import series
from wickwork.functions.staging import packed, staged, unpacked
from wickwork.operators import decision
from wickwork.operators.decision import READ, UNREAD, decide, impulses, metrics_of, quality_context, turned
from wickwork.operators.ends import folded, long_series_of, meets, whole_series
from wickwork.operators.indicators import FOLDS, prepared, window_indicators
from wickwork.operators.patterns import patterns
from wickwork.operators.structure import first_hits, fvg_of, is_exhaustion, is_heavy, leg_zones_of, legs
from wickwork.schema import SERIES

#: What plans and trades read of a decision.
CHOSEN = (*SERIES, "ts", "rn", "close", "direction", "atr_14", "low_swing", "high_swing", "outcome", "confidence")
ZONE = (*SERIES, "kind", "created_rn", "full_rn", "upper", "lower")
LEG = ("leg_kind", "leg_dir", "leg_start_ts", "leg_start")


def zoned(rows: DataFrame) -> DataFrame:
    """Rows of whole series in order, with fulls (full_rn of each leg zone) and, as known at each candle, live_long,
    live_short, has_absorption and has_exhaustion.
    """

    def run(batches):
        import numpy as np

        for t, starts in whole_series(batches):
            n, bounds = t.num_rows, np.append(starts, t.num_rows)
            high, low, price, upper, lower = (t.column(x).to_numpy() for x in ("high", "low", "swing_price", "fvg_upper", "fvg_lower"))
            heavy, spent = (t.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("heavy", "exhausted"))
            made = t.column("leg_zones").combine_chunks()
            sizes = made.value_lengths().fill_null(0).to_numpy()
            held = made.flatten()
            top, bottom = (held.field(x).to_numpy(zero_copy_only=False) for x in ("upper", "lower"))
            long = pc.is_in(held.field("kind"), pa.array(["DemandZone", "OrderBlockBullish"])).to_numpy(zero_copy_only=False).astype(bool)
            at = np.repeat(np.arange(n), sizes)  # the candle of each leg zone
            fulls, absorbed, exhausted = np.full(len(at), -1, "i8"), np.zeros(n, bool), np.zeros(n, bool)
            live = np.zeros((2, n), "i8")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                h, lo, busy = high[a:b], low[a:b], np.flatnonzero(heavy[a:b])
                x, y = np.searchsorted(at, (a, b)).tolist()
                gaps = np.flatnonzero(~np.isnan(upper[a:b])) if len(busy) else np.zeros(0, "i8")
                start = np.concatenate((at[x:y] - a, gaps))
                over, under = np.concatenate((top[x:y], upper[a:b][gaps])), np.concatenate((bottom[x:y], lower[a:b][gaps]))
                end = first_hits(h, lo, start + 1, under, over)
                fulls[x:y] = np.where(end[: y - x] >= 0, end[: y - x] + 1, -1)
                for side, mine in enumerate((long[x:y], ~long[x:y])):
                    gone = end[: y - x][mine]
                    live[side, a:b] = np.cumsum(np.bincount(start[: y - x][mine], minlength=b - a) - np.bincount(gone[gone >= 0], minlength=b - a))
                if len(busy):
                    turns = np.flatnonzero(~np.isnan(price[a:b]))
                    swing = price[a:b][turns]
                    parts = (start, turns), (np.where(end >= 0, end, b - a), np.full(len(turns), b - a)), (over, swing), (under, swing)
                    first = meets(h, lo, busy, *(np.concatenate(p) for p in parts))
                    if first >= 0:
                        absorbed[a + first : b] = True
                exhausted[a:b] = np.logical_or.accumulate(spent[a:b])
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype("i4")
            t = t.drop_columns(list(gone_columns)).append_column("fulls", pa.ListArray.from_arrays(pa.array(offsets), pa.array(fulls, pa.int32(), mask=fulls < 0)))
            for k, x in (("live_long", live[0]), ("live_short", live[1]), ("has_absorption", absorbed), ("has_exhaustion", exhausted)):
                t = t.append_column(k, pa.array(x))
            yield from t.to_batches()

    gone_columns = ("heavy", "exhausted", "swing_price", "fvg_upper", "fvg_lower")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in gone_columns)
    return rows.mapInArrow(run, f"{fields}, fulls array<int>, live_long long, live_short long, has_absorption boolean, has_exhaustion boolean")


def every_state(candles: DataFrame, index: DataFrame, options: EngineOptions | None = None, calendar: DataFrame | None = None, bands: DataFrame | None = None) -> DataFrame:
    """One row a candle with all that a decision at its close reads, the impulse leg that ends there (leg_*), its zones
    (leg_zones), the numbers of the candles that cover these (fulls), and is_last of a series: see ``decision.state_frame``.

    Series of at most ``indicators.BLOCK`` candles, which a task holds whole.
    """
    o, w = options or EngineOptions(), series()
    folds = {i.key for i in FOLDS}
    rows = prepared(quality_context(candles, index, o, calendar, bands)).drop("tp", "tp_1", "adj_close")
    rows = window_indicators(packed(rows, *SERIES, "ts", "rn", "open", "high", "low", "close", "close_1", "volume", "log_ret"), [k for k in READ if k not in folds])
    rows = unpacked(patterns(rows, o.patterns)).drop("log_ret", "stochastic_d")
    rows = packed(rows, *SERIES, "ts", "rn", "open", "high", "low", "close")
    before = {f"p_{x}": F.lag(x).over(w) for x in ("open", "high", "low", "close")}
    rows = unpacked(turned(rows.withColumns({"_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w), "is_last": F.lead("rn").over(w).isNull(), **before}), o))
    metrics, gap = metrics_of(o, bands is not None), fvg_of(F.col("_h2"), F.col("_l2"))
    by_atr = {"range_to_atr": metrics.pop("range_to_atr")}
    rows = rows.withColumns({**metrics, "heavy": F.coalesce(is_heavy(o.structure), F.lit(False)), "fvg_upper": gap["upper"], "fvg_lower": gap["lower"]})
    rows = folded(rows.drop("_h2", "_l2", "_band", "open", "volume", "volume_sma", "close_1", "swing_ts", *UNREAD), every=True)
    rows = impulses(rows, o)
    zones = F.when((F.col("leg_kind") == "Impulse") & F.col("p_open").isNotNull(), leg_zones_of())
    rows = rows.withColumns({"leg_zones": zones, "exhausted": is_exhaustion(o.structure), **by_atr})
    return zoned(rows.drop("swing", *before))


def decided_frame(candles: DataFrame, index: DataFrame, options: EngineOptions | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """The decision at every candle."""
    long = long_series_of(candles)
    some = not long.isEmpty()
    short = candles.join(long, SERIES, "left_anti") if some else candles
    out = decide(every_state(short, index, options, calendar).drop("leg_zones", "fulls", "is_last", *LEG), options)
    if some:
        whole = decision.decided_frame(candles.join(long, SERIES, "left_semi"), index, options, calendar)
        out = out.select(*(c for c in out.columns if c in whole.columns))
        out = out.unionByName(whole.select(*out.columns))
    return out


def last_scores(candles: DataFrame, index: DataFrame, options: EngineOptions | None = None) -> DataFrame:
    """The scores and confidence of each series' last candle."""
    long = long_series_of(candles)
    some = not long.isEmpty()
    columns = [*SERIES, "ts", *(f"score_{k}" for k in decision.LAYERS), "confidence"]
    states = every_state(candles.join(long, SERIES, "left_anti") if some else candles, index, options).filter("is_last")
    out = decision.layer_scores(states, options).select(*columns)
    if some:
        frame = decision.candle_frame(candles.join(long, SERIES, "left_semi"), index, options)
        out = out.unionByName(decision.layer_scores(decision.last_states(frame, decision.frame_zones(frame), options), options).select(*columns))
    return out


def walked(candles: DataFrame, index: DataFrame, mark, options: EngineOptions | None = None, calendar: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the Buy and StrongBuy decisions of the candles that ``mark`` asks for, the zones with full_rn, the impulse legs).

    ``mark`` adds _asked to rows of candles (series, ts, rn).
    """
    long = long_series_of(candles)
    some = not long.isEmpty()
    buys, impulse = F.col("outcome").isin("Buy", "StrongBuy"), F.coalesce(F.col("leg_kind") == "Impulse", F.lit(False))
    rows = mark(every_state(candles.join(long, SERIES, "left_anti") if some else candles, index, options, calendar)).filter(F.col("_asked") | impulse)
    # Written once, and read from several sides: what is chosen, and what the walk tells of legs and their zones.
    rows = decide(rows, options).withColumn("_chosen", F.col("_asked") & buys).filter(F.col("_chosen") | impulse)
    kept = staged(rows.select(*CHOSEN, *LEG, "leg_zones", "fulls", "_chosen"), "walk")
    chosen, zone = kept.filter("_chosen").select(*CHOSEN), F.explode(F.arrays_zip("leg_zones", "fulls")).alias("z")
    zones = kept.filter(F.size("leg_zones") > 0).select(*SERIES, F.col("rn").alias("created_rn"), zone).select(*SERIES, "z.leg_zones.kind", "created_rn", F.col("z.fulls").alias("full_rn"), "z.leg_zones.upper", "z.leg_zones.lower")
    turns = legs(kept)
    if some:
        frame = decision.candle_frame(candles.join(long, SERIES, "left_semi"), index, options, calendar=calendar)
        mitigated, asked = decision.frame_zones(frame), mark(frame).filter("_asked").drop("_asked")
        rows = decide(decision.states_of(decision.early_scores(asked, options), frame, mitigated, options), options).filter(buys)
        chosen, zones, turns = chosen.unionByName(staged(rows.select(*CHOSEN), "chosen")), zones.unionByName(mitigated.select(*ZONE)), turns.unionByName(legs(frame))
    return chosen, zones, turns

"""What a scan leaves behind: the latest indicator values, and what happened at each series' last candle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.config import StructureOptions
from wickwork.functions.scalars import series
from wickwork.functions.staging import packed, staged, unpacked
from wickwork.operators.ends import LAST, folded, long_series_of, whole_series
from wickwork.operators.indicators import CUMULATIVE, RECENT, WINDOWS, fold_indicators, prepared, recent_indicators, snapshot, tail_of, window_indicators
from wickwork.operators.structure import absorbing, breaks, candle_events, first_hits, fvg_of, leg_zones_of, structure_frame, swings
from wickwork.schema import SERIES
from wickwork.sources.store import Store

#: What breaks, swings and events read of a frame.
EVENT_COLUMNS = (
    *SERIES, "ts", "rn", "open", "high", "low", "close", "close_1", "volume", "atr_14", "volume_sma", "swing", "swing_price", "swing_ts", "high_swing", "low_swing", "is_higher_or_lower",
    "break_dir", "break_kind", "broken_price", "trend", "is_ranging", "was_ranging", "leg_kind", "leg_dir", "trend_leg_run",
)


def latest_events(frame: DataFrame, mitigated: DataFrame, options: StructureOptions | None = None) -> DataFrame:
    """series, ts, event_type, detail: breaks, confirmed swings and events of the last candle of each series.

    Events are stamped at most a look-ahead after the candle that calls for them, so the last candles alone are looked at;
    absorption at the last one meets the zones and swing prices of the whole series.
    """
    o, keys = options or StructureOptions(), [*SERIES, "ts"]
    tail = staged(tail_of(frame.select(*EVENT_COLUMNS), max(o.trap_lookahead, o.gap_reversal_lookahead) + 1), "last-candles")
    last = tail_of(tail, 1)
    side = F.when(F.col("direction") == 1, "Bullish").otherwise("Bearish")
    b = breaks(tail).select(*keys, F.col("kind").alias("event_type"), F.concat_ws(" ", side, F.lit("through"), F.format_string("%.2f", "broken_price")).alias("detail"))
    s = swings(tail).select(*SERIES, F.col("confirmed_ts").alias("ts"), F.concat(F.lit("Swing"), "swing").alias("event_type"), F.concat_ws(" ", F.format_string("%.2f", "price"), F.lit("of"), F.col("ts").cast("string")).alias("detail"))
    e = candle_events(tail, o).unionByName(absorbing(frame, mitigated, o, last).drop("rn"))
    e = e.select(*keys, F.col("event").alias("event_type"), F.lit("").alias("detail")).distinct()
    return b.unionByName(s).unionByName(e).join(last.select(*keys), keys, "left_semi")


def ends_of_series(candles: DataFrame, options: StructureOptions | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(what ``persist_scan`` reads of a frame: the last candles with recursive and cumulative indicators and structure, and of
    those before the swing prices, the zones that live at a series' end), each written once; None where a series is longer
    than a task holds. Frames and zones of all candles are neither written nor dealt.
    """
    o, w = options or StructureOptions(), series()
    if not long_series_of(candles).isEmpty():
        return None
    bars = window_indicators(prepared(candles), ["VolumeSMA_20", *CUMULATIVE])
    # The last candles, and those before the first missing value, whose indicators are kept.
    late = F.lead("rn", RECENT).over(w).isNull() | (F.col("error").isNull() & F.lead("error", RECENT).over(w).isNotNull())
    bars = bars.withColumn("late", late)
    folded_ = fold_indicators(bars).filter("late").drop("atr_14", "late")
    values = folded_.select(*SERIES, "ts", *(c for c in folded_.columns if c not in EVENT_COLUMNS))
    rows = folded(bars.select(*SERIES, "ts", "rn", "open", "high", "low", "close", "close_1", "volume", "volume_sma", "error", "tr", "late"), every=True).drop(*LAST)
    rows = unpacked(structure_frame(None, o, packed(rows, *SERIES, "ts", "rn", "high", "low", "close", "atr_14")))
    p = {f"p_{x}": F.lag(x).over(w) for x in ("open", "high", "low", "close")}
    rows = rows.withColumns({"_gap": fvg_of(F.lag("high", 2).over(w), F.lag("low", 2).over(w)), **p})
    made = F.when((F.col("leg_kind") == "Impulse") & F.col("p_open").isNotNull(), leg_zones_of())
    made = F.array_compact(F.concat(F.array("_gap"), F.coalesce(made, F.array())))
    rows = living(rows.withColumn("zones", made).select(*EVENT_COLUMNS, "late", "zones"))
    kept = staged(rows.filter(F.col("late") | F.col("swing").isNotNull() | (F.size("zones") > 0)), "ends")
    zones = kept.filter(F.size("zones") > 0).select(*SERIES, F.col("rn").alias("created_rn"), F.lit(None).cast("int").alias("full_rn"), F.inline("zones"))
    values = staged(values, "values")
    rest = [c for c in values.columns if c not in (*SERIES, "ts")]
    last = kept.filter("late").drop("late", "zones").join(values, [*SERIES, "ts"])
    before = kept.filter("NOT late AND swing IS NOT NULL").select(*SERIES, "ts", "rn", "swing", "swing_price", F.lit("not read").alias("error"))
    assert "error" in rest
    return staged(last.unionByName(before, allowMissingColumns=True), "frame"), zones


def living(rows: DataFrame) -> DataFrame:
    """``rows`` of whole series in order, of whose zones (kind, upper, lower) those stay that no later candle covers."""

    def run(batches):
        import numpy as np

        for t, starts in whole_series(batches):
            bounds, held = np.append(starts, t.num_rows), t.column("zones").combine_chunks()
            sizes, made = held.value_lengths().fill_null(0).to_numpy(), held.flatten()
            at, alive = np.repeat(np.arange(t.num_rows), sizes), np.zeros(len(made), bool)
            high, low = (t.column(x).to_numpy() for x in ("high", "low"))
            top, bottom = (made.field(x).to_numpy(zero_copy_only=False) for x in ("upper", "lower"))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                x, y = np.searchsorted(at, (a, b)).tolist()
                alive[x:y] = first_hits(high[a:b], low[a:b], at[x:y] - a + 1, bottom[x:y], top[x:y]) < 0
            offsets = np.concatenate(([0], np.cumsum(np.bincount(at[alive], minlength=t.num_rows)))).astype("i4")
            place = t.column_names.index("zones")
            t = t.set_column(place, "zones", pa.ListArray.from_arrays(pa.array(offsets), made.filter(pa.array(alive))))
            yield from t.to_batches()

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))


def persist_scan(store: Store, frame: DataFrame, mitigated: DataFrame) -> dict[str, int]:
    """Puts snapshots and last events of ``frame`` (recursive indicators and structure); the buckets written, none by a second run.

    The indicators by windows are worked out here, for the last candles alone, but for those that sum from the first candle
    on where the frame has them.
    """
    sound = frame.filter(F.col("error").isNull()).drop(*(c for i in WINDOWS if i.key not in CUMULATIVE for c in i.columns))
    values = snapshot(recent_indicators(sound))
    return {"indicator_values": store.put("indicator_values", values), "structure_events": store.put("structure_events", latest_events(frame, mitigated))}

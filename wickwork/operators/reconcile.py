"""Adjusted-price reconciliation, and chart rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.config import ReconcileOptions
from wickwork.functions.staging import staged
from wickwork.operators.intervals import in_force
from wickwork.operators.structure import breaks, events, swings
from wickwork.schema import SERIES


def reconcile(cached: DataFrame, fresh: DataFrame, options: ReconcileOptions | None = None) -> DataFrame:
    """One row a fresh candle of the look-back: action insert, skip, overwrite or keep, with the relative difference."""
    o = options or ReconcileOptions()
    keys = [*SERIES, "ts"]
    latest = fresh.groupBy(*SERIES).agg(F.max("ts").alias("_to"))
    new = fresh.join(latest, SERIES).filter(F.col("ts") >= F.date_sub("_to", o.lookback_days)).select(*keys, F.col("adj_close").alias("fresh_adj"))
    both = new.join(cached.select(*keys, F.col("adj_close").alias("cached_adj")), keys, "left")
    diff = F.abs(F.col("fresh_adj") - F.col("cached_adj")) / F.when(F.col("cached_adj") != 0, F.col("cached_adj"))
    action = F.when(F.col("cached_adj").isNull(), "insert").when(F.col("cached_adj") == 0, "skip").when(diff > o.tolerance, "overwrite").otherwise("keep")
    return both.select(*keys, "cached_adj", "fresh_adj", diff.alias("difference"), action.alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with ``incoming`` rows added or put in place of those with equal ``keys``."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def latest_timestamps(candles: DataFrame) -> DataFrame:
    return candles.groupBy(*SERIES).agg(F.max("ts").alias("latest"))


def delta(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows of ``fetched`` at or after the last cached candle of their series, or of series not cached at all."""
    known = latest_timestamps(cached)
    return fetched.join(known, SERIES, "left").filter(F.col("latest").isNull() | (F.col("ts") >= F.col("latest"))).drop("latest")


def route(primary: DataFrame, secondary: DataFrame, requests: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(candles, flags) for ``requests`` (symbol_id, timeframe, from_day, to_day).

    H1, M30 and M15 come from the secondary provider. Daily and Weekly come from the primary one, unless it has fewer
    than ``least`` of the expected candles; then from the secondary one, with a flag.
    """
    days = F.datediff("to_day", "from_day")
    expected = F.when(F.col("timeframe") == "Weekly", F.greatest(F.lit(1), F.floor(days / 7))).otherwise(F.greatest(F.lit(1), F.floor(days * 5 / 7)))
    inside = lambda c: c.join(requests, SERIES).filter(F.col("ts").cast("date").between(F.col("from_day"), F.col("to_day")))
    got = inside(primary).groupBy(*SERIES).agg(F.count("*").alias("n"))
    chosen = requests.join(got, SERIES, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = (F.col("n") == 0) | (F.col("n") < least * expected)
    chosen = chosen.withColumn("fallback", F.when(F.col("timeframe").isin("Daily", "Weekly"), short).otherwise(F.lit(True)))
    flag = lambda v: chosen.filter(F.col("fallback") == v).select(*SERIES)
    rows = inside(primary).select(*primary.columns).join(flag(False), SERIES, "left_semi").unionByName(inside(secondary).select(*primary.columns).join(flag(True), SERIES, "left_semi"))
    flags = chosen.filter(F.col("fallback") & F.col("timeframe").isin("Daily", "Weekly")).select("symbol_id", F.col("to_day").alias("as_of_date"), F.lit("SecondaryProviderFallbackUsed").alias("flag_type"), F.col("timeframe").alias("detail"))
    return rows, flags


def mapping_as_of(requests: DataFrame, mapping: DataFrame, symbols: DataFrame, provider: str = "Yahoo") -> DataFrame:
    """symbol_id, day, external_id: the newest mapping in force on the day; the exchange's own name by default."""
    found = in_force(requests.select("symbol_id", "day"), mapping.filter(F.col("provider") == provider), "symbol_id", "external_id")
    out = found.join(symbols.select("symbol_id", "nse_symbol"), "symbol_id")
    default = F.concat("nse_symbol", F.lit(".NS")) if provider == "Yahoo" else F.lit(None).cast("string")
    return out.select("symbol_id", "day", F.coalesce("external_id", default).alias("external_id"))


def snapshot_as_of(days: DataFrame, snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """day, symbol_id: the members of the newest snapshot in force on each day.

    Days and snapshots are two short lists of dates, merged in one order; of one day's snapshots the greater id counts.
    """
    s = snapshots.groupBy(F.col("effective_date").alias("day")).agg(F.max("snapshot_id").alias("snapshot_id")).withColumn("_asked", F.lit(0))
    both = s.unionByName(days.select("day", F.lit(None).cast("bigint").alias("snapshot_id"), F.lit(1).alias("_asked")))
    w = Window.orderBy("day", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("snapshot_id", F.last("snapshot_id", ignorenulls=True).over(w)).filter("_asked = 1 and snapshot_id is not null and day is not null")
    return latest.join(members, "snapshot_id").select("day", "snapshot_id", "symbol_id")


def allocate_ids(fetched: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of ``fetched`` (nse_symbol, ...) with the known id, or ids after the largest in order of names; inactive
    symbols count too, rows of one name share an id, and a null name has none.

    Names are dealt to ranges; each range numbers its own, from the count of names in the ranges before it.
    """
    known = fetched.drop("symbol_id").join(symbols.select("nse_symbol", "symbol_id"), "nse_symbol", "left")
    names = known.filter(F.col("symbol_id").isNull() & F.col("nse_symbol").isNotNull()).select("nse_symbol").distinct()
    ranges = staged(names.repartitionByRange("nse_symbol").withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").count()  # one row a range
    before = counts.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    top = symbols.agg(F.coalesce(F.max("symbol_id"), F.lit(0)).alias("_top"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("nse_symbol"))
    fresh = ranges.withColumn("_own", own).join(F.broadcast(before), "_range").join(F.broadcast(top), F.lit(True))  # a row a range, one row
    fresh = fresh.select("nse_symbol", (F.col("_top") + F.col("_before") + F.col("_own")).alias("_new"))
    out = known.join(fresh, "nse_symbol", "left").withColumn("symbol_id", F.coalesce("symbol_id", "_new"))
    return out.drop("_new")


def chart_markers(frame: DataFrame, mitigated: DataFrame) -> DataFrame:
    """series, time, marker: swings, breaks and events of a chart."""
    s = swings(frame).select(*SERIES, "ts", F.concat(F.lit("Swing"), "swing").alias("marker"))
    b = breaks(frame).select(*SERIES, "ts", F.concat("kind", F.when(F.col("direction") == 1, "Bullish").otherwise("Bearish")).alias("marker"))
    e = events(frame, mitigated).select(*SERIES, "ts", F.col("event").alias("marker"))
    return s.unionByName(b).unionByName(e).withColumn("time", F.date_format("ts", "yyyy-MM-dd")).drop("ts")


def chart_zones(mitigated: DataFrame) -> DataFrame:
    """Order blocks and gaps alone are drawn."""
    return mitigated.filter(F.col("kind").startswith("Fvg") | F.col("kind").startswith("OrderBlock"))

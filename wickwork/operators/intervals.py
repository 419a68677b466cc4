"""Joins of candles with zones that live over a span of candles, without meeting all zones of a series.

A span of candle numbers is cut into dyadic nodes: node k of level l covers the numbers from k * 2^l up to the next
node's. A span has at most two nodes a level, which do not overlap, and a candle lies in one node of each level, so a candle
and a zone that lives there share exactly one node. Zones and candles are dealt to (series, node), and by price too:
``overlapping`` adds cells of logarithmic price, and ``next_above`` merges the prices of a node in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.schema import SERIES

#: Spans without an end reach to this candle number.
LEVELS = 30
FOREVER = 1 << LEVELS
#: Candles that ``overlapping`` deals to nodes as one.
BLOCK = 512


def _at(level: Column, node: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), node.cast("bigint").alias("node"))


def _top(n: Column) -> Column:
    """The highest level at which ``n`` lies in a node above 0."""
    return F.length(F.bin(n.cast("bigint"))) - 1


def span_nodes(start: Column, end: Column) -> Column:
    """The nodes of the numbers from ``start`` (at least 1) up to, not including, ``end`` (null: no end)."""
    a, b = start.cast("bigint"), F.coalesce(end.cast("bigint"), F.lit(FOREVER))

    def nodes(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("bigint")
        low, high = F.floor((a + size - 1) / size).cast("bigint"), F.floor(b / size).cast("bigint")
        left = F.when((low % 2 == 1) & (low < high), _at(k, low))
        right = F.when((high % 2 == 1) & (low < high), _at(k, high - 1))
        return F.array(left, right)

    every = F.flatten(F.transform(F.sequence(F.lit(0), _top(b)), nodes))
    return F.filter(every, lambda n: n.isNotNull())


def candle_nodes(rn: Column) -> Column:
    """The nodes that hold candle ``rn``; those of number 0 belong to no span."""
    every = F.transform(F.sequence(F.lit(0), _top(rn)), lambda k: _at(k, F.floor(rn / F.pow(F.lit(2.0), k))))
    return F.filter(every, lambda n: n["node"] > 0)


def price_cell(price: Column, width: float) -> Column:
    """The cell of a price on a logarithmic scale; prices of zero and below share one."""
    return F.when(price > 0, F.floor(F.log(price) / math.log1p(width))).otherwise(F.lit(-(1 << 40))).cast("bigint")


def cells(low: Column, high: Column, width: float) -> Column:
    a, b = price_cell(low, width), price_cell(high, width)
    return F.when(low <= high, F.when(low > 0, F.sequence(a, b)).when(high > 0, F.concat(F.array(a), F.sequence(F.lit(-4096).cast("bigint"), b))).otherwise(F.array(a)))


def overlapping(candles: DataFrame, zones: DataFrame, width: float = 0.01) -> DataFrame:
    """Rows of ``candles`` (series, rn, low, high, ...) at which a zone (series, from_rn, to_rn, bottom, top) lives
    (from_rn <= rn < to_rn) whose prices meet the candle's. Each candle once.

    Pairs that meet share a node and a cell of ``width`` (a share of the price), so beyond those kept only zones that miss
    the candle within a cell, or within a block of candles, are looked at. Nodes are those of blocks of ``BLOCK`` candles up
    to the last candle of the series, so a short series has few of them.
    """
    node = lambda df, nodes: df.select("*", F.explode(nodes).alias("_n"))
    block = lambda rn: F.floor(F.col(rn) / BLOCK) + 1
    ends = candles.groupBy(*SERIES).agg((F.max("rn") + 1).alias("_end"))
    z = zones.select(*SERIES, "from_rn", "to_rn", "bottom", "top").join(ends, SERIES).withColumn("to_rn", F.least("to_rn", "_end")).filter(F.col("from_rn") < F.col("to_rn"))
    z = node(z.withColumn("_last", F.col("to_rn") - 1), span_nodes(block("from_rn"), block("_last") + 1))
    z = z.select(*SERIES, "_n", F.explode(cells(F.col("bottom"), F.col("top"), width)).alias("_cell"), "from_rn", "to_rn", "bottom", "top")
    c = node(candles.select(*SERIES, "rn", F.col("low").alias("_low"), F.col("high").alias("_high")), candle_nodes(block("rn")))
    c = c.select(*SERIES, "rn", "_n", F.explode(cells(F.col("_low"), F.col("_high"), width)).alias("_cell"), "_low", "_high")
    hits = c.join(z, [*SERIES, "_n", "_cell"]).filter((F.col("_low") <= F.col("top")) & (F.col("_high") >= F.col("bottom")) & F.col("rn").between(F.col("from_rn"), F.col("to_rn") - 1))
    return candles.join(hits.select(*SERIES, "rn").distinct(), [*SERIES, "rn"], "left_semi")


def next_above(points: DataFrame, zones: DataFrame) -> DataFrame:
    """series, rn, side, price, found: for every point the least price above it among the zones (series, side, from_rn,
    to_rn, price) of its side that live at its candle; null where none is above.

    Points and zones of a node are merged in descending order of price: the last zone seen is the next above. No pairs are
    made.
    """
    keys = [*SERIES, "side"]
    z = zones.select(*keys, F.explode(span_nodes(F.col("from_rn"), F.col("to_rn"))).alias("_n"), "price", F.lit(1).alias("_zone"), F.lit(None).cast("int").alias("rn"))
    p = points.select(*keys, F.explode(candle_nodes(F.col("rn"))).alias("_n"), "price", F.lit(0).alias("_zone"), F.col("rn").cast("int").alias("rn"))
    # Zones at a point's own price come after it: they are not above.
    w = Window.partitionBy(*keys, "_n").orderBy(F.desc("price"), "_zone").rowsBetween(Window.unboundedPreceding, 0)
    merged = z.unionByName(p).withColumn("_found", F.last(F.when(F.col("_zone") == 1, F.col("price")), ignorenulls=True).over(w))
    return merged.filter("_zone = 0").groupBy(*keys, "rn", "price").agg(F.min("_found").alias("found"))


def _ordinal(day: Column) -> Column:
    return F.datediff(day, F.lit("0001-01-01").cast("date")) + 1


def in_force(requests: DataFrame, intervals: DataFrame, key: str, value: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """``requests`` (key, day, ...) with the ``value`` of the interval with the latest ``start`` among those of their key that
    hold the day, both ends included (a null end: no end); null where none does. Of equal starts the greater value counts.

    Intervals become stretches of days first: at each of their borders the newest is looked up by dyadic nodes of days.
    Requests and stretches are then merged in order of (key, day), so a key may have any number of requests.
    """
    i = intervals.select(key, F.col(start).alias("_from"), F.col(end).alias("_to"), F.col(value).alias("_value"))
    i = i.filter(F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_to") >= F.col("_from"))))
    borders = i.select(key, F.col("_from").alias("_day")).unionByName(i.filter(F.col("_to").isNotNull()).select(key, F.date_add("_to", 1).alias("_day"))).distinct()
    newest = F.max(F.struct("_from", "_value"))
    tops = i.select(key, "_from", "_value", F.explode(span_nodes(_ordinal(F.col("_from")), _ordinal(F.col("_to")) + 1)).alias("_n")).groupBy(key, "_n").agg(newest.alias("_top"))
    at = borders.select(key, "_day", F.explode(candle_nodes(_ordinal(F.col("_day")))).alias("_n")).join(tops, [key, "_n"]).groupBy(key, "_day").agg(F.max("_top").alias("_top"))
    stretches = borders.join(at, [key, "_day"], "left").select(key, "_day", F.struct(F.col("_top")["_value"].alias("v")).alias("_stretch"))
    rest = [c for c in requests.columns if c not in (key, value)]
    asked = requests.select(key, F.col("day").alias("_day"), F.lit(None).cast(stretches.schema["_stretch"].dataType).alias("_stretch"), F.struct(*rest).alias("_asked"))
    merged = asked.unionByName(stretches.withColumn("_asked", F.lit(None).cast(asked.schema["_asked"].dataType)))
    w = Window.partitionBy(key).orderBy("_day", F.col("_asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("_now", F.last("_stretch", ignorenulls=True).over(w)).filter(F.col("_asked").isNotNull())
    return merged.select(key, "_asked.*", F.when(F.col("_day").isNotNull(), F.col("_now")["v"]).alias(value))

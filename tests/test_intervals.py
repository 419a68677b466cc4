"""Interval joins against all pairs."""

import random

from pyspark.sql import functions as F

from wickwork.operators import intervals

ZONES = "symbol_id long, timeframe string, from_rn int, to_rn int, bottom double, top double"


def spans(rng, n, most=400):
    out = []
    for k in range(n):
        a = rng.randrange(1, most)
        low = rng.choice([rng.uniform(0, 30), 10.0, rng.uniform(99, 101)])
        out.append((k % 3, "Daily", a, None if rng.random() < 0.3 else a + rng.randrange(0, most), low, low + rng.choice([0.0, 0.5, 20.0])))
    return out


def test_a_candle_and_a_living_zone_share_one_node(spark):
    rng = random.Random(1)
    rows = [(a, None if rng.random() < 0.2 else a + rng.randrange(0, 70)) for a in (rng.randrange(1, 60) for _ in range(60))]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", intervals.span_nodes(F.col("a"), F.col("b")).alias("n")).collect()
    held = {r["rn"]: {tuple(x) for x in r["n"]} for r in spark.range(1, 200).select(F.col("id").alias("rn"), intervals.candle_nodes(F.col("id")).alias("n")).collect()}
    for r in got:
        nodes = {tuple(x) for x in r["n"]}
        assert len(nodes) == len(r["n"]) <= 2 * intervals.LEVELS
        for rn, own in held.items():
            assert len(nodes & own) == (r["a"] <= rn and (r["b"] is None or rn < r["b"]))


def test_overlapping_equals_all_pairs(spark):
    rng = random.Random(2)
    zones = spans(rng, 120)
    candles = [(k % 3, "Daily", 1 + k // 3, low, low + rng.choice([0.0, 0.3, 5.0])) for k, low in enumerate(rng.choice([rng.uniform(0, 60), 0.0, 10.5, 100.0]) for _ in range(900))]
    got = intervals.overlapping(spark.createDataFrame(candles, "symbol_id long, timeframe string, rn int, low double, high double"), spark.createDataFrame(zones, ZONES))
    want = {(s, rn) for s, _, rn, lo, hi in candles for z in zones if z[0] == s and z[2] <= rn and (z[3] is None or rn < z[3]) and lo <= z[5] and hi >= z[4]}
    rows = got.collect()
    assert {(r["symbol_id"], r["rn"]) for r in rows} == want and len(rows) == len(want) and 0 < len(want) < 900


def test_next_above_equals_all_pairs(spark):
    rng = random.Random(3)
    zones = [(*z[:4], rng.choice([1, -1]), float(round(z[4]))) for z in spans(rng, 150)]
    points = [(k % 3, "Daily", 1 + k // 3, rng.choice([1, -1]), float(rng.randrange(0, 110))) for k in range(900)]
    z = spark.createDataFrame(zones, "symbol_id long, timeframe string, from_rn int, to_rn int, side int, price double")
    got = intervals.next_above(spark.createDataFrame(points, "symbol_id long, timeframe string, rn int, side int, price double"), z)
    want = {(s, rn): min((y[5] for y in zones if y[0] == s and y[4] == side and y[2] <= rn and (y[3] is None or rn < y[3]) and y[5] > price), default=None) for s, _, rn, side, price in points}
    assert {(r["symbol_id"], r["rn"]): r["found"] for r in got.collect()} == want


def test_pairs_grow_with_hits_and_not_with_zones(spark):
    """Zones at other prices, or of other times, never meet the candles in the join."""
    zones = spark.range(20_000).select(F.lit(1).cast("long").alias("symbol_id"), F.lit("Daily").alias("timeframe"), (1 + F.col("id") % 5000).cast("int").alias("from_rn"), F.when(F.col("id") % 2 == 0, F.lit(6000)).alias("to_rn"), (100 + F.col("id")).cast("double").alias("bottom"), (100.5 + F.col("id")).alias("top"))
    candles = spark.range(1, 2000).select(F.lit(1).cast("long").alias("symbol_id"), F.lit("Daily").alias("timeframe"), F.col("id").cast("int").alias("rn"), F.lit(50.0).alias("low"), F.lit(51.0).alias("high"))
    assert intervals.overlapping(candles, zones).count() == 0
    cell = lambda low, high: F.explode(intervals.cells(F.col(low), F.col(high), 0.01))
    assert candles.select(cell("low", "high").alias("c")).distinct().join(zones.select(cell("bottom", "top").alias("c")), "c").count() == 0


def test_in_force_equals_all_pairs(spark):
    import datetime

    rng, day = random.Random(5), lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    held = [(k % 4, day(a := rng.randrange(0, 60)), None if rng.random() < 0.3 else day(a + rng.randrange(-2, 25)), f"x{k:02d}") for k in range(40)]
    asked = [(k % 5, day(rng.randrange(-5, 90)) if k % 17 else None, k) for k in range(400)]
    got = intervals.in_force(spark.createDataFrame(asked, "symbol_id long, day date, n int"), spark.createDataFrame(held, "symbol_id long, effective_from date, effective_to date, external_id string"), "symbol_id", "external_id")
    want = {}
    for s, d, n in asked:
        live = [(a, x) for i, a, z, x in held if i == s and d is not None and a <= d and (z is None or z >= d)]
        want[n] = max(live)[1] if live else None
    rows = got.collect()
    assert len(rows) == 400 and {r["n"]: r["external_id"] for r in rows} == want


def test_a_key_with_many_requests(spark):
    held = spark.createDataFrame([(1, "2000-01-01", None, "a"), (1, "2010-01-01", "2012-01-01", "b")], "symbol_id long, f string, t string, external_id string").select("symbol_id", F.col("f").cast("date").alias("effective_from"), F.col("t").cast("date").alias("effective_to"), "external_id")
    asked = spark.range(1_000_000).select(F.lit(1).cast("long").alias("symbol_id"), F.date_add(F.lit("2005-01-01").cast("date"), (F.col("id") % 4000).cast("int")).alias("day"))
    assert {r["external_id"]: r["count"] for r in intervals.in_force(asked, held, "symbol_id", "external_id").groupBy("external_id").count().collect()} == {"a": 817_250, "b": 182_750}


def test_ids_of_repeated_and_null_names(spark):
    from wickwork.operators.reconcile import allocate_ids

    got = allocate_ids(spark.createDataFrame([("B",), ("A",), ("B",), (None,), ("K",)], "nse_symbol string"), spark.createDataFrame([("K", 7), ("L", 9)], "nse_symbol string, symbol_id long"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("A", 10), ("B", 11), ("B", 11), ("K", 7), (None, None)]


def test_blocks_of_candles_change_no_hit(spark, monkeypatch):
    rng = random.Random(4)
    zones = spans(rng, 80, 120)
    candles = [(k % 3, "Daily", 1 + k // 3, low, low + rng.choice([0.0, 0.3, 5.0])) for k, low in enumerate(rng.uniform(0, 60) for _ in range(360))]
    want = {(s, rn) for s, _, rn, lo, hi in candles for z in zones if z[0] == s and z[2] <= rn and (z[3] is None or rn < z[3]) and lo <= z[5] and hi >= z[4]}
    for block in (1, 7, 512):
        monkeypatch.setattr(intervals, "BLOCK", block)
        got = intervals.overlapping(spark.createDataFrame(candles, "symbol_id long, timeframe string, rn int, low double, high double"), spark.createDataFrame(zones, ZONES))
        assert {(r["symbol_id"], r["rn"]) for r in got.collect()} == want

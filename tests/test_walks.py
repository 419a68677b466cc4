"""Decisions and trades of one movement of the candles against those of the frame of all candles."""

from pyspark.sql import functions as F

from tests.test_indicators import candles
from tests.test_narrow import index, rows_of, several
from tests.test_sizes import walk
from wickwork.config import EngineOptions, StructureOptions
from wickwork.operators import backtest, decision, ends, indicators, persist, structure, walks


def test_states_of_a_walk_are_those_of_all_candles(spark):
    c = several(spark, (150, 90, 12, 1))
    c = c.unionByName(candles(spark, walk(80, 7)).withColumn("symbol_id", F.lit(9).cast("bigint")).withColumn("close", F.when(F.dayofyear("ts") != 75, F.col("close"))))
    bands = spark.createDataFrame([(1, 0.05)], "symbol_id long, band double")
    days = index(spark).select(F.col("ts").alias("day"))
    for o in (EngineOptions(structure=StructureOptions(mode="as_wired")), EngineOptions(structure=StructureOptions(absorption_multiple=1.01, absorption_max_body=101.0, exhaustion_atr_multiple=0.5))):
        want, mitigated = decision.state_frame(c, index(spark), o, bands=bands, calendar=days)
        got = walks.every_state(c, index(spark), o, bands=bands, calendar=days).cache()
        read = [x for x in want.columns if not x.startswith("leg_") and x in got.columns]
        assert set(want.columns) - set(got.columns) <= {"range_run", "is_ranging", "was_ranging", "trend_leg_run"}, set(want.columns) - set(got.columns)
        assert rows_of(got, *read) == rows_of(want, *read)
        zones = walks.walked(c, index(spark), lambda rows: rows.withColumn("_asked", F.lit(True)), o, days)[1]
        if o.structure.mode != "as_wired":
            assert rows_of(zones, *walks.ZONE) == rows_of(mitigated.filter(~F.col("kind").startswith("Fvg")), *walks.ZONE)
            assert 0 < got.filter("has_absorption").count() < got.count() and got.filter("has_exhaustion").count()


def test_decisions_write_candles_alone(spark, monkeypatch):
    """Neither a frame nor zones nor states are written, and candles are moved and sorted once."""
    c = several(spark)
    want = rows_of(decision.decided_frame(c, index(spark)), "symbol_id", "ts", "confidence", "outcome")
    for name in ("candle_frame", "frame_zones", "states_of"):
        monkeypatch.setattr(decision, name, None)
    got = walks.decided_frame(c, index(spark))
    assert rows_of(got, "symbol_id", "ts", "confidence", "outcome") == want
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(symbol_id")
    assert moved(got) == moved(decision.quality_context(c, index(spark), EngineOptions(), None, None))  # the first window, and those of the index


def test_long_series_walk_by_blocks(spark, monkeypatch):
    c, columns = several(spark, (260, 90, 300)), ("symbol_id", "ts", "confidence", "outcome")
    want = rows_of(walks.decided_frame(c, index(spark)), *columns)
    trades = rows_of(backtest.trades(c, index(spark)), "symbol_id", "ts", "outcome", "target1", "result", "r_multiple")
    scores = ("symbol_id", "ts", "score_trend", "score_volume", "score_support", "confidence")
    last = rows_of(walks.last_scores(c, index(spark)), *scores)
    monkeypatch.setattr(ends, "BLOCK", 100)
    assert rows_of(walks.decided_frame(c, index(spark)), *columns) == want
    assert rows_of(walks.last_scores(c, index(spark)), *scores) == last
    assert rows_of(backtest.trades(c, index(spark)), "symbol_id", "ts", "outcome", "target1", "result", "r_multiple") == trades


def test_ends_are_stored_as_those_of_the_whole_frame(spark):
    """Last events and indicator values, also of a series that misses a price, without a frame of all candles."""
    c = several(spark, (150, 90, 30))
    c = c.unionByName(candles(spark, walk(120, 7)).withColumn("symbol_id", F.lit(9).cast("bigint")).withColumn("close", F.when(F.dayofyear("ts") != 75, F.col("close"))))
    o = StructureOptions(absorption_multiple=1.01, absorption_max_body=101.0)
    bars = indicators.window_indicators(indicators.fold_indicators(indicators.prepared(c)), ["VolumeSMA_20", *indicators.CUMULATIVE])
    whole = structure.structure_frame(None, o, bars).cache()
    f, z = persist.ends_of_series(c, o)
    columns = ("symbol_id", "ts", "event_type", "detail")
    want = rows_of(persist.latest_events(whole, structure.with_mitigation(structure.zones(whole), whole), o), *columns)
    assert want and rows_of(persist.latest_events(f, z, o), *columns) == want
    assert f.filter("rsi_14 is not null").count() < whole.filter("rsi_14 is not null").count()
    values = [indicators.snapshot(indicators.recent_indicators(x.filter("error is null").drop(*(k for i in indicators.WINDOWS if i.key not in indicators.CUMULATIVE for k in i.columns)))) for x in (f, whole)]
    assert rows_of(values[0], *values[0].columns) == rows_of(values[1], *values[0].columns)

import dataclasses

import pytest
from pyspark.sql import functions as F

from tests.test_indicators import candles
from wickwork.config import BacktestOptions, DecisionOptions, QualityOptions, ReconcileOptions, RiskOptions, ScanOptions, StructureOptions, TimeframeWeights
from wickwork.operators import backtest, context, decision, reconcile, risk
from wickwork.plans import report


def gate_row(spark, **kw):
    base = {"traded_days": 60, "zero_run": 0, "direction": 1, "circuit": "None", "suppressed": False, "choch_dir": None, "choch_rn": None, "bos_rn": 5, "confidence": 81.0} | kw
    schema = "traded_days int, zero_run int, direction int, circuit string, suppressed boolean, choch_dir int, choch_rn int, bos_rn int, confidence double"
    return spark.createDataFrame([tuple(base[x.split()[0]] for x in schema.split(", "))], schema)


@pytest.mark.parametrize(("kw", "gate"), [
    ({}, None), ({"traded_days": 29}, "DataQuality"), ({"zero_run": 11}, "DataQuality"), ({"circuit": "UpperLocked"}, "CircuitLocked"), ({"circuit": "LowerLocked"}, None),
    ({"suppressed": True}, "RegimeSuppressed"), ({"choch_dir": -1, "choch_rn": 9}, "StructureBreakAgainstDirection"), ({"choch_dir": -1, "choch_rn": 3}, None), ({"traded_days": 1, "circuit": "UpperLocked"}, "DataQuality"),
])
def test_gates(spark, kw, gate):
    assert decision.hard_gates(gate_row(spark, **kw)).first()["hard_gate_failed"] == gate


@pytest.mark.parametrize(("confidence", "outcome"), [(81, "StrongBuy"), (80, "StrongBuy"), (79.9, "Buy"), (65, "Buy"), (50, "Watch"), (39, "Hold"), (20, "Sell"), (19, "StrongSellExit")])
def test_outcomes(spark, confidence, outcome):
    assert spark.range(1).select(decision.outcome_of(F.lit(float(confidence))).alias("x")).first()["x"] == outcome


def plan(spark, close=100.0, direction=1, atr=2.0, low=None, high=None, zone=None):
    row = spark.createDataFrame([(close, direction, atr, low, high, zone, None)], "close double, direction int, atr_14 double, low_swing double, high_swing double, next_zone double, duration_days double")
    return risk.trade_plan(row).first()


def test_plan_takes_the_further_stop_and_the_nearer_target(spark):
    p = plan(spark)
    assert (p["stop_loss"], p["target1"], p["target3"], p["risk_reward"]) == (97, 103, 109, 1)
    p = plan(spark, low=95.0, zone=107.0)
    assert (p["stop_loss"], p["target1"], p["target2"], p["target3"]) == (95, 105, 107, 107)
    p = plan(spark, direction=-1, high=110.0, zone=95.0)
    assert (p["stop_loss"], p["target1"]) == (110, 95)
    assert plan(spark, atr=0.0)["plan_error"] == "ZeroRisk"


def test_simulation_tests_the_stop_first(spark):
    bars = candles(spark, [(100, 101, 99, 100), (100, 104, 96, 100)]).withColumn("rn", F.row_number().over(__import__("wickwork.functions.scalars", fromlist=["series"]).series()))
    p = bars.filter("rn = 1").select("symbol_id", "timeframe", "ts", "rn", F.lit(1).alias("direction"), F.lit(100.0).alias("entry"), F.lit(97.0).alias("stop_loss"), F.lit(103.0).alias("target1"), F.lit(106.0).alias("target2"), F.lit(109.0).alias("target3"), F.lit(None).cast("double").alias("duration_days"))
    got = backtest.simulate(p, bars).first()
    assert (got["result"], got["r_multiple"], got["holding_days"]) == ("HitStop", -1, 1)
    late = bars.filter("rn = 2").select("symbol_id", "timeframe", "ts", "rn")
    none = backtest.simulate(late.crossJoin(p.drop("symbol_id", "timeframe", "ts", "rn")), bars).first()
    assert none["result"] == "InsufficientForwardData"


def test_both_buckets_are_always_there(spark):
    t = spark.createDataFrame([("Buy", "HitTarget1", 1.0), ("Buy", "HitStop", -1.0), ("Buy", "TimedOut", 0.5)], "outcome string, result string, r_multiple double")
    got = {r["outcome"]: r for r in backtest.buckets(t).collect()}
    assert (got["StrongBuy"]["signals"], got["Buy"]["wins"], got["Buy"]["losses"], got["Buy"]["timed_out"]) == (0, 2, 1, 1)
    assert "| Buy | 3 | 3 | 2 | 1 | 1 | 66.7 % |" in report.bucket_table(backtest.buckets(t))


def test_circuit_lock_of_an_equal_close_is_lower(spark):
    c = candles(spark, [(10, 11, 9, 10), (10, 10, 10, 10), (11, 11, 11, 11)])
    assert [r["s"] for r in c.select("ts", context.circuit_state().alias("s")).orderBy("ts").collect()] == ["None", "LowerLocked", "UpperLocked"]


def test_alignment_is_over_available_timeframes(spark):
    t = spark.createDataFrame([(1, "Daily", 1), (1, "Weekly", -1), (1, "H1", 1)], "symbol_id long, timeframe string, trend int")
    p = spark.createDataFrame([(1, 1)], "symbol_id long, direction int")
    assert context.mtf_alignment(t, p).first()["alignment"] == pytest.approx(45 / 85 * 100)


def test_reconcile_actions(spark):
    fresh = candles(spark, [(10, 11, 9, 10)] * 4)
    cached = fresh.filter("ts <> date '2026-01-01'").withColumn("adj_close", F.when(F.dayofmonth("ts") == 2, 0.0).when(F.dayofmonth("ts") == 3, 9.0).otherwise(10.0))
    assert [r["action"] for r in reconcile.reconcile(cached, fresh).orderBy("ts").collect()] == ["insert", "skip", "overwrite", "keep"]


def test_upsert_and_ids(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, reconcile.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    known = spark.createDataFrame([("X", 7)], "nse_symbol string, symbol_id long")
    got = reconcile.allocate_ids(spark.createDataFrame([("X",), ("A",), ("B",)], "nse_symbol string"), known)
    assert {r["nse_symbol"]: r["symbol_id"] for r in got.collect()} == {"X": 7, "A": 8, "B": 9}


@pytest.mark.parametrize(("cls", "kw"), [
    (DecisionOptions, {"structure": 24.0}), (DecisionOptions, {"buy": 85.0}), (DecisionOptions, {"regime_override": 60.0}), (DecisionOptions, {"structure": -5.0, "trend": 50.0}), (TimeframeWeights, {"weekly": 10.0}), (QualityOptions, {"min_traded_days": 61}),
    (RiskOptions, {"stop_atr_multiple": 0.0}), (RiskOptions, {"max_sector_percent": 101.0}), (ScanOptions, {"shortlist": 0}), (ReconcileOptions, {"lookback_days": 0}), (BacktestOptions, {"cadence": 0}), (StructureOptions, {"mode": "x"}),
])
def test_options_are_validated(cls, kw):
    with pytest.raises(ValueError):
        dataclasses.replace(cls(), **kw)

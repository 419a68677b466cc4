"""What is left out of a step for what it does not read, with the results of the whole state."""

import re

from pyspark.sql import functions as F

from tests.test_indicators import candles
from tests.test_sizes import walk
from wickwork.operators import backtest, decision, indicators, persist, scan, structure
from wickwork.schema import SERIES


def several(spark, n=(150, 90, 130)):
    out = None
    for k, length in enumerate(n, 1):
        c = candles(spark, walk(length, k)).withColumn("symbol_id", F.lit(k).cast("bigint"))
        c = c.withColumn("volume", F.when(F.pmod(F.hash("ts", F.lit(k)), F.lit(7)) == 0, 900).otherwise(F.col("volume")).cast("bigint"))
        out = c if out is None else out.unionByName(c)
    return out


def index(spark):
    return candles(spark, walk(320, 9))


def rows_of(df, *columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


def test_gates_need_no_indicators_and_no_zones(spark, monkeypatch):
    c = several(spark)
    state, _ = decision.state_frame(c, index(spark))
    columns = ["symbol_id", "ts", *(f"gate_{k}" for k in decision.GATES), "hard_gate_failed"]
    want = rows_of(decision.hard_gates(state), *columns)
    for name in ("fold_indicators", "window_indicators", "patterns", "with_mitigation"):
        monkeypatch.setattr(decision, name, None)
    assert rows_of(decision.hard_gates(decision.gate_frame(c, index(spark))), *columns) == want


def test_the_last_state_is_that_of_all_candles(spark):
    c = several(spark)
    state, _ = decision.state_frame(c, index(spark))
    frame = decision.candle_frame(c, index(spark))
    last = decision.last_states(frame, decision.frame_zones(frame))
    assert rows_of(last, *state.columns) == rows_of(decision.last_rows(state), *state.columns)
    assert last.filter("live_long + live_short > 0").count() > 0


def test_early_scores_give_the_same_decisions(spark):
    c = several(spark)
    state, _ = decision.state_frame(c, index(spark))
    columns = ["symbol_id", "ts", *(f"score_{k}" for k in decision.LAYERS), "confidence", "hard_gate_failed", "outcome"]
    assert rows_of(decision.decided_frame(c, index(spark)), *columns) == rows_of(decision.decide(state), *columns)


def test_scans_and_backtests_read_indicators_of_no_candle_again(spark):
    c = several(spark)
    for result in (scan.stage1(c, index(spark)), backtest.trades(c, index(spark))):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"adx_14#\d+ > 25", plan)  # a part of the trend's score


def test_trades_are_those_of_the_whole_state(spark):
    c = several(spark, (260, 300))
    state, mitigated = decision.state_frame(c, index(spark))
    decided = decision.decide(backtest.as_of_rows(state)).filter(F.col("outcome").isin("Buy", "StrongBuy"))
    got = backtest.trades(c, index(spark))
    want = {(r["symbol_id"], r["ts"]): (r["outcome"], r["confidence"]) for r in decided.collect()}
    found = {(r["symbol_id"], r["ts"]): (r["outcome"], r["confidence"]) for r in got.collect()}
    assert found.items() <= want.items() and len(want) - len(found) <= 2  # plans without a risk are left out


def test_last_events_are_those_of_the_whole_series(spark):
    c = several(spark)
    found = 0
    for days in (0, 3, 11):  # the last candle is another one each time
        f = structure.structure_frame(c.filter(F.col("ts") <= F.date_sub(F.lit("2026-03-20").cast("date"), days))).localCheckpoint()
        z = structure.with_mitigation(structure.zones(f), f)
        last = f.groupBy(*SERIES).agg(F.max("ts").alias("ts"))
        want = rows_of(structure.events(f, z).join(last, [*SERIES, "ts"], "left_semi").distinct(), "symbol_id", "ts", "event")
        got = persist.latest_events(f, z).filter("detail = ''")
        assert rows_of(got, "symbol_id", "ts", "event_type") == want
        found += len(want)
    assert found


def test_cumulative_indicators_are_not_summed_again(spark):
    folded = indicators.fold_indicators(indicators.prepared(candles(spark, walk(150))))
    whole = indicators.window_indicators(folded, list(indicators.CUMULATIVE))
    a, b = indicators.recent_indicators(folded), indicators.recent_indicators(whole)
    columns = [x for i in indicators.REGISTRY.values() for x in i.columns]
    assert a.orderBy("rn").select(*columns).tail(5) == b.orderBy("rn").select(*columns).tail(5)
    # Candles whose look-back is cut off take no slow path by lists: they have no line.
    assert b.filter("regression is null").count() == 19 and b.filter("regression is not null").count() == indicators.RECENT - 19

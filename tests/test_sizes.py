"""What keeps the work of long tables small: narrow frames, windows for last candles alone, zones met in blocks."""

import datetime
import random

from tests.test_indicators import candles
from wickwork.config import QualityOptions
from wickwork.operators import context, decision, indicators, structure


def walk(n, seed=1):
    rng, out, p = random.Random(seed), [], 100.0
    for _ in range(n):
        p += rng.gauss(0, 1)
        o = p + rng.gauss(0, 0.5)
        out.append((o, max(o, p) + rng.random(), min(o, p) - rng.random(), p))
    return out


def test_unasked_recursions_are_not_run(monkeypatch):
    for name in ("_supertrend", "_stoch_rsi"):
        monkeypatch.setattr(indicators, name, None)
    h, lo, c = [3.0] * 40, [1.0] * 40, [2.0] * 40
    assert set(indicators.fold_series(h, lo, c, c, c, {"atr_14", "rsi_14"})) == {"atr_14", "rsi_14"}


def test_last_indicators_are_those_of_the_whole_series(spark):
    c = candles(spark, walk(150))
    columns = [x for i in indicators.REGISTRY.values() for x in i.columns]
    some = indicators.last_indicators(c)
    assert some.count() == indicators.RECENT
    assert some.orderBy("rn").select(*columns).tail(1) == indicators.indicator_frame(c).orderBy("rn").select(*columns).tail(1)


def test_decisions_carry_what_they_read(spark):
    columns = set(indicators.indicator_frame(candles(spark, walk(30)), decision.READ).columns)
    assert {"ema_20", "adx_14", "macd", "stochastic_k", "hist_vol", "volume_sma", "atr_14", "obv"} <= columns
    assert not columns & {"kijun", "supertrend", "kama_10", "cci_20", "bollinger", "regression", "stoch_rsi_k"}


def test_longest_run_without_volume(spark):
    rng, rows = random.Random(2), []
    volumes = [rng.choice((0, 0, 5, None)) for _ in range(60)] + [3] * 20
    for k, v in enumerate(volumes):
        rows.append((1, "Daily", datetime.date(2020, 1, 1) + datetime.timedelta(k), v))
    c = spark.createDataFrame(rows, "symbol_id long, timeframe string, ts date, volume long")
    got = [r["zero_run"] for r in context.quality_columns(c, QualityOptions(window=10, min_traded_days=0)).orderBy("ts").collect()]
    for k, run in enumerate(got):
        text = "".join("0" if v == 0 else "x" for v in volumes[max(0, k - 9) : k + 1] if v is not None)
        assert run == max(map(len, text.split("x")))


def test_zones_meet_their_candles_across_many_blocks(spark):
    rows = [(10.0, 11.0, 9.0, 10.0)] * 4000
    for k in (300, 2600, 3500):  # beyond a block, and beyond the blocks that all zones are held against at once
        rows[k] = (20.0 + k / 1000, 21.0 + k / 1000, 9.0, 10.0)
    frame = candles(spark, rows).selectExpr("*", "row_number() over (partition by symbol_id, timeframe order by ts) rn")
    zone = "1L symbol_id, 'Daily' timeframe, 'SupplyZone' kind, date'2020-01-01' formed_ts, date'2020-01-01' created_ts"
    top = ((1, 21.2, 20.9), (1, 23.55, 23.0), (1, 24.45, 24.0), (2602, 24.45, 24.0), (1, 50.0, 49.0), (1, 10.5, 9.5))
    z = spark.sql(" union all ".join(f"select {zone}, {r} created_rn, {u}D upper, {v}D lower" for r, u, v in top)).join(frame.select("symbol_id").distinct(), "symbol_id")
    got = {(r["created_rn"], r["upper"]): (r["partial_rn"], r["full_rn"]) for r in structure.with_mitigation(z, frame).collect()}
    assert got == {(1, 21.2): (301, 301), (1, 23.55): (2601, 2601), (1, 24.45): (3501, 3501), (2602, 24.45): (3501, 3501), (1, 50.0): (None, None), (1, 10.5): (2, 2)}


def test_the_state_moves_wide_rows_once(spark, monkeypatch):
    plans = {}
    kept = decision.staged
    monkeypatch.setattr(decision, "staged", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), kept(df, name))[1])
    c = candles(spark, walk(120))
    state, _ = decision.state_frame(c, c)
    assert plans["state"].split("+- Union")[0].count("Exchange") == 1 and "Join" not in plans["state"].split("Union")[0]
    assert state.count() == 120

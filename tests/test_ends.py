"""The last states, live zones and impulse legs of two ordered passes against those of the frame of all candles."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_indicators import candles
from tests.test_narrow import index, rows_of, several
from tests.test_sizes import walk
from wickwork.config import EngineOptions, StructureOptions
from wickwork.operators import decision, ends, indicators, scan, structure
from wickwork.schema import SERIES
from wickwork.sources import derived


def test_series_ends_are_those_of_all_candles(spark):
    c = several(spark, (150, 90, 130, 12, 1))
    c = c.unionByName(candles(spark, walk(80, 7)).withColumn("symbol_id", F.lit(9).cast("bigint")).withColumn("close", F.when(F.dayofyear("ts") != 75, F.col("close"))))
    bands = spark.createDataFrame([(1, 0.05)], "symbol_id long, band double")
    for o in (EngineOptions(structure=StructureOptions(mode="as_wired")), EngineOptions(structure=StructureOptions(absorption_multiple=1.1, absorption_max_body=101.0))):
        frame = decision.candle_frame(c, index(spark), o, bands=bands)
        mitigated = decision.frame_zones(frame)
        want = decision.last_states(frame, mitigated, o)
        state, zones, kept = ends.series_ends(c, index(spark), o, bands=bands)
        read = [x for x in state.columns if not x.startswith("leg_")]
        assert state.count() == 6 and rows_of(state, *read) == rows_of(want, *read)
        columns = ("symbol_id", "kind", "created_rn", "full_rn", "upper", "lower")
        assert rows_of(zones, *columns) == rows_of(mitigated.filter(~F.col("kind").startswith("Fvg")), *columns)
        legs = [x.filter("kind = 'Impulse'") for x in (structure.legs(kept), structure.legs(frame))]
        assert rows_of(legs[0], *legs[0].columns) == rows_of(legs[1], *legs[0].columns)
    assert want.filter("has_absorption").count() and zones.filter("full_rn is null").count()


def test_scans_write_no_frame_of_all_candles(spark, monkeypatch):
    for name in ("candle_frame", "frame_zones", "last_states"):
        monkeypatch.setattr(scan, name, None)
    assert scan.stage1(several(spark), index(spark)).count() == 3


def test_long_series_go_by_blocks(spark, monkeypatch):
    c = several(spark)
    want = rows_of(scan.stage1(c, index(spark)), "symbol_id", "outcome", "confidence", "target1", "duration_days", "reasoning")
    monkeypatch.setattr(ends, "BLOCK", 100)
    assert {r["symbol_id"] for r in ends.long_series_of(c).collect()} == {1, 3}
    assert rows_of(scan.stage1(c, index(spark)), "symbol_id", "outcome", "confidence", "target1", "duration_days", "reasoning") == want


def test_one_step_of_many_series_is_the_fold_of_each():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 13, 14, 15, 27, 28, 29, 60, 200])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    close = 100 + rng.integers(-3, 4, lengths.sum()).cumsum() / 7.0
    high, low = close + rng.integers(0, 4, len(close)) / 3, close - rng.integers(0, 4, len(close)) / 4
    tr = high - low
    atr, last = ends.fold_step(high, low, close, tr, starts, lengths)
    for k, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        part = slice(a, a + n)
        want = indicators.fold_series(high[part].tolist(), low[part].tolist(), close[part].tolist(), [1] * n, tr[part].tolist(), {"atr_14", *ends.LAST})
        assert [None if np.isnan(x) else x for x in atr[part].tolist()] == want["atr_14"]
        for name, (x, known) in last.items():
            assert (x[k] if known[k] else None) == want[name][-1], (name, n)


def test_passes_cut_batches_at_series_and_refuse_parts():
    rn = pa.array([*range(1, 8), *range(1, 3), *range(1, 12)], pa.int32())
    batches = pa.table({"rn": rn}).to_batches(max_chunksize=3)
    found = [(t.num_rows, s.tolist()) for t, s in ends.whole_series(batches, 4)]
    assert sum(n for n, _ in found) == 20 and sum(len(s) for _, s in found) == 3 and len(found) > 1
    for broken in ([2, 3], [1, 2, 4], [1, 2, 3, 2]):
        with pytest.raises(ValueError):
            list(ends.whole_series(pa.table({"rn": pa.array(broken, pa.int32())}).to_batches()))


def test_candles_are_moved_once(spark):
    plan = derived.daily_candles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and SERIES[0] in plan

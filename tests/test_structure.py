import datetime
import re

import pytest

from tests.test_indicators import candles
from wickwork.config import StructureOptions
from wickwork.operators import patterns, structure
from wickwork.plans import catalog
from wickwork.schema import CANDLES
from wickwork.sources import derived

SF = "/root/testdata/sf0.001"


def test_fractal_needs_strict_extremes(spark):
    rows = [(9, h, 8, 9) for h in (10, 11, 15, 12, 10)]
    got = structure.swings(structure.structure_frame(candles(spark, rows))).collect()
    assert [(r["swing"], r["price"], r["ts"].day, r["confirmed_ts"].day) for r in got] == [("High", 15.0, 3, 5)]
    tie = [(9, h, 8, 9) for h in (10, 15, 15, 12, 10)]
    assert structure.swings(structure.structure_frame(candles(spark, tie))).count() == 0


def test_break_of_structure_then_change_of_character(spark):
    rows = [(9, h, 8, 9) for h in (10, 11, 15, 12, 10)] + [(9, 17, 9, 16), (16, 17, 5, 16), (16, 17, 14, 16), (16, 17, 14, 15), (15, 16, 3, 4)]
    got = structure.breaks(structure.structure_frame(candles(spark, rows))).orderBy("ts").collect()
    assert [(r["kind"], r["direction"]) for r in got] == [("BOS", 1), ("CHoCH", -1)]


@pytest.mark.parametrize(("rows", "name"), [
    ([(10, 12, 8, 10.1)], "Doji"), ([(10, 20, 10, 20)], "Marubozu"), ([(10, 10.6, 5, 10.5)], "PinBar"), ([(10, 10, 10, 10)], "Doji"),
    ([(12, 13, 9, 10), (9, 14, 8, 13)], "EngulfingBullish"), ([(10, 13, 9, 12), (13, 14, 8, 9)], "EngulfingBearish"),
    ([(10, 16, 9, 15), (13, 14, 12, 12)], "Harami"), ([(10, 16, 9, 15), (13, 14, 12, 13)], "InsideBar"), ([(13, 14, 12, 13), (10, 16, 9, 15)], "OutsideBar"),
    ([(20, 20.5, 9.5, 10), (8, 10, 7, 8.5), (9, 17, 8.5, 16)], "MorningStar"), ([(10, 20.5, 9.5, 20), (22, 24, 21, 22.5), (21, 21.5, 13, 14)], "EveningStar"),
    ([(10, 12.1, 9.9, 12), (11, 14.1, 10.9, 14), (13, 16.1, 12.9, 16)], "ThreeWhiteSoldiers"), ([(16, 16.1, 13.9, 14), (15, 15.1, 11.9, 12), (13, 13.1, 9.9, 10)], "ThreeBlackCrows"),
])
def test_patterns(spark, rows, name):
    got = patterns.pattern_rows(candles(spark, rows)).filter(f"ts = date '2026-01-01' + {len(rows) - 1}")
    assert name in {r["pattern"] for r in got.collect()}


def test_wired_mode_never_fires_what_needs_same_bar_averages(spark):
    c = derived.daily_candles(spark, SF)
    o = StructureOptions(mode="as_wired")
    f = structure.structure_frame(c, o)
    assert structure.exhaustion(f, o).count() == 0
    assert structure.false_breakouts(f, o).count() == 0


def test_zone_is_not_mitigated_by_its_own_candle(spark):
    rows = [(10, 11, 9, 10), (10, 13, 10, 13), (14, 15, 13, 14), (14, 14.5, 12, 13), (13, 14, 8, 9)]
    f = structure.structure_frame(candles(spark, rows))
    z = structure.with_mitigation(structure.fvg_zones(f), f).collect()
    assert [(r["kind"], r["lower"], r["upper"], r["partial_rn"], r["full_rn"]) for r in z] == [("FvgBullish", 11.0, 13.0, 4, 5)]


def test_empty_table(spark):
    f = structure.structure_frame(spark.createDataFrame([], CANDLES))
    assert structure.events(f, structure.with_mitigation(structure.zones(f), f)).count() == 0


def test_every_query_has_sql_or_says_why():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_dates_are_dates(spark):
    assert isinstance(derived.daily_candles(spark, SF).first()["ts"], datetime.date)


def test_structure_needs_one_sort_alone(spark):
    """Breaks, ranges and legs are windows over the series in one order: none sorts the candles again by a key of its own."""
    f = structure.structure_frame(candles(spark, [(10 + k % 3, 11 + k % 5, 8 - k % 4, 9 + k % 2) for k in range(30)]))
    for made in (f, structure.gap_events(f)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert set(re.findall(r"windowspecdefinition\(symbol_id#\d+L?, timeframe#\d+, (\w+)#", plan)) == {"ts"}
        assert "Union" not in plan

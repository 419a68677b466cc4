import json

import pytest

from tests.test_indicators import candles
from wickwork.sources import readers
from wickwork.sources.store import Store


def test_chart_json(spark, tmp_path):
    quote = {"open": [10.0, None, 10.0], "high": [11.0, 11.0, 9.0], "low": [9.0, 9.0, 9.5], "close": [10.5, 10.0, 10.0], "volume": [5, 6, 7]}
    body = {"chart": {"result": [{"meta": {"symbol": "A.NS"}, "timestamp": [86400, 172800, 259200], "indicators": {"quote": [quote], "adjclose": [{"adjclose": [None, 1.0, 1.0]}]}}], "error": None}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    got = readers.chart_json(spark, str(tmp_path / "a.json")).collect()
    assert [(r["symbol"], r["close"], r["adj_close"], r["volume"]) for r in got] == [("A.NS", 10.5, 10.5, 5)]
    with pytest.raises(ValueError):
        readers.chart_json(spark, str(tmp_path / "a.json"), "H1")
    (tmp_path / "b.json").write_text(json.dumps({"chart": {"result": None, "error": {"code": "Not Found", "description": "x"}}}))
    (tmp_path / "c.json").write_text('{"chart": {"result": [')
    (tmp_path / "d.json").write_text("{}")
    rows, failures = readers.chart_responses(spark, str(tmp_path))
    assert [r["symbol"] for r in rows.collect()] == ["A.NS"]
    found = {r["source"][-6:]: (r["code"], r["message"]) for r in failures.collect()}
    assert found == {"b.json": ("Not Found", "x"), "c.json": ("Malformed", "the response is no JSON object"), "d.json": ("Empty", "the response has no result")}


def test_broker_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": {"candles": [["2024-01-01T09:15:00+0530", 10, 11, 9, 10.5, 100], ["2024-01-01T09:30:00+0530", 10, 11]]}}))
    assert [r["adj_close"] for r in readers.broker_json(spark, str(tmp_path / "a.json"), "M15").collect()] == [10.5]


def test_universe_and_bands_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Company Name,INDUSTRY,symbol\nAcme,Steel,ACME\n,,\n")
    assert [tuple(r) for r in readers.universe_csv(spark, str(tmp_path / "u.csv")).collect()] == [("ACME", "Acme", "Steel")]
    (tmp_path / "x.csv").write_text("Name\nA\n")
    with pytest.raises(ValueError):
        readers.universe_csv(spark, str(tmp_path / "x.csv"))
    (tmp_path / "b.csv").write_text('Symbol,Series,Security Name,Band,Remarks\nabc,BE,"A, Ltd",5,\nABC,EQ,"A, Ltd",20,\nD,BE,D,No Band,\nE,BE,E,10,\nE,BZ,E,2,\n')
    assert {r["symbol"]: r["band"] for r in readers.circuit_bands_csv(spark, str(tmp_path / "b.csv")).collect()} == {"ABC": 0.2, "E": 0.1}


def test_store_upserts_candles(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.get("candles").count() == 0
    s.put("candles", candles(spark, [(10, 11, 9, 10), (10, 11, 9, 10)]))
    s.put("candles", candles(spark, [(10, 11, 9, 10.5)]))
    got = s.candles(1, "Daily").orderBy("ts").collect()
    assert [r["close"] for r in got] == [10.5, 10.0]


def test_a_put_writes_only_what_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=8)
    rows = [candles(spark, [(10, 11, 9, 10)] * 3, symbol=k) for k in range(1, 6)]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])
    first = s.put("candles", every)
    assert 1 < first <= 5 and s.put("candles", every) == 0 and s.versions("candles") == [1]
    assert s.put("candles", candles(spark, [(10, 11, 9, 10), (10, 11, 9, 10.5)], symbol=2)) == 1
    assert s.candles(2).count() == 3 and s.candles(2, "Daily").filter("close = 10.5").count() == 1 and s.candles(2, "Weekly").count() == 0
    assert s.get("candles").count() == 15
    files = list((tmp_path / "store/candles/data").rglob("*.parquet"))
    assert len({f.parent for f in files if f.parent.parent.name == "2"}) == 1
    (tmp_path / "store/candles/data/3/bucket=Daily-0").mkdir(parents=True)  # a run that died
    assert s.get("candles").count() == 15


def test_null_keys_and_repeats(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(None, None, "a", "x"), (None, None, "a", "x"), (1, None, "b", None)], "symbol_id long, as_of_date date, flag_type string, detail string")
    assert s.put("quality_flags", rows) == 2 and s.put("quality_flags", rows) == 0
    assert s.get("quality_flags").count() == 2

import datetime

from wickwork.streaming.bars import closed_bars


def test_closed_bars_come_once_and_late_rows_are_dropped(spark, tmp_path):
    def rows(hours):
        t = datetime.datetime(2024, 1, 1)
        return [(t + datetime.timedelta(hours=h), k, 1, float(k)) for k, h in enumerate(hours)]

    schema = "ts timestamp, event_id long, user_id long, value double"
    for k, hours in enumerate(([0, 0.5, 1, 5], [0.2, 9], [20])):
        spark.createDataFrame(rows(hours), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        bars = closed_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = bars.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, k
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r["ts"].hour, r["volume"], r["open"], r["close"]) for r in got] == [(0, 2, 0.0, 1.0), (1, 1, 2.0, 2.0), (5, 1, 3.0, 3.0), (9, 1, 1.0, 1.0)]

"""The engine's own tables, as Parquet in buckets: a put rewrites the buckets whose rows change, and no others."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork import schema
from wickwork.functions.staging import discard, staged
from wickwork.operators.reconcile import upsert

TABLES = {
    "symbols": schema.SYMBOLS, "symbol_mapping": schema.SYMBOL_MAPPING, "universe_snapshots": schema.UNIVERSE_SNAPSHOTS, "universe_members": schema.UNIVERSE_MEMBERS, "candles": schema.CANDLES, "quality_flags": schema.QUALITY_FLAGS,
    "indicator_values": schema.INDICATOR_VALUES, "structure_events": schema.STRUCTURE_EVENTS, "analysis": schema.ANALYSIS, "trade_signals": schema.TRADE_SIGNALS, "scan_history": schema.SCAN_HISTORY,
}
KEYS = {
    "symbols": ["symbol_id"], "symbol_mapping": ["symbol_id", "provider", "effective_from"], "universe_snapshots": ["snapshot_id"], "universe_members": ["snapshot_id", "symbol_id"], "candles": ["symbol_id", "timeframe", "ts"],
    "quality_flags": ["symbol_id", "as_of_date", "flag_type"], "indicator_values": ["symbol_id", "timeframe", "ts", "indicator_key"], "structure_events": ["symbol_id", "timeframe", "ts", "event_type", "detail"],
    "analysis": ["analysis_id"], "trade_signals": ["signal_id"], "scan_history": ["scan_id"],
}


class Store:
    """Tables under one root, in ``buckets`` by a hash of the first key, candles by timeframe as well.

    A version names, for every bucket, the version that last wrote it; it is one small file that is put in place by a
    rename, so readers see whole versions, and a run that died leaves only files that no version names. A put meets stored
    rows only in the buckets it touches, and writes only those in which some row is new or differs: the same rows put again
    change nothing. Keys with nulls equal each other.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def _current(self, name: str) -> tuple[int, dict[str, int]]:
        """The newest version and the version of each bucket."""
        v = self.versions(name)
        if not v:
            return 0, {}
        fs, p = self._fs(f"{self.root}/{name}/versions/{v[-1]}")
        stream = fs.open(p)
        try:
            return v[-1], json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, version: int, held: dict[str, int]) -> None:
        folder = f"{self.root}/{name}/versions"
        fs, draft = self._fs(f"{folder}/.{version}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"{folder}/{version}")[1]):
            raise RuntimeError(f"version {version} of {name} was written by another run")

    def _bucket(self, name: str):
        """The bucket of a row, as the name of its folder."""
        b = F.pmod(F.xxhash64(KEYS[name][0]), F.lit(self.buckets)).cast("string")
        return F.concat_ws("-", "timeframe", b) if name == "candles" else b

    def _read(self, name: str, held: dict[str, int]) -> DataFrame:
        columns = [x.split()[0] for x in TABLES[name].split(", ")]
        if not held:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{name}/data/{v}/bucket={b}" for b, v in sorted(held.items()))).select(*columns)

    def get(self, name: str) -> DataFrame:
        """The current version; an empty table before the first."""
        return self._read(name, self._current(name)[1])

    def put(self, name: str, rows: DataFrame) -> int:
        """Upsert by the table's key; returns the number of buckets written."""
        version, held = self._current(name)
        columns, keys = [x.split()[0] for x in TABLES[name].split(", ")], KEYS[name]
        rows = staged(rows.select(*columns).dropDuplicates(keys), name)
        touched = [r[0] for r in rows.select(self._bucket(name)).distinct().collect()]  # at most the buckets
        old = self._read(name, {b: v for b, v in held.items() if b in touched})
        key = F.struct(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys))
        mine, theirs = rows.withColumn("_key", key), old.select(key.alias("_key"), F.struct(*columns).alias("_old"))
        same = F.struct(*columns).eqNullSafe(F.col("_old"))
        changed = mine.join(theirs, "_key", "left").filter(~same).select(*columns)
        stale = [r[0] for r in changed.select(self._bucket(name)).distinct().collect()]
        if not stale:
            discard(rows)
            return 0
        kept = self._read(name, {b: v for b, v in held.items() if b in stale}).withColumn("_key", key)
        fresh = mine.filter(self._bucket(name).isin(stale))
        out = upsert(kept, fresh, ["_key"]).drop("_key").withColumn("bucket", self._bucket(name))
        sort = [k for k in ("timeframe", "symbol_id", "ts") if k in columns]
        out = out.repartition("bucket").sortWithinPartitions("bucket", *sort)
        out.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{name}/data/{version + 1}")
        self._publish(name, version + 1, held | dict.fromkeys(stale, version + 1))
        discard(rows)
        return len(stale)

    def candles(self, symbol_id: int | None = None, timeframe: str | None = None, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
        _, held = self._current("candles")
        if timeframe is not None:
            held = {b: v for b, v in held.items() if b.rpartition("-")[0] == timeframe}
        if symbol_id is not None:
            own = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(symbol_id).cast("bigint")), F.lit(self.buckets))).first()[0]
            held = {b: v for b, v in held.items() if b.rpartition("-")[2] == str(own)}
        out = self._read("candles", held)
        for col, op, value in (("timeframe", "=", timeframe), ("symbol_id", "=", symbol_id), ("ts", ">=", start), ("ts", "<=", end)):
            if value is not None:
                c = F.col(col)
                out = out.filter(c == value if op == "=" else c >= F.lit(value) if op == ">=" else c <= F.lit(value))
        return out

    def active_symbols(self) -> DataFrame:
        return self.get("symbols").filter("is_active").orderBy("nse_symbol")

    def latest_universe(self) -> DataFrame:
        snap = self.get("universe_snapshots").orderBy(F.desc("effective_date"), F.desc("snapshot_id")).limit(1)
        return self.get("universe_members").join(snap.select("snapshot_id"), "snapshot_id", "left_semi")

    def last_runs(self, n: int) -> DataFrame:
        return self.get("scan_history").orderBy(F.desc("run_at"), F.desc("scan_id")).limit(n)

    def benchmark_report(self, n: int) -> DataFrame:
        """Runs and mean durations of the last ``n`` scans, each stage by itself."""
        return self.last_runs(n).agg(F.count("*").alias("runs"), F.avg("stage1_duration_ms").alias("stage1_ms"), F.avg("stage2_duration_ms").alias("stage2_ms"))

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a session on one machine gets one of its own; a cluster must name it."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (conf.get("spark.master", "") + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="wickwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage and survives lost executors.

    Results are lazy and may read such a table until the session ends; then the folder goes, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(f"{path}/{name}")
    out.staged_at = path
    return out


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with all columns but ``keep`` in one struct, which windows carry along as it is."""
    return df.select(*keep, F.struct(*(c for c in df.columns if c not in keep)).alias("_packed"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "_packed"), "_packed.*")


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: those an iteration has replaced."""
    for t in tables:
        fs, folder = _folder(t.sparkSession, t.staged_at)
        fs.delete(folder, True)

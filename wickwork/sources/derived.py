"""Candles and dimensions derived from the star-schema tables: an integer-cent walk per supplier, and an event tape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of each supplier as a symbol; prices are exact cents."""
    order = Window.partitionBy("symbol_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    cents = lambda c: F.round(F.lit(100) * F.col(c)).cast("bigint")
    t = table(spark, sf_dir, "lineitem").withColumns({"symbol_id": F.col("l_suppkey").cast("bigint"), "tx": cents("l_tax"), "dc": cents("l_discount"), "q": F.col("l_quantity").cast("bigint")})
    t = t.withColumn("r", F.col("tx") - F.col("dc") + 1)
    # Both windows name one column, so rows are moved and sorted once.
    t = t.withColumns({"k": F.row_number().over(order), "s": F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    t = t.withColumns({"px": 20000 + 25 * F.col("s"), "op": 20000 + 25 * (F.col("s") - F.col("r")) + 4 * (F.col("q") - 25), "ts": F.to_date("l_shipdate")})
    g = t.groupBy("symbol_id", "ts").agg(F.min_by("op", "k").alias("o"), F.max("px").alias("mx"), F.min("px").alias("mn"), F.max_by("px", "k").alias("c"), F.max("tx").alias("tx"), F.max("dc").alias("dc"), (100 * F.sum("q")).alias("v"))
    price = lambda c: c / F.lit(100.0)
    return g.select(
        "symbol_id", F.lit("Daily").alias("timeframe"), "ts", price(F.col("o")).alias("open"), price(F.greatest("o", "mx") + 5 * F.col("tx")).alias("high"), price(F.least("o", "mn") - 5 * F.col("dc")).alias("low"),
        price(F.col("c")).alias("close"), price(F.col("c")).alias("adj_close"), F.col("v").cast("bigint").alias("volume"),
    )


def benchmark_candles(daily: DataFrame) -> DataFrame:
    """An index: the mean of all symbols' prices a day, in integer cents, as symbol 0."""
    mean = lambda c: F.floor(F.sum(F.round(F.col(c) * 100).cast("bigint")) / F.count("*")) / F.lit(100.0)
    return daily.groupBy("timeframe", "ts").agg(*(mean(c).alias(c) for c in ("open", "high", "low", "close", "adj_close")), F.sum("volume").alias("volume")).select(F.lit(0).cast("bigint").alias("symbol_id"), "timeframe", "ts", "open", "high", "low", "close", "adj_close", "volume")


def intraday_candles(spark: SparkSession, sf_dir: str, timeframe: str = "H1") -> DataFrame:
    """Intraday candles of each user's events as a symbol."""
    width = {"H1": "1 hour", "M30": "30 minutes", "M15": "15 minutes"}[timeframe]
    e = table(spark, sf_dir, "events").withColumn("w", F.window("ts", width)["start"])
    key = F.struct("ts", "event_id")
    g = e.groupBy(F.col("user_id").cast("bigint").alias("symbol_id"), F.col("w").alias("ts")).agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume"))
    return g.select("symbol_id", F.lit(timeframe).alias("timeframe"), "ts", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as symbols; their nation is the sector."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").cast("bigint").alias("symbol_id"), F.concat(F.lit("SYM"), F.col("s_suppkey").cast("string")).alias("nse_symbol"), F.col("s_name").alias("company_name"), F.col("n_name").alias("sector"), (F.col("s_suppkey") % 10 != 0).alias("is_active"))

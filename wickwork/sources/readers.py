"""Readers of provider files: chart JSON, positional broker JSON, universe and circuit-band CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.operators.bars import validate
from wickwork.operators.context import best_bands

_QUOTE = "struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>"
CHART = f"chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<{_QUOTE}>,adjclose:array<struct<adjclose:array<double>>>>>>,error:struct<code:string,description:string>>"


def chart_responses(spark: SparkSession, path: str, timeframe: str = "Daily", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candles, failures) of chart responses, one a file, or one a line with ``lines``.

    Candles: symbol, timeframe, ts and prices; parallel arrays by place, bars with a null or invalid left out. Failures:
    source (file), code and message of every response that is an error or no response at all; they end no read.
    """
    if timeframe not in ("Daily", "Weekly"):
        raise ValueError(f"the chart provider has no {timeframe} candles")
    raw = spark.read.schema(f"{CHART}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("multiLine", not lines).json(path)
    raw = raw.select("chart", "_broken", F.input_file_name().alias("source"))
    empty = F.coalesce(F.size("chart.result"), F.lit(-1)) < 1
    failed = F.col("_broken").isNotNull() | F.col("chart.error").isNotNull() | empty
    code = F.when(F.col("_broken").isNotNull(), "Malformed").otherwise(F.coalesce("chart.error.code", F.lit("Empty")))
    message = F.when(F.col("_broken").isNotNull(), F.lit("the response is no JSON object")).otherwise(F.coalesce("chart.error.description", F.lit("the response has no result")))
    failures = raw.filter(failed).select("source", code.alias("code"), message.alias("message"))
    r = raw.filter(~failed).select(F.explode("chart.result").alias("r")).select("r.meta.symbol", "r.timestamp", F.get("r.indicators.quote", F.lit(0)).alias("q"), F.get("r.indicators.adjclose", F.lit(0))["adjclose"].alias("a"))
    r = r.withColumn("a", F.coalesce("a", F.array().cast("array<double>")))
    z = r.select("symbol", F.inline(F.arrays_zip("timestamp", F.col("q.open").alias("open"), F.col("q.high").alias("high"), F.col("q.low").alias("low"), F.col("q.close").alias("close"), F.col("q.volume").alias("volume"), F.col("a").alias("adj"))))
    z = z.dropna(subset=["timestamp", "open", "high", "low", "close", "volume"])
    out = z.select("symbol", F.lit(timeframe).alias("timeframe"), F.timestamp_seconds("timestamp").alias("ts"), "open", "high", "low", "close", F.coalesce("adj", "close").alias("adj_close"), "volume")
    return validate(out).filter(F.col("invalid_reason").isNull()).drop("invalid_reason"), failures


def chart_json(spark: SparkSession, path: str, timeframe: str = "Daily") -> DataFrame:
    """The candles of all chart responses that hold some; ``chart_responses`` gives the failures beside them."""
    return chart_responses(spark, path, timeframe)[0]


INTERVALS = {"Weekly": "week", "Daily": "day", "H1": "60minute", "M30": "30minute", "M15": "15minute"}


def broker_json(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """timeframe, ts and prices of broker responses: positional arrays of six or more; the close stands for adj_close."""
    INTERVALS[timeframe]
    raw = spark.read.schema("data struct<candles:array<array<string>>>").option("multiLine", True).json(path)
    c = raw.select(F.explode("data.candles").alias("c")).filter(F.size("c") >= 6)
    num = lambda i: F.expr(f"try_cast(c[{i}] as double)")
    out = c.select(F.lit(timeframe).alias("timeframe"), F.expr("try_cast(c[0] as timestamp)").alias("ts"), num(1).alias("open"), num(2).alias("high"), num(3).alias("low"), num(4).alias("close"), num(4).alias("adj_close"), num(5).cast("bigint").alias("volume"))
    return validate(out.dropna()).filter(F.col("invalid_reason").isNull()).drop("invalid_reason")


def universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """nse_symbol, company_name, sector; the header is matched without regard to case."""
    raw = spark.read.option("header", True).csv(path)
    at = {c.strip().lower(): c for c in raw.columns}
    if "symbol" not in at:
        raise ValueError("the universe file has no Symbol column")
    col = lambda name: F.trim(F.col(f"`{at[name]}`")) if name in at else F.lit(None).cast("string")
    out = raw.select(col("symbol").alias("nse_symbol"), col("company name").alias("company_name"), col("industry").alias("sector")).filter(F.col("nse_symbol") != "")
    if out.isEmpty():
        raise ValueError("the universe file has no rows")
    return out


def circuit_bands_csv(spark: SparkSession, path: str) -> DataFrame:
    """symbol, band (a fraction): one row a symbol, series EQ before others, else the first line."""
    raw = spark.read.option("header", True).option("quote", '"').csv(path)
    names = raw.columns[:4]
    rows = raw.select(F.col(f"`{names[0]}`").alias("symbol"), F.col(f"`{names[1]}`").alias("series"), F.col(f"`{names[3]}`").alias("band"), F.monotonically_increasing_id().alias("line_no"))
    return best_bands(rows)

"""Scalar column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from wickwork.schema import CONFIRMATION_ONLY, PRIMARY, SERIES


def series() -> WindowSpec:
    """One candle series, oldest first."""
    return Window.partitionBy(*SERIES).orderBy("ts")


def last_n(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, -1)


def ratio(a: Column, b: Column, fallback=None) -> Column:
    """a / b, and ``fallback`` where b is 0."""
    return F.when(b == 0, F.lit(fallback).cast("double")).otherwise(a / b)


def r4(c: Column) -> Column:
    """Four decimals; what lies on a half within a ten-thousandth of a unit goes up, so that any engine agrees."""
    return F.floor(c * 10000 + 0.5001).cast("double") / 10000


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def direction(close: Column, value: Column) -> Column:
    """Bullish above, Bearish below, else Neutral; Neutral before the first value."""
    return F.when(close > value, "Bullish").when(close < value, "Bearish").otherwise("Neutral")


def sign(c: Column) -> Column:
    return F.when(c > 0, "Bullish").when(c < 0, "Bearish").otherwise("Neutral")


def ladder(c: Column, high: float, low: float, middle: float) -> Column:
    """Overbought from ``high``, Oversold to ``low``, else by ``middle``; Neutral for null."""
    return F.when(c >= high, "Overbought").when(c <= low, "Oversold").when(c >= middle, "Bullish").when(c < middle, "Bearish").otherwise("Neutral")


def is_primary(c: Column) -> Column:
    return c.isin(*PRIMARY)


def is_confirmation_only(c: Column) -> Column:
    return c.isin(*CONFIRMATION_ONLY)


def exchange_symbol(c: Column) -> Column:
    """The symbol with ``.NS`` at its end, whichever case it has."""
    return F.when(F.upper(c).endswith(".NS"), c).otherwise(F.concat(c, F.lit(".NS")))


def exchange_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "Asia/Kolkata")


def text_facts(*facts: Column) -> Column:
    """Facts that are not null, each ended by a stop, in one text."""
    kept = F.filter(F.array(*facts), lambda f: f.isNotNull())
    return F.array_join(F.transform(kept, lambda f: F.concat(F.rtrim(f), F.lit("."))), " ")

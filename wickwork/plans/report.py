"""Report texts of backtests and scans: a few bucket rows, or trades written as CSV by the cluster."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("SymbolId", "NseSymbol", "AsOfDate", "Decision", "ConfidenceScore", "Direction", "Entry", "StopLoss", "Target1", "Target2", "Target3", "RiskRewardRatio", "ResultKind", "ExitPrice", "ExitDate", "HoldingTradingDays", "RMultiple")


def fixed(x: float, digits: int = 2) -> str:
    return str(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def bucket_table(buckets: DataFrame) -> str:
    """The Markdown table of the two buckets."""
    head = ["| Decision | Signals | Simulated | Wins | Losses | Timed out | Win rate | Avg R | Expected R/signal |", "|---|---|---|---|---|---|---|---|---|"]
    rows = {r["outcome"]: r for r in buckets.collect()}  # two rows
    return "\n".join(head + [f"| {k} | {r['signals']} | {r['simulated']} | {r['wins']} | {r['losses']} | {r['timed_out']} | {fixed(100 * r['win_rate'], 1)} % | {fixed(r['avg_r'])} | {fixed(r['expected_r'])} |" for k in ("StrongBuy", "Buy") if (r := rows.get(k))])


def trade_csv(trades: DataFrame, symbols: DataFrame) -> DataFrame:
    """Trades as text columns in the order of the report file; write with ``.write.option("header", True).csv``."""
    two = lambda c: F.format_number(F.col(c), "0.00")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    t = trades.join(symbols.select("symbol_id", "nse_symbol"), "symbol_id", "left")
    cols = (F.col("symbol_id").cast("string"), F.col("nse_symbol"), day("ts"), F.col("outcome"), two("confidence"), F.when(F.col("entry") >= F.col("stop_loss"), "Bullish").otherwise("Bearish"), two("entry"), two("stop_loss"), two("target1"), two("target2"), two("target3"), two("risk_reward"), F.col("result"), two("exit_price"), day("exit_ts"), F.col("holding_days").cast("string"), two("r_multiple"))
    return t.select(*(c.alias(n) for c, n in zip(cols, CSV_COLUMNS, strict=True)))


def scan_lines(ranked: DataFrame, n: int = 20) -> list[str]:
    """The first ``n`` rows of a ranked scan as text."""
    rows = ranked.orderBy("rank").limit(n).collect()
    return [f"{r['symbol_id']} {r['outcome']} {fixed(r['confidence'], 1)} {fixed(r['risk_reward']) if r['risk_reward'] is not None else 'N/A'}" for r in rows]

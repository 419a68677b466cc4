"""Schemas of the engine's tables."""

from __future__ import annotations

CANDLES = "symbol_id bigint, timeframe string, ts date, open double, high double, low double, close double, adj_close double, volume bigint"
SYMBOLS = "symbol_id bigint, nse_symbol string, company_name string, sector string, is_active boolean"
SYMBOL_MAPPING = "symbol_id bigint, provider string, external_id string, effective_from date, effective_to date"
UNIVERSE_SNAPSHOTS = "snapshot_id bigint, effective_date date, index_name string, source_document string"
UNIVERSE_MEMBERS = "snapshot_id bigint, symbol_id bigint"
QUALITY_FLAGS = "symbol_id bigint, as_of_date date, flag_type string, detail string"
INDICATOR_VALUES = "symbol_id bigint, timeframe string, ts date, indicator_key string, value double, signal_state string"
STRUCTURE_EVENTS = "symbol_id bigint, timeframe string, ts date, event_type string, detail string"
ANALYSIS = "analysis_id bigint, symbol_id bigint, as_of_date date, decision string, confidence double, layer_scores_json string, reasoning_text string, hard_gate_failed string"
TRADE_SIGNALS = "signal_id bigint, analysis_id bigint, entry double, stop_loss double, target1 double, target2 double, target3 double, risk_percent double, risk_reward_ratio double, invalidation_level string"
SCAN_HISTORY = "scan_id bigint, run_at timestamp, stage1_count int, stage2_count int, stage1_duration_ms bigint, stage2_duration_ms bigint"

TIMEFRAMES = ("Daily", "Weekly", "H1", "M30", "M15")
PRIMARY = ("Daily", "Weekly")
CONFIRMATION_ONLY = ("H1", "M30", "M15")
SERIES = ["symbol_id", "timeframe"]

"""Options of every operator, with their defaults, validated when built."""

from __future__ import annotations

from dataclasses import dataclass, field


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class StructureOptions:
    impulse_atr_multiple: float = 1.5
    impulse_bos_lookahead: int = 3
    range_min_candles: int = 10
    trap_lookahead: int = 3
    absorption_multiple: float = 2.0
    absorption_max_body: float = 30.0
    exhaustion_atr_multiple: float = 2.0
    exhaustion_outer: float = 0.2
    gap_min_trend_legs: int = 3
    gap_reversal_lookahead: int = 5
    #: "as_specified": ATR and volume mean of the same bar are known; "as_wired": they are not.
    mode: str = "as_specified"

    def __post_init__(self):
        _require(self.mode in ("as_specified", "as_wired"), "mode is as_specified or as_wired")
        _require(min(self.range_min_candles, self.trap_lookahead, self.gap_reversal_lookahead) >= 1, "look-aheads are positive")


@dataclass(frozen=True)
class PatternOptions:
    doji_max_body: float = 10.0
    marubozu_min_body: float = 90.0
    pin_max_body: float = 33.0
    pin_min_wick: float = 66.0
    pin_max_other_wick: float = 10.0
    star_small_body: float = 30.0
    soldier_min_body: float = 60.0


@dataclass(frozen=True)
class QualityOptions:
    window: int = 60
    min_traded_days: int = 30
    max_zero_run: int = 10
    band_tolerance: float = 0.002

    def __post_init__(self):
        _require(self.window > 0 and 0 <= self.min_traded_days <= self.window, "min_traded_days fits the window")
        _require(self.max_zero_run >= 0 and self.band_tolerance >= 0, "limits are not negative")


@dataclass(frozen=True)
class TimeframeWeights:
    weekly: float = 40.0
    daily: float = 35.0
    h1: float = 10.0
    m30: float = 8.0
    m15: float = 7.0

    def __post_init__(self):
        w = (self.weekly, self.daily, self.h1, self.m30, self.m15)
        _require(min(w) >= 0 and abs(sum(w) - 100) <= 0.01, "timeframe weights are not negative and sum to 100")

    def items(self) -> tuple[tuple[str, float], ...]:
        return (("Weekly", self.weekly), ("Daily", self.daily), ("H1", self.h1), ("M30", self.m30), ("M15", self.m15))


@dataclass(frozen=True)
class DecisionOptions:
    structure: float = 25.0
    trend: float = 20.0
    momentum: float = 15.0
    volume: float = 15.0
    volatility: float = 10.0
    psychology: float = 5.0
    support: float = 5.0
    strength: float = 5.0
    strong_buy: float = 80.0
    buy: float = 65.0
    watch: float = 50.0
    hold: float = 35.0
    sell: float = 20.0
    regime_override: float = 90.0

    def __post_init__(self):
        w = (self.structure, self.trend, self.momentum, self.volume, self.volatility, self.psychology, self.support, self.strength)
        _require(min(w) >= 0, "layer weights are not negative")
        _require(abs(sum(w) - 100) <= 0.01, "layer weights sum to 100")
        t = (self.strong_buy, self.buy, self.watch, self.hold, self.sell)
        _require(all(a > b for a, b in zip(t, t[1:], strict=False)), "outcome thresholds descend")
        _require(self.regime_override >= self.buy, "the regime override is at least the Buy threshold")


@dataclass(frozen=True)
class RiskOptions:
    stop_atr_multiple: float = 1.5
    min_legs_for_duration: int = 3
    leg_months: int = 6
    max_positions: int = 10
    max_sector_percent: float = 25.0
    max_correlated: int = 3
    correlation: float = 0.7

    def __post_init__(self):
        _require(self.stop_atr_multiple > 0 and self.max_positions > 0 and self.max_correlated > 0, "risk limits are positive")
        _require(0 < self.max_sector_percent <= 100 and 0 < self.correlation <= 1, "risk shares are in range")


@dataclass(frozen=True)
class ScanOptions:
    shortlist: int = 30
    history_years: int = 2
    intraday_days: int = 30

    def __post_init__(self):
        _require(self.shortlist > 0 and self.history_years > 0 and self.intraday_days > 0, "scan sizes are positive")


@dataclass(frozen=True)
class ReconcileOptions:
    lookback_days: int = 90
    tolerance: float = 0.001

    def __post_init__(self):
        _require(self.lookback_days > 0 and self.tolerance >= 0, "reconciliation limits are in range")


@dataclass(frozen=True)
class BacktestOptions:
    cadence: int = 10
    min_bars: int = 60
    default_horizon: int = 40

    def __post_init__(self):
        _require(min(self.cadence, self.min_bars, self.default_horizon) > 0, "backtest sizes are positive")


@dataclass(frozen=True)
class EngineOptions:
    structure: StructureOptions = field(default_factory=StructureOptions)
    patterns: PatternOptions = field(default_factory=PatternOptions)
    quality: QualityOptions = field(default_factory=QualityOptions)
    weights: TimeframeWeights = field(default_factory=TimeframeWeights)
    decision: DecisionOptions = field(default_factory=DecisionOptions)
    risk: RiskOptions = field(default_factory=RiskOptions)
    scan: ScanOptions = field(default_factory=ScanOptions)
    reconcile: ReconcileOptions = field(default_factory=ReconcileOptions)
    backtest: BacktestOptions = field(default_factory=BacktestOptions)

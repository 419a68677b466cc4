"""The registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickwork.functions.scalars import r4
from wickwork.functions.staging import packed, staged, unpacked
from wickwork.operators import backtest, bars, context, decision, indicators, patterns, reconcile, risk, scan, structure, walks
from wickwork.plans import oracle as O
from wickwork.schema import SERIES
from wickwork.sources import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r4(F.col(c)) for c in cols})


_BARS = f"{O.CANDLES}, {O.bars('c', 'b')}"
_FRAME = f"{O.STRUCTURE}"
_ZONES = f"{O.STRUCTURE}, {O.ZONES}"
_DECIDED = f"{O.STATE}, {O.DECIDED}"
_PRICES = "open, high, low, close, adj_close, volume"


@_add("bars_daily", O.q(O.CANDLES, f"select symbol_id, timeframe, ts, {_PRICES} from c"))
def bars_daily(spark, d):
    return derived.daily_candles(spark, d)


@_add("bars_weekly", O.q(f"{O.CANDLES}, {O.WEEKLY}", f"select symbol_id, timeframe, ts, {_PRICES} from wk"))
def bars_weekly(spark, d):
    return bars.resample(derived.daily_candles(spark, d))


@_add("bars_validate", O.q(f"{O.CANDLES}, e as (select *, case when dayofmonth(ts) = 3 then low - 1 else high end h2, case when dayofmonth(ts) = 5 then -volume else volume end v2 from c)", "select symbol_id, ts, case when h2 < low then 'high_below_low' when open < low or open > h2 then 'open_outside_range' when close < low or close > h2 then 'close_outside_range' when v2 < 0 then 'negative_volume' end invalid_reason from e"))
def bars_validate(spark, d):
    """Candles with a planted fault on two days of a month."""
    c = derived.daily_candles(spark, d)
    day = F.dayofmonth("ts")
    c = c.withColumns({"high": F.when(day == 3, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(day == 5, -F.col("volume")).otherwise(F.col("volume"))})
    return bars.validate(c).select("symbol_id", "ts", "invalid_reason")


@_add("derived_values", O.q(_BARS, f"select symbol_id, timeframe, ts, {O.r4('tp')} typical, {O.r4('(high+low)/2')} median, {O.r4('tr')} true_range, {O.r4('log_ret')} log_return, {O.r4('coalesce(open-close_1, 0)')} gap, {O.r4('abs(close-open)')} body, {O.r4('high-greatest(open, close)')} upper_wick, {O.r4('least(open, close)-low')} lower_wick, {O.r4(O._body('open', 'high', 'low', 'close'))} body_pct, {O.r4('(high-low)*100/open')} range_pct from b"))
def derived_values(spark, d):
    v = bars.derived_values(derived.daily_candles(spark, d))
    return _rounded(v, *[c for c in v.columns if c not in (*SERIES, "ts")])


_NAMES = {
    "sma": "SMA_20", "sma_50": "SMA_50", "ema": "EMA_20", "ema_50": "EMA_50", "wma": "WMA_20", "hma": "HMA_20", "vwma": "VWMA_20", "dema": "DEMA_20", "tema": "TEMA_20", "kama": "KAMA_10", "regression_channel": "RegressionChannel_20", "donchian": "Donchian_20",
    "ichimoku": "Ichimoku_9_26_52", "supertrend": "SuperTrend_14_3", "rsi": "RSI_14", "macd": "MACD_12_26_9", "stochastic": "Stochastic_14_3", "adx": "ADX_14", "stoch_rsi": "StochRSI_14_14_3", "cci": "CCI_20", "roc": "ROC_12", "williams_r": "WilliamsR_14",
    "trix": "TRIX_15", "atr": "ATR_14", "stddev": "StdDev_20", "bollinger": "BollingerBands_20_2", "hist_vol": "HistVol_20", "keltner": "KeltnerChannel_20", "range_compression": "RangeCompressionExpansion_20", "obv": "OBV", "volume_sma": "VolumeSMA_20",
    "volume_spike": "VolumeSpike_20_2", "vwap": "VWAP", "rolling_vwap": "RollingVWAP_20", "cmf": "CMF_20", "mfi": "MFI_14", "volume_ema": "VolumeEMA_20",
}
for _name, _key in _NAMES.items():
    _add(_name, O.indicator_sql(_key))(lambda spark, d, key=_key: indicators.indicator(derived.daily_candles(spark, d), key, rounded=True))


_SECOND = {"Stochastic_14_3": "stochastic_d is not null", "StochRSI_14_14_3": "stoch_rsi_d is not null", "MACD_12_26_9": "macd_signal is not null", "OBV": "n >= 5"}


def _snapshot_sql(columns: str) -> str:
    """The last row of every indicator, one under another."""
    parts = []
    for key, i in indicators.REGISTRY.items():
        first = i.columns[0]
        conf = f"case when {first} is null or not ({_SECOND.get(key, 'true')}) then 0e0 else {'case when n >= 52 then 1e0 else 0.5e0 end' if key.startswith('Ichimoku') else '1e0'} end"
        last = f"select *, count(*) over (partition by symbol_id) n, max(ts) over (partition by symbol_id) last_ts from ({O.indicator_sql(key)})"
        rows = f"select symbol_id, timeframe, ts, '{key}' indicator_key, cast({first} as double) as value, signal signal_state, {conf} confidence, n from ({last}) where ts = last_ts"
        parts.append(f"select *, case when n < {i.warm} or confidence = 0 then 'InsufficientData' else 'Ok' end health from ({rows})")
    return f"select {columns} from ({' union all '.join(parts)})"


def _snapshot(spark, d):
    """Signals are those of the rounded values."""
    frame = indicators.last_indicators(derived.daily_candles(spark, d))
    return indicators.snapshot(_rounded(frame, *(c for i in indicators.REGISTRY.values() for c in i.columns)))


@_add("indicator_snapshot", _snapshot_sql("symbol_id, timeframe, ts, indicator_key, value"))
def indicator_snapshot(spark, d):
    """The latest value of every indicator."""
    return _snapshot(spark, d).select(*SERIES, "ts", "indicator_key", "value")


@_add("indicators_all", _snapshot_sql("symbol_id, timeframe, ts, indicator_key, value, signal_state, confidence, health"))
def indicators_all(spark, d):
    """The latest value, signal, confidence and health of every indicator."""
    return _snapshot(spark, d)


@_add("candle_patterns", O.q(f"{_BARS}, {O.PATTERNS}", "select symbol_id, 'Daily' timeframe, ts, unnest(patterns) pattern from pt"))
def candle_patterns(spark, d):
    return patterns.pattern_rows(derived.daily_candles(spark, d))


@_add("candle_metrics", O.q(f"{_BARS}, {O._ATR}, x as (select b.*, atr.v atr_14, case when b.rn >= 20 then avg(volume) over {O.over(20).replace('symbol_id order', 'b.symbol_id order')} end vs from b left join atr on atr.symbol_id = b.symbol_id and atr.rn = b.rn)",
    f"select symbol_id, timeframe, ts, {O.r4(O._body('open', 'high', 'low', 'close'))} body_pct, {O.r4(O._ratio('(high - greatest(open, close))*100', 'high - low', '0'))} upper_wick_pct, {O.r4(O._ratio('(least(open, close) - low)*100', 'high - low', '0'))} lower_wick_pct, {O.r4('case when atr_14 > 0 then (high - low)/atr_14 end')} range_to_atr, {O.r4('case when vs > 0 then volume/vs end')} relative_volume, {O.r4(O._ratio('close - low', 'high - low', '0.5'))} close_location from x"))
def candle_metrics(spark, d):
    f = indicators.window_indicators(indicators.fold_indicators(indicators.prepared(derived.daily_candles(spark, d)), ("atr_14",)), ["VolumeSMA_20"])
    cols = ("body_pct", "upper_wick_pct", "lower_wick_pct", "range_to_atr", "relative_volume", "close_location")
    return _rounded(patterns.metrics(f), *cols).select(*SERIES, "ts", *cols)


def _frame(spark, d):
    return structure.structure_frame(derived.daily_candles(spark, d))


def _zoned(spark, d):
    f = staged(_frame(spark, d), "frame")
    return f, structure.with_mitigation(structure.zones(f), f)


@_add("swings", O.q(_FRAME, "select symbol_id, timeframe, swing_ts ts, ts confirmed_ts, swing, swing_price price, hl is_higher_or_lower from lg where swing is not null"))
def swings(spark, d):
    return structure.swings(_frame(spark, d))


@_add("structure_breaks", O.q(_FRAME, "select symbol_id, timeframe, ts, break_kind kind, break_dir direction, broken_price, close from lg where break_dir is not null"))
def structure_breaks(spark, d):
    return structure.breaks(_frame(spark, d))


@_add("range_state", O.q(_FRAME, "select symbol_id, timeframe, ts, cast(range_run as bigint) range_run, is_ranging, trend from lg"))
def range_state(spark, d):
    return _frame(spark, d).select(*SERIES, "ts", F.col("range_run").cast("bigint").alias("range_run"), "is_ranging", "trend")


@_add("price_legs", O.q(_FRAME, "select symbol_id, timeframe, st start_ts, ts end_ts, sc start_price, close end_price, leg_kind kind, leg_dir direction from lg where leg_kind is not null"))
def price_legs(spark, d):
    return structure.legs(_frame(spark, d))


_ZONE_COLS = "symbol_id, timeframe, kind, formed_ts, created_ts, upper, lower"


@_add("fvg_zones", O.q(_ZONES, f"select {_ZONE_COLS} from zn where kind like 'Fvg%'"))
def fvg_zones(spark, d):
    return structure.fvg_zones(_frame(spark, d)).drop("created_rn")


@_add("order_blocks", O.q(_ZONES, f"select {_ZONE_COLS} from zn where kind not like 'Fvg%'"))
def order_blocks(spark, d):
    return structure.leg_zones(_frame(spark, d)).drop("created_rn")


@_add("zone_mitigation", O.q(_ZONES, f"select {_ZONE_COLS}, cast(partial_rn as bigint) partial_rn, cast(full_rn as bigint) full_rn, case when full_rn is not null then 'FullyMitigated' when partial_rn is not null then 'PartiallyMitigated' else 'Fresh' end status from zm"))
def zone_mitigation(spark, d):
    _, z = _zoned(spark, d)
    return z.withColumns({"partial_rn": F.col("partial_rn").cast("bigint"), "full_rn": F.col("full_rn").cast("bigint"), "status": structure.zone_status()}).drop("created_rn")


def _event_query(name: str, sql: str, make) -> None:
    _add(name, O.q(_ZONES, sql))(make)


_event_query("liquidity_grabs", O.GRABS, lambda s, d: structure.liquidity_grabs(_frame(s, d)))
_event_query("traps", O.TRAPS, lambda s, d: structure.traps(_frame(s, d)))
_event_query("false_breakouts", O.FALSE_BREAKS, lambda s, d: structure.false_breakouts(_frame(s, d)))
_event_query("volume_absorption", O.ABSORPTION, lambda s, d: structure.volume_absorption(*_zoned(s, d)))
_event_query("exhaustion", O.EXHAUSTION, lambda s, d: structure.exhaustion(_frame(s, d)))
_event_query("gap_events", O.GAPS, lambda s, d: structure.gap_events(_frame(s, d)))


@_add("chart_markers", O.q(f"{_ZONES}, {O.EVENTS}", "select symbol_id, timeframe, marker, strftime(ts, '%Y-%m-%d') \"time\" from (select symbol_id, timeframe, swing_ts ts, 'Swing' || swing marker from lg where swing is not null union all select symbol_id, timeframe, ts, break_kind || case when break_dir = 1 then 'Bullish' else 'Bearish' end from lg where break_dir is not null union all select symbol_id, timeframe, ts, event from ev)"))
def chart_markers(spark, d):
    f, z = _zoned(spark, d)
    return reconcile.chart_markers(f, staged(z, "zones"))


def _thinned(spark, d):
    """Candles with planted faults: some symbols without volume on most days, and days left out."""
    c = derived.daily_candles(spark, d)
    c = c.withColumn("volume", F.when((F.col("symbol_id") % 9 == 0) & (F.dayofmonth("ts") > 6), 0).otherwise(F.col("volume")))
    return c.filter((F.col("symbol_id") * 31 + F.datediff("ts", F.lit("1990-01-01"))) % 50 != 0)


_THIN = f"{O.CANDLES}, d2 as materialized (select symbol_id, timeframe, ts, case when symbol_id % 9 = 0 and dayofmonth(ts) > 6 then 0 else volume end volume from c where (symbol_id*31 + (ts - date '1990-01-01')) % 50 <> 0), cal as (select distinct ts as day from c)"


def _calendar(spark, d):
    """Every day on which any symbol was traded."""
    return derived.daily_candles(spark, d).select(F.col("ts").alias("day")).distinct()


@_add("missing_days", O.q(_THIN, "select s.symbol_id, s.timeframe, cal.day from (select symbol_id, timeframe, min(ts) a, max(ts) z from d2 group by all) s join cal on cal.day between s.a and s.z where not exists (select 1 from d2 where d2.symbol_id = s.symbol_id and d2.ts = cal.day)"))
def missing_days(spark, d):
    return context.missing_days(_thinned(spark, d), _calendar(spark, d))


@_add("quality_gate", O.q(f"{_THIN}, k as materialized (select *, row_number() over (partition by symbol_id order by ts desc) k from d2), r as materialized (select * from k where k <= 60), i as (select *, sum(case when volume > 0 then 1 else 0 end) over (partition by symbol_id order by ts rows unbounded preceding) isl from r), z as (select symbol_id, isl, count(*) n from i where volume = 0 group by all), m as (select s.symbol_id, count(*) n from (select symbol_id, min(ts) a, max(ts) z from r group by 1) s join cal on cal.day between s.a and s.z where not exists (select 1 from d2 where d2.symbol_id = s.symbol_id and d2.ts = cal.day) group by 1)",
    "select symbol_id, traded_days, zero_run, n_missing, traded_days >= 30 and zero_run <= 10 and n_missing = 0 passed from (select r.symbol_id, cast(count(case when volume > 0 then 1 end) as bigint) traded_days, cast(coalesce((select max(n) from z where z.symbol_id = r.symbol_id), 0) as bigint) zero_run, cast(coalesce((select max(n) from m where m.symbol_id = r.symbol_id), 0) as bigint) n_missing from r group by r.symbol_id)"))
def quality_gate(spark, d):
    g = context.quality_gate(_thinned(spark, d), _calendar(spark, d))
    return g.select("symbol_id", F.col("traded_days").cast("bigint").alias("traded_days"), F.col("zero_run").cast("bigint").alias("zero_run"), F.col("n_missing").cast("bigint").alias("n_missing"), "passed")


_LOCK = f"{O.CANDLES}, f as (select symbol_id, timeframe, ts, open, case when dayofmonth(ts) = 9 then close else high end high, case when dayofmonth(ts) = 9 then close else low end low, close, lag(close) over {O.W} pc from c)"


@_add("circuit_state", O.q(_LOCK, "select symbol_id, timeframe, ts, case when pc is null then 'None' when high = low and low = close then case when close > pc then 'UpperLocked' else 'LowerLocked' end when (close - pc)/pc >= 0.02e0 - 0.002e0 then 'UpperLocked' when (close - pc)/pc <= -(0.02e0 - 0.002e0) then 'LowerLocked' else 'None' end state from f"))
def circuit_state(spark, d):
    """Candles whose ninth of a month is locked, under a band of two percent."""
    c, lock = derived.daily_candles(spark, d), F.dayofmonth("ts") == 9
    c = c.withColumns({"high": F.when(lock, F.col("close")).otherwise(F.col("high")), "low": F.when(lock, F.col("close")).otherwise(F.col("low"))})
    return c.select(*SERIES, "ts", context.circuit_state(F.lit(0.02)).alias("state"))


_WEEKLY_TREND = f"{O.CANDLES}, {O.bars('c', 'b')}, {O.swings('b')}, {O.breaks()}, {O.WEEKLY}, {O.bars('wk', 'wb')}, {O.swings('wb', 'w')}, {O.breaks('w')}"


@_add("mtf_alignment", O.q(f"{_WEEKLY_TREND}, dt as (select symbol_id, arg_max(trend, ts) t from br group by 1), wt as (select symbol_id, arg_max(trend, ts) t from wbr group by 1), j as (select dt.symbol_id, dt.t d, wt.t w, case when dt.t = -1 then -1 else 1 end p from dt join wt using (symbol_id))", f"select symbol_id, cast(2 as bigint) timeframes, {O.r4('(case when d = p then 35e0 else 0e0 end + case when w = p then 40e0 else 0e0 end)*100/75e0')} alignment from j"))
def mtf_alignment(spark, d):
    daily = derived.daily_candles(spark, d)
    trends = context.last_trend(daily).unionByName(context.last_trend(bars.resample(daily)))
    proposed = trends.filter("timeframe = 'Daily'").select("symbol_id", F.when(F.col("trend") == -1, -1).otherwise(1).alias("direction"))
    return _rounded(context.mtf_alignment(trends, proposed), "alignment")


@_add("regime", O.q(f"{O.CANDLES}, {O.INDEX}, {O.REGIME}", "select ts, regime from rgm"))
def regime(spark, d):
    return context.market_states(derived.benchmark_candles(derived.daily_candles(spark, d)))


@_add("relative_strength", O.q(f"{O.CANDLES}, {O.INDEX}, {O.STRENGTH}", f"select symbol_id, timeframe, ts, {O.r4('rs_short')} rs_short, {O.r4('rs_long')} rs_long from rx"))
def relative_strength(spark, d):
    daily = derived.daily_candles(spark, d)
    return _rounded(context.relative_strength(daily, derived.benchmark_candles(daily)), "rs_short", "rs_long")


def _daily(spark, d):
    """The daily candles and their index, each written once: both are read from many sides."""
    daily = staged(derived.daily_candles(spark, d), "candles")
    return daily, staged(derived.benchmark_candles(daily), "index")


_SCORES = ", ".join(f"{O.r4(f'score_{k}')} score_{k}" for k in decision.LAYERS)


@_add("layer_scores", O.q(f"{_DECIDED}, {O.LAST}", f"select symbol_id, ts, {_SCORES}, {O.r4('confidence')} confidence from lst"))
def layer_scores(spark, d):
    s = walks.last_scores(*_daily(spark, d))
    cols = [f"score_{k}" for k in decision.LAYERS] + ["confidence"]
    return _rounded(s, *cols).select("symbol_id", "ts", *cols)


@_add("hard_gates", O.q(_DECIDED, "select symbol_id, ts, g1 gate_data, g2 gate_circuit, g3 gate_regime, g4 gate_break, gate hard_gate_failed from dec"))
def hard_gates(spark, d):
    g = decision.hard_gates(decision.gate_frame(*_daily(spark, d)))
    return g.select("symbol_id", "ts", *(F.col(f"gate_{k}").alias(n) for k, n in zip(decision.GATES, ("gate_data", "gate_circuit", "gate_regime", "gate_break"), strict=True)), "hard_gate_failed")


@_add("decision", O.q(_DECIDED, f"select symbol_id, ts, direction, regime, gate hard_gate_failed, {O.r4('confidence')} confidence, outcome from dec"))
def decision_query(spark, d):
    return _rounded(walks.decided_frame(*_daily(spark, d)), "confidence").select("symbol_id", "ts", "direction", "regime", "hard_gate_failed", "confidence", "outcome")


@_add("decision_as_wired", O.q(f"{O.as_wired(O.STATE)}, {O.DECIDED}", f"select symbol_id, ts, direction, gate hard_gate_failed, {O.r4('confidence')} confidence, outcome from dec"))
def decision_as_wired(spark, d):
    """Decisions when structure and metrics do not know the candle's own ATR and volume mean."""
    from wickwork.config import EngineOptions, StructureOptions

    o = EngineOptions(structure=StructureOptions(mode="as_wired"))
    return _rounded(walks.decided_frame(*_daily(spark, d), o), "confidence").select("symbol_id", "ts", "direction", "hard_gate_failed", "confidence", "outcome")


_PLAN_COLS = "close entry, stop stop_loss, target1, target2, target3, risk/close risk_percent, abs(target1 - close)/risk risk_reward, dur duration_days"
_PLAN_ROUNDED = ", ".join(f"{O.r4(c)} {c}" for c in scan.PLAN)


@_add("trade_plan", O.q(f"{_DECIDED}, {O.plans('dec')}", f"select symbol_id, ts, direction, {_PLAN_ROUNDED} from (select symbol_id, ts, direction, {_PLAN_COLS} from pln)"))
def trade_plan(spark, d):
    p = risk.trade_plan(risk.plan_inputs(*walks.walked(*_daily(spark, d), lambda rows: rows.withColumn("_asked", F.lit(True))))).filter(F.col("plan_error").isNull())
    return _rounded(p, *scan.PLAN).select("symbol_id", "ts", "direction", *scan.PLAN)


_BOOK = f"{O.CANDLES}, rt as materialized (select symbol_id, close/lag(close) over {O.W} - 1 x, row_number() over (partition by symbol_id order by ts desc) k from c), nn as (select s_suppkey symbol_id, n_name sector, cast(1000*(1 + s_suppkey % 5) as double) capital from supplier join nation on s_nationkey = n_nationkey)"


@_add("portfolio_limits", O.q(f"{_BOOK}, held as (select * from nn where symbol_id <= 8), cand as (select * from nn where symbol_id > 8), al as (select a.symbol_id, count(*) n from (select c.symbol_id, h.symbol_id hid, corr(x.x, y.x) r from cand c, held h, rt x, rt y where x.symbol_id = c.symbol_id and y.symbol_id = h.symbol_id and x.k = y.k and x.k <= 60 group by all) a where r > 0.7 group by 1), tt as (select count(*) n, sum(capital) t from held)",
    f"select c.symbol_id, {O.r4('(coalesce((select sum(capital) from held h where h.sector = c.sector), 0) + c.capital)/((select t from tt) + c.capital)*100')} sector_percent, coalesce(al.n, 0) correlated, concat_ws(',', case when (select n from tt) + 1 > 10 then 'MaxPositions' end, case when (coalesce((select sum(capital) from held h where h.sector = c.sector), 0) + c.capital)/((select t from tt) + c.capital)*100 > 25 then 'SectorConcentration' end, case when coalesce(al.n, 0) + 1 > 3 then 'CorrelatedExposure' end) breaches from cand c left join al using (symbol_id)"))
def portfolio_limits(spark, d):
    """Symbols above 8 as candidates against positions in the first 8; the last 60 daily returns of each."""
    daily = derived.daily_candles(spark, d)
    w = Window.partitionBy("symbol_id")
    ret = daily.select("symbol_id", "ts", (F.col("close") / F.lag("close").over(w.orderBy("ts")) - 1).alias("x"), F.row_number().over(w.orderBy(F.desc("ts"))).alias("k")).filter("k <= 60")
    ret = ret.groupBy("symbol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("returns"))
    book = derived.symbols(spark, d).join(ret, "symbol_id").withColumn("capital", (1000 * (1 + F.col("symbol_id") % 5)).cast("double"))
    p = risk.portfolio_limits(book.filter("symbol_id > 8"), book.filter("symbol_id <= 8"))
    return _rounded(p, "sector_percent").withColumn("breaches", F.array_join("breaches", ","))


_SCAN_SQL = f"{_DECIDED}, {O.LAST}, {O.plans('lst')}, sc as (select l.symbol_id, l.ts, l.direction, l.regime, l.gate hard_gate_failed, l.outcome, l.confidence, l.score_momentum, l.score_trend, l.score_strength, p.close entry, p.stop stop_loss, p.target1, abs(p.target1 - p.close)/p.risk risk_reward, coalesce(l.gate = 'DataQuality', false) excluded from lst l left join pln p using (symbol_id))"
_SCAN_COLS = ("confidence", "entry", "stop_loss", "target1", "risk_reward")
_SCAN_OUT = "symbol_id, ts, direction, outcome, " + ", ".join(f"{O.r4(c)} {c}" for c in _SCAN_COLS)


def _scanned(spark, d):
    daily, index = _daily(spark, d)
    return scan.stage1(daily, index), daily


@_add("scan_stage1", O.q(_SCAN_SQL, f"select {_SCAN_OUT}, excluded from sc"))
def scan_stage1(spark, d):
    return _rounded(_scanned(spark, d)[0], *_SCAN_COLS).select("symbol_id", "ts", "direction", "outcome", *_SCAN_COLS, "excluded")


@_add("scan_shortlist", O.q(_SCAN_SQL, f"select {_SCAN_OUT} from sc where not excluded order by sc.confidence desc, symbol_id limit 30"))
def scan_shortlist(spark, d):
    return _rounded(scan.shortlist(_scanned(spark, d)[0]), *_SCAN_COLS).select("symbol_id", "ts", "direction", "outcome", *_SCAN_COLS)


_RANK = "row_number() over (order by confidence desc, score_momentum desc, score_trend desc, coalesce(risk_reward, 0) desc, coalesce(abs(target1 - entry)/entry, 0) desc, score_strength desc, symbol_id)"


@_add("scan_ranked", O.q(f"{_SCAN_SQL}, sh as (select * from sc where not excluded order by confidence desc, symbol_id limit 30)", f"select {_SCAN_OUT}, cast({_RANK} as integer) rank from sh"))
def scan_ranked(spark, d):
    s, daily = _scanned(spark, d)
    listed = scan.stage2(staged(scan.shortlist(s), "shortlist"), daily, bars.resample(daily))
    return _rounded(scan.ranked(listed), *_SCAN_COLS).select("symbol_id", "ts", "direction", "outcome", *_SCAN_COLS, "rank")


def _intraday_sql(name: str, bucket: str) -> str:
    """Bars of events, with swings and breaks."""
    key = "(ts, event_id)"
    made = f"select cast(user_id as bigint) symbol_id, '{name}' timeframe, {bucket} ts, arg_min(value, {key}) open, max(value) high, min(value) low, arg_max(value, {key}) as close, arg_max(value, {key}) adj_close, count(*) volume from events group by user_id, {bucket}"
    return f"{name} as materialized ({made}), {O.bars(name, f'{name}b')}, {O.swings(f'{name}b', name)}, {O.breaks(name)}"


_INTRADAY = {"h1": ("H1", "date_trunc('hour', ts)", "symbol_id % 5 <> 0 and symbol_id % 7 <> 0"), "m30": ("M30", "time_bucket(interval '30 minutes', ts)", "symbol_id % 7 <> 0"), "m15": ("M15", "time_bucket(interval '15 minutes', ts)", "symbol_id % 7 <> 0")}
_TRENDS = "select symbol_id, 'Daily' tf, 35e0 w, trend t from lst union all select symbol_id, 'Weekly', 40e0, arg_max(trend, ts) from wbr group by 1" + "".join(
    f" union all select symbol_id, '{tf}', {w}e0, arg_max(trend, ts) from {name}br where {kept} group by 1" for (name, (tf, _, kept)), w in zip(_INTRADAY.items(), (10, 8, 7), strict=True)
)


@_add("scan_stage2", O.q(
    f"{_SCAN_SQL}, {O.WEEKLY}, {O.bars('wk', 'wb')}, {O.swings('wb', 'w')}, {O.breaks('w')}, {', '.join(_intraday_sql(n, b) for n, (_, b, _) in _INTRADAY.items())}, tf as ({_TRENDS}), sh as (select * from sc where not excluded order by confidence desc, symbol_id limit 30)",
    f"select sh.symbol_id, {O.r4('sum(case when t = direction then w else 0 end)*100/sum(w)')} alignment, count(*) timeframes, case when count(case when tf in ('H1', 'M30', 'M15') then 1 end) > 0 then 'Stage2' else 'Stage1Only' end stage from sh join tf using (symbol_id) group by sh.symbol_id",
))
def scan_stage2(spark, d):
    """Stage 2 over all timeframes: some symbols have no H1 candles, and some no intraday candles at all."""
    s, daily = _scanned(spark, d)
    intraday = derived.intraday_candles(spark, d, "H1").filter("symbol_id % 5 <> 0")
    for tf in ("M30", "M15"):
        intraday = intraday.unionByName(derived.intraday_candles(spark, d, tf))
    listed = scan.stage2(staged(scan.shortlist(s), "shortlist"), daily, bars.resample(daily), intraday.filter("symbol_id % 7 <> 0"))
    return _rounded(listed, "alignment").select("symbol_id", "alignment", "timeframes", "stage")


#: A planted calendar of few days: a symbol without a candle on one of them within its last 60 candles misses it.
_MARKET_DAYS = f"""cal as (select distinct ts as day from c where (ts - date '1990-01-01') % 211 = 0),
w60 as (select symbol_id, ts, coalesce(lag(ts, 59) over {O.W}, min(ts) over (partition by symbol_id)) a from c),
ms as materialized (select w.symbol_id, w.ts, count(*) n_missing from w60 w join cal on cal.day between w.a and w.ts
 left join c x on x.symbol_id = w.symbol_id and x.ts = cal.day where x.ts is null group by all)"""


def _replaced(text: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        if old not in text:
            raise ValueError(f"no {old!r} in the statement")
        text = text.replace(old, new)
    return text


_DECIDED_BY_DAYS = _replaced(
    O.DECIDED, ("traded_days >= 30 g1", "traded_days >= 30 and n_missing = 0 g1"),
    (" from ste)", " from (select ste.*, coalesce(ms.n_missing, 0) n_missing from ste left join ms using (symbol_id, ts)))"),
)


def _market_days(spark, d):
    day = F.datediff("day", F.lit("1990-01-01"))
    return _calendar(spark, d).filter(day % 211 == 0)


@_add("missing_days_asof", O.q(f"{O.CANDLES}, {_MARKET_DAYS}", "select c.symbol_id, c.ts, coalesce(ms.n_missing, 0) n_missing from c left join ms using (symbol_id, ts)"))
def missing_days_asof(spark, d):
    """Days of the calendar that the last 60 candles miss, as of every candle."""
    from wickwork.config import QualityOptions

    return context.with_missing(derived.daily_candles(spark, d), _market_days(spark, d), QualityOptions()).select("symbol_id", "ts", "n_missing")


@_add("hard_gates_by_days", O.q(f"{O.STATE}, {_MARKET_DAYS}, {_DECIDED_BY_DAYS}", "select symbol_id, ts, g1 gate_data, gate hard_gate_failed, outcome from dec"))
def hard_gates_by_days(spark, d):
    """Gates and outcomes of every candle against a calendar."""
    s = walks.decided_frame(*_daily(spark, d), calendar=_market_days(spark, d))
    return s.select("symbol_id", "ts", F.col("gate_DataQuality").alias("gate_data"), "hard_gate_failed", "outcome")


_BANDED = _replaced(O.STATE, (
    "else 'None' end circuit",
    "when symbol_id % 4 = 0 and (close - close_1)/close_1 >= 0.02e0 - 0.002e0 then 'UpperLocked' when symbol_id % 4 = 0 and (close - close_1)/close_1 <= -(0.02e0 - 0.002e0) then 'LowerLocked' else 'None' end circuit",
))


@_add("scan_universe", O.q(
    f"{_replaced(_SCAN_SQL, (O.STATE, _BANDED), (O.DECIDED, f'{_MARKET_DAYS}, {_DECIDED_BY_DAYS}'))}",
    f"select {_SCAN_OUT}, hard_gate_failed, excluded from sc where symbol_id % 3 <> 0",
))
def scan_universe(spark, d):
    """Stage 1 over the members of a universe, with circuit bands of some symbols and the market's calendar."""
    daily, index = _daily(spark, d)
    s = derived.symbols(spark, d)
    members = s.filter("symbol_id % 3 <> 0")
    bands = s.filter("symbol_id % 4 = 0").select("symbol_id", F.lit(0.02).alias("band"))
    rows = scan.stage1(daily, index, members=members, bands=bands, calendar=_market_days(spark, d))
    return _rounded(rows, *_SCAN_COLS).select("symbol_id", "ts", "direction", "outcome", *_SCAN_COLS, "hard_gate_failed", "excluded")


@_add("backtest_by_days", O.q(f"{O.STATE}, {_MARKET_DAYS}, {_DECIDED_BY_DAYS}, {O.TRADES}", f"select symbol_id, ts, outcome, result, exit_ts, {O.r4('r')} r_multiple from trd"))
def backtest_by_days(spark, d):
    """The walk-forward trades with the calendar in the quality gate."""
    t = backtest.trades(*_daily(spark, d), calendar=_market_days(spark, d))
    return _rounded(t, "r_multiple").select("symbol_id", "ts", "outcome", "result", "exit_ts", "r_multiple")


_FAILING = "symbol_id % 5 = 0 and dayofmonth(ts) = 7"


@_add("scan_failures", O.q(
    f"{_SCAN_SQL}, bad as (select symbol_id, min(ts) bd from c where {_FAILING} group by 1)",
    f"select sc.symbol_id, case when bad.bd is null then outcome end outcome, case when bad.bd is null then {O.r4('confidence')} end confidence, bad.bd is not null or excluded excluded, 'Failed: null close on ' || bad.bd failure from sc left join bad using (symbol_id)",
))
def scan_failures(spark, d):
    """Stage 1 over candles of which some have no close: their series are excluded with a message, the others are whole."""
    daily, index = _daily(spark, d)
    broken = daily.withColumn("close", F.when(~F.expr(_FAILING), F.col("close")))
    s = _rounded(scan.stage1(broken, index), "confidence")
    return s.select("symbol_id", "outcome", "confidence", "excluded", F.when(F.col("reasoning").startswith("Failed: "), F.col("reasoning")).alias("failure"))


@_add("read_failures", O.q(O.CANDLES,
    "select 'candles' kind, 'SYM' || symbol_id as name, count(*) n from c where symbol_id % 7 <> 0 and symbol_id % 11 <> 0 group by 2 "
    "union all select 'failure', 'Not Found: no data', count(distinct symbol_id) from c where symbol_id % 7 = 0 having count(*) > 0 "
    "union all select 'failure', 'Malformed: the response is no JSON object', count(distinct symbol_id) from c where symbol_id % 7 <> 0 and symbol_id % 11 = 0 having count(*) > 0",
))
def read_failures(spark, d):
    """Provider responses of every symbol, some of them errors and some cut short: what was read, and what failed."""
    import uuid

    from wickwork.functions.staging import shared_dir
    from wickwork.sources.readers import chart_responses

    bars_ = F.sort_array(F.collect_list(F.struct(F.unix_timestamp("ts").alias("timestamp"), "open", "high", "low", "close", "adj_close", "volume"))).alias("b")
    c = derived.daily_candles(spark, d).groupBy("symbol_id").agg(bars_)
    part = lambda name: F.col(f"b.{name}").alias(name)
    indicators_ = F.struct(F.array(F.struct(*(part(x) for x in ("open", "high", "low", "close", "volume")))).alias("quote"), F.array(F.struct(F.col("b.adj_close").alias("adjclose"))).alias("adjclose"))
    result = F.struct(F.struct(F.concat(F.lit("SYM"), F.col("symbol_id").cast("string")).alias("symbol")).alias("meta"), part("timestamp"), indicators_.alias("indicators"))
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    error = F.lit('{"chart": {"result": null, "error": {"code": "Not Found", "description": "no data"}}}')
    line = F.when(F.col("symbol_id") % 7 == 0, error).when(F.col("symbol_id") % 11 == 0, F.substring(body, 1, 60)).otherwise(body)
    path = f"{shared_dir(spark)}/responses-{uuid.uuid4().hex}"
    c.select(line.alias("value")).write.text(path)
    rows, failures = chart_responses(spark, path, lines=True)
    read = rows.groupBy(F.lit("candles").alias("kind"), F.col("symbol").alias("name")).agg(F.count("*").alias("n"))
    return read.unionByName(failures.groupBy(F.lit("failure").alias("kind"), F.concat_ws(": ", "code", "message").alias("name")).agg(F.count("*").alias("n")))


def _scan_frame(daily):
    """Candles with the recursive and cumulative indicators and their structure, and the zones, each written once."""
    bars = indicators.window_indicators(indicators.fold_indicators(indicators.prepared(daily)), ["VolumeSMA_20", *indicators.CUMULATIVE])
    rows = structure.structure_frame(None, indicators=packed(bars, *SERIES, "ts", "rn", "high", "low", "close", "atr_14"))
    f = staged(unpacked(rows), "frame")
    return f, staged(structure.with_mitigation(structure.zones(f), f), "zones")


_LAST_EVENTS = (
    "select symbol_id, timeframe, ts, break_kind event_type, case when break_dir = 1 then 'Bullish' else 'Bearish' end || ' through ' || printf('%.2f', broken_price) detail from lg where break_kind is not null "
    "union all select symbol_id, timeframe, ts, 'Swing' || swing, printf('%.2f', swing_price) || ' of ' || swing_ts from lg where swing is not null "
    "union all select distinct symbol_id, timeframe, ts, event, '' from ev"
)


@_add("persisted_events", O.q(f"{_ZONES}, {O.EVENTS}, le as ({_LAST_EVENTS})", "select symbol_id, ts, event_type, detail, cast(0 as bigint) written_again from le where ts = (select max(ts) from c m where m.symbol_id = le.symbol_id)"))
def persisted_events(spark, d):
    """What a scan stores of the last candles; it is stored twice, and the second run writes nothing."""
    import uuid

    from wickwork.functions.staging import shared_dir
    from wickwork.operators.persist import ends_of_series, persist_scan
    from wickwork.sources.store import Store

    store, daily = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=16), staged(derived.daily_candles(spark, d), "candles")
    f, z = ends_of_series(daily) or _scan_frame(daily)
    persist_scan(store, f, z)
    again = sum(persist_scan(store, f, z).values())
    return store.get("structure_events").select("symbol_id", "ts", "event_type", "detail", F.lit(again).cast("bigint").alias("written_again"))


_RECONCILE = f"{O.CANDLES}, old as materialized (select symbol_id, timeframe, ts, case when dayofmonth(ts) = 4 then 0 when symbol_id % 7 = 0 then adj_close*0.99e0 else adj_close end adj_close from c where dayofmonth(ts) <> 2)"


@_add("reconcile", O.q(_RECONCILE, f"select c.symbol_id, c.timeframe, c.ts, {O.r4('old.adj_close')} cached_adj, c.adj_close fresh_adj, {O.r4('abs(c.adj_close - old.adj_close)/nullif(old.adj_close, 0)')} difference, case when old.adj_close is null then 'insert' when old.adj_close = 0 then 'skip' when abs(c.adj_close - old.adj_close)/nullif(old.adj_close, 0) > 0.001e0 then 'overwrite' else 'keep' end action from c join (select symbol_id, max(ts) m from c group by 1) x using (symbol_id) left join old on old.symbol_id = c.symbol_id and old.ts = c.ts where c.ts >= x.m - 90"))
def reconcile_query(spark, d):
    """Fresh candles against a cache with a missing, a zero and, for some symbols, a rescaled adjusted close."""
    fresh = derived.daily_candles(spark, d)
    adj = F.when(F.dayofmonth("ts") == 4, 0.0).when(F.col("symbol_id") % 7 == 0, F.col("adj_close") * 0.99).otherwise(F.col("adj_close"))
    cached = fresh.filter(F.dayofmonth("ts") != 2).withColumn("adj_close", adj)
    return _rounded(reconcile.reconcile(cached, fresh), "cached_adj", "difference")


@_add("symbol_mapping_asof", "with sy as (select s_suppkey id, 'SYM' || cast(s_suppkey as varchar) nse from supplier), m as (select id, nse || '.OLD' ext, date '1990-01-01' a, cast(null as date) z from sy where id % 2 = 0 union all select id, nse || '.NEW', date '1995-01-01', date '1997-12-31' from sy where id % 3 = 0), r as (select id, unnest([date '1994-06-01', date '1996-06-01', date '1998-06-01']) as day from sy) select cast(r.id as bigint) symbol_id, r.day, coalesce((select arg_max(ext, a) from m where m.id = r.id and m.a <= r.day and (m.z is null or m.z >= r.day)), sy.nse || '.NS') external_id from r join sy using (id)")
def symbol_mapping_asof(spark, d):
    s = derived.symbols(spark, d)
    old = s.filter("symbol_id % 2 = 0").select("symbol_id", F.lit("Yahoo").alias("provider"), F.concat("nse_symbol", F.lit(".OLD")).alias("external_id"), F.lit("1990-01-01").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    new = s.filter("symbol_id % 3 = 0").select("symbol_id", F.lit("Yahoo").alias("provider"), F.concat("nse_symbol", F.lit(".NEW")).alias("external_id"), F.lit("1995-01-01").cast("date").alias("effective_from"), F.lit("1997-12-31").cast("date").alias("effective_to"))
    days = F.explode(F.array(*(F.lit(x).cast("date") for x in ("1994-06-01", "1996-06-01", "1998-06-01"))))
    return reconcile.mapping_as_of(s.select("symbol_id", days.alias("day")), old.unionByName(new), s)


@_add("universe_snapshot_asof", "with s as (select * from (values (1, date '1993-01-01'), (2, date '1996-01-01')) t(snapshot_id, effective_date)), m as (select snapshot_id, s_suppkey symbol_id from s, supplier where s_suppkey % (snapshot_id + 1) = 0), dd as (select unnest([date '1992-01-01', date '1995-01-01', date '1996-01-01']) as day) select dd.day, cast(m.snapshot_id as bigint) snapshot_id, cast(m.symbol_id as bigint) symbol_id from dd join m on m.snapshot_id = (select arg_max(snapshot_id, effective_date) from s where effective_date <= dd.day)")
def universe_snapshot_asof(spark, d):
    snaps = spark.createDataFrame([(1, "1993-01-01"), (2, "1996-01-01")], "snapshot_id bigint, effective_date string").withColumn("effective_date", F.col("effective_date").cast("date"))
    s = derived.symbols(spark, d)
    members = s.select(F.lit(1).cast("bigint").alias("snapshot_id"), "symbol_id").unionByName(s.select(F.lit(2).cast("bigint").alias("snapshot_id"), "symbol_id")).filter(F.col("symbol_id") % (F.col("snapshot_id") + 1) == 0)
    days = spark.createDataFrame([("1992-01-01",), ("1995-01-01",), ("1996-01-01",)], "day string").select(F.col("day").cast("date").alias("day"))
    return reconcile.snapshot_as_of(days, snaps, members)


@_add("allocated_ids", "with sy as (select s_suppkey id, 'SYM' || s_suppkey as nse from supplier where s_suppkey % 4 <> 0), f as (select 'SYM' || s_suppkey as nse from supplier union all select 'NEW' || o_orderkey from orders where o_orderkey % 8 = 0), n as (select nse, row_number() over (order by nse) k from (select distinct nse from f) where nse not in (select nse from sy)) select f.nse nse_symbol, cast(coalesce(sy.id, (select max(id) from sy) + n.k) as bigint) symbol_id from f left join sy using (nse) left join n using (nse)")
def allocated_ids(spark, d):
    """Names of a fetched universe: known symbols keep their ids, new ones follow in order of names."""
    s = derived.symbols(spark, d)
    new = derived.table(spark, d, "orders").filter("o_orderkey % 8 = 0").select(F.concat(F.lit("NEW"), F.col("o_orderkey").cast("string")).alias("nse_symbol"))
    return reconcile.allocate_ids(s.select("nse_symbol").unionByName(new), s.filter("symbol_id % 4 <> 0")).select("nse_symbol", "symbol_id")


_TRADE_COLS = ("confidence", "entry", "stop_loss", "target1", "target2", "target3", "risk_reward", "exit_price", "r_multiple")


def _trades(spark, d):
    return backtest.trades(*_daily(spark, d))


@_add("backtest_trades", O.q(f"{_DECIDED}, {O.TRADES}", "select symbol_id, ts, outcome, direction, result, exit_ts, cast(holding as bigint) holding_days, " + ", ".join(f"{O.r4(c)} {c}" for c in _TRADE_COLS) + " from (select *, close entry, stop stop_loss, abs(target1 - close)/risk risk_reward, r r_multiple from trd)"))
def backtest_trades(spark, d):
    t = _rounded(_trades(spark, d), *_TRADE_COLS)
    return t.select("symbol_id", "ts", "outcome", "direction", "result", "exit_ts", F.col("holding_days").cast("bigint").alias("holding_days"), *_TRADE_COLS)


@_add("backtest_buckets", O.q(f"{_DECIDED}, {O.TRADES}", f"select outcome, signals, simulated, wins, losses, timed_out, {O.r4('avg_r')} avg_r, {O.r4('case when simulated > 0 then wins/simulated else 0 end')} win_rate from (select o.outcome, count(t.ts) signals, count(case when result <> 'InsufficientForwardData' then 1 end) simulated, count(case when result <> 'InsufficientForwardData' and r > 0 then 1 end) wins, count(case when result not in ('InsufficientForwardData', 'TimedOut') and r <= 0 then 1 end) losses, count(case when result = 'TimedOut' then 1 end) timed_out, coalesce(avg(case when result <> 'InsufficientForwardData' then r end), 0) avg_r from (select unnest(['StrongBuy', 'Buy']) outcome) o left join trd t on t.outcome = o.outcome group by o.outcome)"))
def backtest_buckets(spark, d):
    return _rounded(backtest.buckets(_trades(spark, d)), "avg_r", "win_rate").select("outcome", "signals", "simulated", "wins", "losses", "timed_out", "avg_r", "win_rate")


@_add("intraday_bars", "select cast(user_id as bigint) symbol_id, 'H1' timeframe, date_trunc('hour', ts) ts, arg_min(value, (ts, event_id)) open, max(value) high, min(value) low, arg_max(value, (ts, event_id)) as close, arg_max(value, (ts, event_id)) adj_close, count(*) volume from events group by user_id, date_trunc('hour', ts)")
def intraday_bars(spark, d):
    return derived.intraday_candles(spark, d, "H1")

"""The registered queries as plain SQL for another engine. Each query is a chain of common table expressions."""

from __future__ import annotations

CANDLES = """t as (select l_suppkey sid, cast(l_shipdate as date) d, cast(l_quantity as bigint) q, cast(round(100*l_tax) as bigint) tx, cast(round(100*l_discount) as bigint) dc,
 row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) k from lineitem),
u as (select *, tx-dc+1 r, sum(tx-dc+1) over (partition by sid order by k rows unbounded preceding) s from t),
p as (select *, 20000+25*s px, 20000+25*(s-r)+4*(q-25) op from u),
g as (select sid, d, arg_min(op,k) o, max(px) mx, min(px) mn, arg_max(px,k) cl, max(tx) tx, max(dc) dc, 100*sum(q) v from p group by sid, d),
c as materialized (select cast(sid as bigint) symbol_id, 'Daily' timeframe, d ts, o/cast(100 as double) open, (greatest(o,mx)+5*tx)/cast(100 as double) high, (least(o,mn)-5*dc)/cast(100 as double) low,
 cl/cast(100 as double) as close, cl/cast(100 as double) adj_close, cast(v as bigint) volume from g)"""

INDEX = """ix as materialized (select cast(0 as bigint) symbol_id, 'Daily' timeframe, ts, floor(sum(cast(round(open*100) as bigint))/count(*))/100e0 open, floor(sum(cast(round(high*100) as bigint))/count(*))/100e0 high,
 floor(sum(cast(round(low*100) as bigint))/count(*))/100e0 low, floor(sum(cast(round(close*100) as bigint))/count(*))/100e0 as close, floor(sum(cast(round(adj_close*100) as bigint))/count(*))/100e0 adj_close, sum(volume) volume from c group by ts)"""

WEEKLY = """wk as materialized (select symbol_id, 'Weekly' timeframe, cast(date_trunc('week', ts) as date) ts, arg_min(open, c.ts) open, max(high) high, min(low) low, arg_max(close, c.ts) as close, arg_max(adj_close, c.ts) adj_close, cast(sum(volume) as bigint) volume from c group by symbol_id, cast(date_trunc('week', ts) as date))"""

W = "(partition by symbol_id order by ts)"
SO = "(partition by symbol_id order by ts rows unbounded preceding)"
BEFORE = "(partition by symbol_id order by ts rows between unbounded preceding and 1 preceding)"


def over(n: int) -> str:
    return f"(partition by symbol_id order by ts rows between {n - 1} preceding and current row)"


def r4(x: str) -> str:
    return f"floor(({x})*10000+0.5001)/10000"


def bars(src: str, name: str) -> str:
    return f"""{name}0 as (select *, row_number() over {W} rn, lag(close) over {W} close_1, (high+low+close)/3 tp from {src}),
{name} as materialized (select *, case when close_1 > 0 then ln(close/close_1) end log_ret, greatest(high-low, abs(high-close_1), abs(low-close_1)) tr, lag(tp) over {W} tp_1 from {name}0)"""


def _from(n: int, x: str) -> str:
    return f"case when rn >= {n} then {x} end"


def _ratio(a: str, b: str, other: str = "null") -> str:
    return f"(case when ({b}) = 0 then {other} else ({a})/({b}) end)"


def _dir(v: str) -> str:
    return f"case when close > {v} then 'Bullish' when close < {v} then 'Bearish' else 'Neutral' end"


def _sign(v: str) -> str:
    return f"case when {v} > 0 then 'Bullish' when {v} < 0 then 'Bearish' else 'Neutral' end"


def _ladder(v: str, high: float, low: float, mid: float) -> str:
    return f"case when {v} >= {high} then 'Overbought' when {v} <= {low} then 'Oversold' when {v} >= {mid} then 'Bullish' when {v} < {mid} then 'Bearish' else 'Neutral' end"


def _wma(x: str, n: int) -> str:
    return f"((sum({x}*rn) over {over(n)} - (rn-{n})*sum({x}) over {over(n)}) / {n * (n + 1) // 2})"


def _hl(n: int) -> str:
    return f"(max(high) over {over(n)} + min(low) over {over(n)})/2"


def _sum(x: str, n: int) -> str:
    return f"sum({x}) over {over(n)}"


_DEV = f"(select sum(abs(x - m)) from (select unnest(l) x)) / 20"
_UP, _DOWN = (_sum(f"case when tp {s} tp_1 then tp*volume else 0 end", 14) for s in "><")
_SLOPE = f"regr_slope(close, rn) over {over(20)}"

#: key: (helper columns, value columns, signal)
WINDOW_SQL: dict[str, tuple[dict[str, str], dict[str, str], str]] = {
    **{f"SMA_{n}": ({}, {f"sma_{n}": _from(n, f"avg(close) over {over(n)}")}, _dir(f"sma_{n}")) for n in (20, 50)},
    "WMA_20": ({}, {"wma_20": _from(20, _wma("close", 20))}, _dir("wma_20")),
    "HMA_20": ({"hma_raw": _from(20, f"2*{_wma('close', 10)} - {_wma('close', 20)}")}, {"hma_20": _from(23, _wma("hma_raw", 4))}, _dir("hma_20")),
    "VWMA_20": ({}, {"vwma_20": _from(20, _ratio(_sum("close*volume", 20), _sum("volume", 20)))}, _dir("vwma_20")),
    "RegressionChannel_20": (
        {"slope": _SLOPE, "icept": f"regr_intercept(close, rn) over {over(20)}", "rest": f"regr_syy(close, rn) over {over(20)}", "sxx": f"regr_sxx(close, rn) over {over(20)}"},
        {"regression": _from(20, "icept + slope*rn"), "regression_upper": _from(20, "icept + slope*rn + 2*sqrt(greatest(rest - slope*slope*sxx, 0)/20)"), "regression_lower": _from(20, "icept + slope*rn - 2*sqrt(greatest(rest - slope*slope*sxx, 0)/20)"), "regression_slope": _from(20, "slope")},
        _sign("regression_slope"),
    ),
    "Donchian_20": ({}, {"donchian_mid": _from(20, _hl(20)), "donchian_upper": _from(20, f"max(high) over {over(20)}"), "donchian_lower": _from(20, f"min(low) over {over(20)}")}, "case when close >= donchian_upper then 'Bullish' when close <= donchian_lower then 'Bearish' else 'Neutral' end"),
    "Ichimoku_9_26_52": ({}, {"kijun": _from(26, _hl(26)), "tenkan": _from(9, _hl(9)), "senkou_a": _from(26, f"({_hl(9)} + {_hl(26)})/2"), "senkou_b": _from(52, _hl(52)), "chikou": "close"}, _dir("kijun")),
    "Stochastic_14_3": ({"k": _from(14, _ratio(f"(close - min(low) over {over(14)})*100", f"max(high) over {over(14)} - min(low) over {over(14)}", "50"))}, {"stochastic_k": "k", "stochastic_d": _from(16, f"avg(k) over {over(3)}")}, f"case when stochastic_d is null then 'Neutral' else {_ladder('stochastic_k', 80, 20, 50)} end"),
    "CCI_20": ({"l": f"list(tp) over {over(20)}", "m": f"avg(tp) over {over(20)}"}, {"cci_20": _from(20, _ratio("tp - m", f"0.015e0*({_DEV})", "0"))}, _ladder("cci_20", 100, -100, 0)),
    "ROC_12": ({"c12": f"lag(close, 12) over {W}"}, {"roc_12": _from(13, _ratio("(close - c12)*100", "c12", "0"))}, _sign("roc_12")),
    "WilliamsR_14": ({"hh": f"max(high) over {over(14)}", "ll": f"min(low) over {over(14)}"}, {"williams_r": _from(14, _ratio("(hh - close)*-100", "hh - ll", "-50"))}, _ladder("williams_r", -20, -80, -50)),
    "StdDev_20": ({}, {"stddev_20": _from(20, f"stddev_pop(close) over {over(20)}")}, "'Neutral'"),
    "BollingerBands_20_2": ({"m": f"avg(close) over {over(20)}", "s": f"stddev_pop(close) over {over(20)}"}, {"bollinger": _from(20, "m"), "bollinger_upper": _from(20, "m + 2*s"), "bollinger_lower": _from(20, "m - 2*s"), "bollinger_bandwidth": _from(20, _ratio("4*s*100", "m", "0"))}, "case when close >= bollinger_upper then 'Overbought' when close <= bollinger_lower then 'Oversold' else 'Neutral' end"),
    "HistVol_20": ({}, {"hist_vol": _from(21, f"stddev_samp(log_ret) over {over(20)} * sqrt(252e0) * 100")}, "'Neutral'"),
    "RangeCompressionExpansion_20": ({}, {"range_ratio": _from(20, _ratio("tr", f"avg(tr) over {over(20)}", "1"))}, "case when range_ratio <= 0.6 then 'Compression' when range_ratio >= 1.5 then 'Expansion' else 'Neutral' end"),
    "OBV": ({"o0": f"cast(sum(case when close > close_1 then volume when close < close_1 then -volume else 0 end) over {SO} as double)"}, {"obv": "o0"}, f"case when lag(obv, 4) over {W} is null then 'Neutral' else {_sign(f'(obv - lag(obv, 4) over {W})')} end"),
    "VolumeSMA_20": ({}, {"volume_sma": _from(20, f"avg(volume) over {over(20)}")}, "case when volume_sma is null then 'Neutral' when volume > volume_sma then 'AboveAverage' else 'BelowAverage' end"),
    "VolumeSpike_20_2": ({}, {"volume_spike": _from(20, _ratio("cast(volume as double)", f"avg(volume) over {over(20)}"))}, "case when volume_spike is null then 'Neutral' when volume_spike >= 2 then 'VolumeSpike' else 'Normal' end"),
    "VWAP": ({}, {"vwap": _ratio(f"sum(tp*volume) over {SO}", f"sum(volume) over {SO}")}, _dir("vwap")),
    "RollingVWAP_20": ({}, {"rolling_vwap": _from(20, _ratio(_sum("tp*volume", 20), _sum("volume", 20)))}, _dir("rolling_vwap")),
    "CMF_20": ({"mfv": _ratio("(close - low) - (high - close)", "high - low", "0") + "*volume"}, {"cmf_20": _from(20, _ratio(_sum("mfv", 20), _sum("volume", 20), "0"))}, "case when cmf_20 > 0.05 then 'Bullish' when cmf_20 < -0.05 then 'Bearish' else 'Neutral' end"),
    "MFI_14": ({"up": _UP, "down": _DOWN}, {"mfi_14": _from(15, "case when up = 0 and down = 0 then 50 when down = 0 then 100 else 100 - 100/(1 + up/down) end")}, _ladder("mfi_14", 80, 20, 50)),
}


def fold(name: str, src: str, first: int, n: int, seed: str, step: str) -> str:
    """name(symbol_id, rn, v): the seed over n rows of ``src`` from ``first`` on, then one step a row (r before, s the row)."""
    return f"""{name} as (select symbol_id, cast({first + n - 1} as bigint) rn, cast({seed} as double) v from {src} where rn between {first} and {first + n - 1} group by symbol_id having count(*) = {n}
 union all select r.symbol_id, r.rn+1, {step} from {name} r join {src} s on s.symbol_id = r.symbol_id and s.rn = r.rn+1)"""


def ema(name: str, src: str, col: str, n: int, first: int = 1) -> str:
    return fold(name, src, first, n, f"avg({col})", f"r.v + (s.{col} - r.v)*(2e0/{n + 1})")


def wilder(name: str, src: str, col: str, n: int, first: int = 1) -> str:
    return fold(name, src, first, n, f"avg({col})", f"(r.v*{n - 1} + s.{col})/{n}")


def total(name: str, src: str, col: str, n: int, first: int) -> str:
    return fold(name, src, first, n, f"sum({col})", f"r.v - r.v/{n} + s.{col}")


_RSI = f"""rs as materialized (select symbol_id, rn, greatest(close - close_1, 0) gain, greatest(close_1 - close, 0) loss from b where rn >= 2),
{wilder('rg', 'rs', 'gain', 14, 2)}, {wilder('rl', 'rs', 'loss', 14, 2)},
rsi as materialized (select rg.symbol_id, rg.rn, case when rl.v = 0 then case when rg.v = 0 then 50 else 100 end else 100 - 100/(1 + rg.v/rl.v) end v from rg join rl using (symbol_id, rn))"""

_ADX = f"""dm as materialized (select symbol_id, rn, tr, case when up > dn and up > 0 then up else 0 end plus, case when dn > up and dn > 0 then dn else 0 end minus from (select *, high - lag(high) over {W} up, lag(low) over {W} - low dn from b) where rn >= 2),
{total('st', 'dm', 'tr', 14, 2)}, {total('sp', 'dm', 'plus', 14, 2)}, {total('sm', 'dm', 'minus', 14, 2)},
di as materialized (select st.symbol_id, st.rn, {_ratio('100*sp.v', 'st.v', '0')} p, {_ratio('100*sm.v', 'st.v', '0')} m from st join sp using (symbol_id, rn) join sm using (symbol_id, rn)),
dx as materialized (select *, {_ratio('100*abs(p - m)', 'p + m', '0')} v from di), {wilder('adx', 'dx', 'v', 14, 15)}"""

_KAMA = f"""er as materialized (select symbol_id, rn, close, power({_ratio('abs(close - c10)', 'noise', '0')}*(2e0/3 - 2e0/31) + 2e0/31, 2) sc from (select *, lag(close, 10) over {W} c10, sum(abs(close - close_1)) over {over(10)} noise from b)),
kama as (select symbol_id, rn, close v from er where rn = 11 union all select r.symbol_id, r.rn+1, r.v + s.sc*(s.close - r.v) from kama r join er s on s.symbol_id = r.symbol_id and s.rn = r.rn+1)"""

_ATR = wilder("atr", "b", "tr", 14)

_SUPER = f"""{_ATR}, sb as materialized (select b.symbol_id, b.rn, b.close, (high + low)/2 mid, (high + low)/2 + 3*v hi, (high + low)/2 - 3*v lo from b join atr using (symbol_id, rn)),
su as (select symbol_id, rn, hi u, lo l, close >= mid up from sb where rn = 14 union all
 select symbol_id, rn, u, l, case when was then close >= l else close > u end from (select s.symbol_id, s.rn, s.close, r.up was, case when s.close > r.u then s.hi else least(s.hi, r.u) end u, case when s.close < r.l then s.lo else greatest(s.lo, r.l) end l from su r join sb s on s.symbol_id = r.symbol_id and s.rn = r.rn+1))"""

_TREMA = f"{ema('e1', 'b', 'close', 20)}, {ema('e2', 'e1', 'v', 20, 20)}, {ema('e3', 'e2', 'v', 20, 39)}"

#: key: (chain, tables joined by (symbol_id, rn), value columns, signal)
FOLD_SQL: dict[str, tuple[str, tuple[str, ...], dict[str, str], str]] = {
    **{f"EMA_{n}": (ema("e1", "b", "close", n), ("e1",), {f"ema_{n}": "e1.v"}, _dir(f"ema_{n}")) for n in (20, 50)},
    "DEMA_20": (_TREMA, ("e1", "e2"), {"dema_20": "2*e1.v - e2.v"}, _dir("dema_20")),
    "TEMA_20": (_TREMA, ("e1", "e2", "e3"), {"tema_20": "3*e1.v - 3*e2.v + e3.v"}, _dir("tema_20")),
    "KAMA_10": (_KAMA, ("kama",), {"kama_10": "kama.v"}, _dir("kama_10")),
    "SuperTrend_14_3": (_SUPER, ("su",), {"supertrend": "case when su.up then su.l else su.u end", "supertrend_up": "cast(su.up as double)"}, "case when supertrend_up = 1 then 'Bullish' when supertrend_up = 0 then 'Bearish' else 'Neutral' end"),
    "RSI_14": (_RSI, ("rsi",), {"rsi_14": "rsi.v"}, _ladder("rsi_14", 70, 30, 50)),
    "MACD_12_26_9": (f"{ema('e1', 'b', 'close', 12)}, {ema('e2', 'b', 'close', 26)}, mc as materialized (select e1.symbol_id, e1.rn, e1.v - e2.v v from e1 join e2 using (symbol_id, rn)), {ema('ms', 'mc', 'v', 9, 26)}", ("mc", "ms"), {"macd": "mc.v", "macd_signal": "ms.v", "macd_hist": "mc.v - ms.v"}, f"case when macd_signal is null then 'Neutral' else {_sign('(macd - macd_signal)')} end"),
    "ADX_14": (_ADX, ("di", "adx"), {"adx_14": "adx.v", "di_plus": "di.p", "di_minus": "di.m"}, "case when adx_14 >= 25 then case when di_plus > di_minus then 'Bullish' else 'Bearish' end else 'Neutral' end"),
    "StochRSI_14_14_3": (
        f"""{_RSI}, sr0 as (select symbol_id, rn, v, min(v) over x lo, max(v) over x hi from rsi window x as (partition by symbol_id order by rn rows between 13 preceding and current row)),
sr as (select symbol_id, rn, case when hi > lo then (v - lo)/(hi - lo)*100 else 50 end k from sr0 where rn >= 28), sd as materialized (select *, case when rn >= 30 then avg(k) over (partition by symbol_id order by rn rows between 2 preceding and current row) end d from sr)""",
        ("sd",), {"stoch_rsi_k": "sd.k", "stoch_rsi_d": "sd.d"}, f"case when stoch_rsi_d is null then 'Neutral' else {_ladder('stoch_rsi_k', 80, 20, 50)} end",
    ),
    "TRIX_15": (f"{ema('e1', 'b', 'close', 15)}, {ema('e2', 'e1', 'v', 15, 15)}, {ema('e3', 'e2', 'v', 15, 29)}, tx3 as materialized (select symbol_id, rn, v, lag(v) over (partition by symbol_id order by rn) pv from e3)", ("tx3",), {"trix_15": f"case when tx3.pv is not null then {_ratio('tx3.v - tx3.pv', 'tx3.pv', '0')}*100 end"}, _sign("trix_15")),
    "ATR_14": (_ATR, ("atr",), {"atr_14": "atr.v"}, "'Neutral'"),
    "KeltnerChannel_20": (f"{ema('e1', 'b', 'close', 20)}, {wilder('a2', 'b', 'tr', 20)}", ("e1", "a2"), {"keltner": "e1.v", "keltner_upper": "e1.v + 2*a2.v", "keltner_lower": "e1.v - 2*a2.v"}, "case when close > keltner_upper then 'Bullish' when close < keltner_lower then 'Bearish' else 'Neutral' end"),
    "VolumeEMA_20": (ema("e1", "b", "volume", 20), ("e1",), {"volume_ema": "e1.v"}, "case when volume > 1.5*volume_ema then 'Bullish' when volume < 0.5*volume_ema then 'Bearish' else 'Neutral' end"),
}


def indicator_sql(key: str) -> str:
    if key in WINDOW_SQL:
        helpers, cols, signal = WINDOW_SQL[key]
        chain = f"h as (select *{''.join(f', {v} {k}' for k, v in helpers.items())} from b)"
        made = f"v as (select symbol_id, timeframe, ts, rn, close, volume, {', '.join(f'{v} _{k}' for k, v in cols.items())} from h)"
    else:
        chain, tables, cols, signal = FOLD_SQL[key]
        joins = "".join(f" left join {t} on {t}.symbol_id = b.symbol_id and {t}.rn = b.rn" for t in tables)
        made = f"v as (select b.symbol_id, b.timeframe, b.ts, b.rn, b.close, b.volume, {', '.join(f'{v} _{k}' for k, v in cols.items())} from b{joins})"
    rounded = f"r as (select symbol_id, timeframe, ts, close, volume, {', '.join(f'{r4(f"_{k}")} {k}' for k in cols)} from v)"
    return f"with recursive {CANDLES}, {bars('c', 'b')}, {chain}, {made}, {rounded} select symbol_id, timeframe, ts, {', '.join(cols)}, {signal} signal from r"


def _body(o: str, h: str, lo: str, c: str) -> str:
    return _ratio(f"abs({c} - {o})*100", f"{h} - {lo}", "0")


PATTERNS = f"""q as (select *, {_body('open', 'high', 'low', 'close')} bd, {_ratio('(high - greatest(open, close))*100', 'high - low', '0')} uw, {_ratio('(least(open, close) - low)*100', 'high - low', '0')} lw from b),
q2 as (select *, {', '.join(f'lag({x}, {k}) over {W} {n}{k}' for k in (1, 2) for x, n in (('open', 'o'), ('high', 'h'), ('low', 'lo'), ('close', 'cl'), ('bd', 'bd'), ('uw', 'uw'), ('lw', 'lw')))} from q),
pt as materialized (select symbol_id, ts, rn, list_filter([
 case when bd < 10 then 'Doji' end, case when bd > 90 then 'Marubozu' end,
 case when high <> low and bd < 33 and ((uw > 66 and lw < 10) or (lw > 66 and uw < 10)) then 'PinBar' end,
 case when cl1 < o1 and close > open and least(open, close) <= least(o1, cl1) and greatest(open, close) >= greatest(o1, cl1) then 'EngulfingBullish' end,
 case when cl1 > o1 and close < open and least(open, close) <= least(o1, cl1) and greatest(open, close) >= greatest(o1, cl1) then 'EngulfingBearish' end,
 case when ((cl1 < o1 and close > open) or (cl1 > o1 and close < open)) and least(open, close) >= least(o1, cl1) and greatest(open, close) <= greatest(o1, cl1) then 'Harami' end,
 case when high <= h1 and low >= lo1 then 'InsideBar' end, case when high >= h1 and low <= lo1 then 'OutsideBar' end,
 case when cl2 < o2 and bd2 > 60 and greatest(o1, cl1) < cl2 and bd1 < 30 and close > open and close > (o2 + cl2)/2 then 'MorningStar' end,
 case when cl2 > o2 and bd2 > 60 and least(o1, cl1) > cl2 and bd1 < 30 and close < open and close < (o2 + cl2)/2 then 'EveningStar' end,
 case when cl2 > o2 and cl1 > o1 and close > open and cl1 > cl2 and close > cl1 and bd > 60 and bd1 > 60 and bd2 > 60 and uw < 66 and uw1 < 66 and uw2 < 66 then 'ThreeWhiteSoldiers' end,
 case when cl2 < o2 and cl1 < o1 and close < open and cl1 < cl2 and close < cl1 and bd > 60 and bd1 > 60 and bd2 > 60 and lw < 66 and lw1 < 66 and lw2 < 66 then 'ThreeBlackCrows' end
], lambda x: x is not null) patterns from q2)"""


def _lastv(x: str, w: str = SO) -> str:
    return f"last_value({x} ignore nulls) over {w}"


def swings(src: str, p: str = "") -> str:
    """{p}sw: ``src`` with swing, swing_price, swing_ts and the last swings."""
    hi = " and ".join(f"lag(high, 2) over {W} > {'high' if k == 0 else f'lag(high, {k}) over {W}'}" for k in (4, 3, 1, 0))
    lo = " and ".join(f"lag(low, 2) over {W} < {'low' if k == 0 else f'lag(low, {k}) over {W}'}" for k in (4, 3, 1, 0))
    return f"""{p}s0 as (select *, coalesce({hi}, false) sh, coalesce({lo}, false) sl, lag(high, 2) over {W} h2, lag(low, 2) over {W} l2, lag(ts, 2) over {W} t2 from {src}),
{p}s1 as (select *, case when sh and not sl then 'High' when sl and not sh then 'Low' end swing, case when sh and not sl then h2 when sl and not sh then l2 end swing_price, case when sh <> sl then t2 end swing_ts from {p}s0),
{p}sw as materialized (select *, {_lastv("case when swing = 'High' then swing_price end")} high_swing, {_lastv("case when swing = 'High' then rn end")} high_id, {_lastv("case when swing = 'Low' then swing_price end")} low_swing, {_lastv("case when swing = 'Low' then rn end")} low_id,
 case when swing = 'High' then coalesce(swing_price > {_lastv("case when swing = 'High' then swing_price end", BEFORE)}, false) when swing = 'Low' then coalesce(swing_price < {_lastv("case when swing = 'Low' then swing_price end", BEFORE)}, false) end hl from {p}s1)"""


def breaks(p: str = "") -> str:
    """{p}br: {p}sw with break_dir, break_kind, broken_price, trend, since_bos."""
    first = lambda cond, key: f"({cond} and sum(case when {cond} then 1 else 0 end) over (partition by symbol_id, {key} order by ts rows unbounded preceding) = 1)"
    return f"""{p}k0 as (select *, coalesce(close > high_swing, false) cu from {p}sw), {p}k1 as (select *, {first('cu', 'high_id')} bull from {p}k0),
{p}k2 as (select *, coalesce(close < low_swing, false) and not bull cd from {p}k1), {p}k3 as (select *, {first('cd', 'low_id')} bear from {p}k2),
{p}k4 as (select *, case when bull then 1 when bear then -1 end break_dir, case when bull then high_swing when bear then low_swing end broken_price from {p}k3),
{p}k5 as (select *, {_lastv('break_dir', BEFORE)} prev_dir, coalesce({_lastv('break_dir')}, 0) trend from {p}k4),
{p}k6 as (select *, case when break_dir is null then null when prev_dir <> break_dir then 'CHoCH' else 'BOS' end break_kind from {p}k5),
{p}br as materialized (select *, rn - coalesce({_lastv("case when break_kind = 'BOS' then rn end")}, 0) since_bos from {p}k6)"""


RANGES = f"""r0 as (select *, case when break_dir is null and coalesce(high <= high_swing and low >= low_swing, false) then 1 else 0 end inside from br),
r1 as (select *, sum(1 - inside) over {SO} island from r0), r2 as (select *, sum(inside) over (partition by symbol_id, island order by ts rows unbounded preceding) range_run from r1),
rg0 as materialized (select *, range_run >= 10 is_ranging, coalesce(lag(range_run >= 10) over {W}, false) was_ranging from r2)"""

LEGS = f"""l0 as (select rg0.*, atr.v atr_14, {_lastv('case when swing is not null then close end', BEFORE)} sc, {_lastv('case when swing is not null then ts end', BEFORE)} st from rg0 left join atr using (symbol_id, rn)),
l1 as (select *, swing is not null and st is not null done from l0),
l2 as (select *, case when done then case when close >= sc then 1 else -1 end end leg_dir, case when done then case when coalesce(atr_14 > 0 and abs(close - sc) >= 1.5*atr_14, false) or since_bos <= 3 then 1 else 0 end end imp from l1),
l3 as (select *, sum(coalesce(imp, 0)) over {SO} grp, {_lastv('case when imp = 1 then leg_dir end')} idir from l2),
l4 as (select *, sum(case when imp = 0 and leg_dir = idir then 1 else 0 end) over (partition by symbol_id, grp order by ts rows unbounded preceding) back from l3),
l5 as (select *, case when imp = 1 then 'Impulse' when imp = 0 then case when grp > 0 and back = 0 then 'Correction' else 'Trend' end end leg_kind from l4),
l6 as (select *, {_lastv("case when leg_kind = 'Trend' then leg_dir end", BEFORE)} pdir from l5),
l7 as (select *, sum(case when leg_kind = 'Trend' and (pdir is null or pdir <> leg_dir) then 1 else 0 end) over {SO} turns from l6),
l8 as (select *, sum(case when leg_kind = 'Trend' then 1 else 0 end) over (partition by symbol_id, turns order by ts rows unbounded preceding) run from l7),
lg as materialized (select *, coalesce(lag(run) over {W}, 0) trend_leg_run, {_from(20, f'avg(volume) over {over(20)}')} volume_sma from l8)"""

STRUCTURE = f"{CANDLES}, {bars('c', 'b')}, {_ATR}, {swings('b')}, {breaks()}, {RANGES}, {LEGS}"

ZONES = f"""z0 as (select symbol_id, timeframe, ts, rn, leg_kind, leg_dir, case when leg_kind is not null then st end lst, high, low, lag(high, 2) over {W} h2, lag(low, 2) over {W} l2, lag(open) over {W} po, lag(high) over {W} ph, lag(low) over {W} pl, lag(close) over {W} pc from (select * exclude (h2, l2) from lg)),
zn as materialized (select symbol_id, timeframe, 'FvgBullish' kind, ts formed_ts, ts created_ts, rn created_rn, low as upper, h2 as lower from z0 where h2 < low
 union all select symbol_id, timeframe, 'FvgBearish', ts, ts, rn, l2, high from z0 where l2 > high and not coalesce(h2 < low, false)
 union all select symbol_id, timeframe, case when leg_dir = 1 then 'SupplyZone' else 'DemandZone' end, lst, ts, rn, greatest(po, pc), least(po, pc) from z0 where leg_kind = 'Impulse' and po is not null
 union all select symbol_id, timeframe, case when leg_dir = 1 then 'OrderBlockBullish' else 'OrderBlockBearish' end, lst, ts, rn, ph, pl from z0 where leg_kind = 'Impulse' and po is not null and case when leg_dir = 1 then pc < po else pc > po end),
zm as materialized (select z.*, x.partial_rn, x.full_rn from (select *, row_number() over (order by symbol_id, created_rn, kind) zid from zn) z left join (select zid, min(case when b.low <= z.upper and b.high >= z.lower then b.rn end) partial_rn, min(case when b.low <= z.lower and b.high >= z.upper then b.rn end) full_rn
 from (select *, row_number() over (order by symbol_id, created_rn, kind) zid from zn) z join b on b.symbol_id = z.symbol_id and b.rn > z.created_rn group by zid) x using (zid))"""

GRABS = """select symbol_id, timeframe, ts, 'LiquidityGrabHigh' event from lg where high > high_swing and close <= high_swing union all select symbol_id, timeframe, ts, 'LiquidityGrabLow' from lg where low < low_swing and close >= low_swing"""

TRAPS = f"""select symbol_id, timeframe, hit ts, event from (select symbol_id, timeframe, case when break_dir = 1 then 'BullTrap' else 'BearTrap' end event, break_kind,
 case when case when break_dir = 1 then c1 < broken_price else c1 > broken_price end then t1 when case when break_dir = 1 then c2 < broken_price else c2 > broken_price end then t2 end hit
 from (select * exclude (t2), lead(close, 1) over {W} c1, lead(close, 2) over {W} c2, lead(ts, 1) over {W} t1, lead(ts, 2) over {W} t2 from lg)) where break_kind = 'BOS' and hit is not null"""

FALSE_BREAKS = """select symbol_id, timeframe, ts, 'FalseBreakout' event from lg where was_ranging and high > high_swing and close <= high_swing union all select symbol_id, timeframe, ts, 'FailedBreakdown' from lg where was_ranging and low < low_swing and close >= low_swing"""

ABSORPTION = f"""select h.symbol_id, h.timeframe, h.ts, 'VolumeAbsorption' event from (select * from lg where volume_sma > 0 and volume >= 2*volume_sma and high <> low and {_body('open', 'high', 'low', 'close')} < 30) h
 where exists (select 1 from zm z where z.symbol_id = h.symbol_id and z.created_rn <= h.rn and (z.full_rn is null or z.full_rn > h.rn) and h.low <= z.upper and h.high >= z.lower)
 or exists (select 1 from lg s where s.symbol_id = h.symbol_id and s.swing is not null and s.rn <= h.rn and s.swing_price >= h.low and s.swing_price <= h.high)"""

EXHAUSTION = """select symbol_id, timeframe, ts, 'ExhaustionCandle' event from lg where atr_14 > 0 and high > low and high - low >= 2*atr_14 and case when trend = 1 then (close - low)/(high - low) <= 0.2 when trend = -1 then (close - low)/(high - low) >= 0.8 else false end"""

_LEADS = ", ".join(f"lead(break_kind, {k}) over {W} bk{k}, lead(ts, {k}) over {W} bt{k}" for k in range(5))
GAPS = f"""select symbol_id, timeframe, case when gk = 'GapExhaustion' then hit else ts end ts, gk event from (select *, case when gap <> 0 and leg_kind = 'Impulse' and leg_dir = gap and is_ranging then 'GapBreakaway' when gap <> 0 and gap = trend and not is_ranging then 'GapContinuation' when gap <> 0 and gap = trend and trend_leg_run >= 3 then 'GapExhaustion' end gk,
 case {' '.join(f"when bk{k} = 'CHoCH' then bt{k}" for k in range(5))} end hit from (select *, cast(sign(open - close_1) as integer) gap, {_LEADS} from lg)) where gk is not null and (gk <> 'GapExhaustion' or hit is not null)"""

EVENTS = f"ev as materialized ({GRABS} union all {TRAPS} union all {FALSE_BREAKS} union all {ABSORPTION} union all {EXHAUSTION} union all {GAPS})"

REGIME = f"""{bars('ix', 'ib')}, {wilder('iatr', 'ib', 'tr', 14)}, {swings('ib', 'i')}, {breaks('i')},
rgm as materialized (select x.ts, case when x.trend = 0 or a.v is null or a.v <= 0 then 'Neutral' else (case when abs(x.close - x.sma)/a.v >= 1 then 'Strong' else '' end) || (case when x.trend = 1 then 'Bull' else 'Bear' end) end regime from (select *, avg(close) over {over(20)} sma from ibr) x left join iatr a using (symbol_id, rn))"""

STRENGTH = f"""rx as materialized (select a.symbol_id, a.timeframe, a.ts, case when i.s <> 0 then a.s/i.s end rs_short, case when i.l <> 0 then a.l/i.l end rs_long from
 (select *, case when lag(adj_close, 20) over {W} > 0 then adj_close/lag(adj_close, 20) over {W} - 1 end s, case when lag(adj_close, 60) over {W} > 0 then adj_close/lag(adj_close, 60) over {W} - 1 end l from c) a left join
 (select ts, case when lag(adj_close, 20) over {W} > 0 then adj_close/lag(adj_close, 20) over {W} - 1 end s, case when lag(adj_close, 60) over {W} > 0 then adj_close/lag(adj_close, 60) over {W} - 1 end l from ix) i using (ts))"""

_STATE_FOLDS = ", ".join([ema("e20", "b", "close", 20), ema("e50", "b", "close", 50), _RSI, _ADX, ema("m12", "b", "close", 12), ema("m26", "b", "close", 26)])

STATE = f"""{STRUCTURE}, {ZONES}, {INDEX}, {REGIME}, {STRENGTH}, {PATTERNS}, {_STATE_FOLDS},
zc as (select symbol_id, rn, sum(l) dl, sum(s) ds from (select symbol_id, created_rn rn, case when kind in ('DemandZone','OrderBlockBullish') then 1 else 0 end l, case when kind in ('SupplyZone','OrderBlockBearish') then 1 else 0 end s from zm where kind not like 'Fvg%'
 union all select symbol_id, full_rn, case when kind in ('DemandZone','OrderBlockBullish') then -1 else 0 end, case when kind in ('SupplyZone','OrderBlockBearish') then -1 else 0 end from zm where kind not like 'Fvg%' and full_rn is not null) group by symbol_id, rn),
ex as ({EXHAUSTION}), ab as ({ABSORPTION}),
lgx as materialized (select *, {_from(14, _ratio(f'(close - min(low) over {over(14)})*100', f'max(high) over {over(14)} - min(low) over {over(14)}', '50'))} stoch, {_from(21, f'stddev_samp(log_ret) over {over(20)}')} hv from lg),
sta as (select lg.*, pt.patterns, e20.v ema_20, e50.v ema_50, rsi.v rsi_14, adx.v adx_14, m12.v - m26.v macd, rx.rs_short, rgm.regime, zc.dl, zc.ds, case when ex.event is not null then 1 else 0 end xf, case when ab.event is not null then 1 else 0 end af
 from lgx lg left join pt using (symbol_id, ts) left join e20 on e20.symbol_id = lg.symbol_id and e20.rn = lg.rn left join e50 on e50.symbol_id = lg.symbol_id and e50.rn = lg.rn left join rsi on rsi.symbol_id = lg.symbol_id and rsi.rn = lg.rn
 left join adx on adx.symbol_id = lg.symbol_id and adx.rn = lg.rn left join m12 on m12.symbol_id = lg.symbol_id and m12.rn = lg.rn left join m26 on m26.symbol_id = lg.symbol_id and m26.rn = lg.rn left join rx on rx.symbol_id = lg.symbol_id and rx.ts = lg.ts left join rgm on rgm.ts = lg.ts
 left join zc on zc.symbol_id = lg.symbol_id and zc.rn = lg.rn left join ex on ex.symbol_id = lg.symbol_id and ex.ts = lg.ts left join ab on ab.symbol_id = lg.symbol_id and ab.ts = lg.ts),
stb as (select *, {_lastv("case when break_kind = 'BOS' then break_dir end")} bos_dir, {_lastv("case when break_kind = 'BOS' then rn end")} bos_rn, {_lastv("case when break_kind = 'CHoCH' then break_dir end")} choch_dir, {_lastv("case when break_kind = 'CHoCH' then rn end")} choch_rn,
 coalesce({_lastv("case when swing = 'High' then hl end")}, false) hh, coalesce({_lastv("case when swing = 'Low' then hl end")}, false) lw2, max(xf) over {SO} = 1 has_ex, max(af) over {SO} = 1 has_ab, coalesce(sum(dl) over {SO}, 0) live_long, coalesce(sum(ds) over {SO}, 0) live_short,
 case when trend = -1 then -1 else 1 end direction, case when volume_sma > 0 then volume/volume_sma end relv, case when atr_14 > 0 then (high - low)/atr_14 end rta,
 case when close_1 is null then 'None' when high = low and low = close then case when close > close_1 then 'UpperLocked' else 'LowerLocked' end else 'None' end circuit,
 sum(case when volume > 0 then 1 else 0 end) over {over(60)} traded_days from sta),
ste as materialized (select *, direction = 1 and coalesce(regime in ('Bear', 'StrongBear'), false) supp, coalesce(direction = 1, false) up from stb)"""


def _case(*pairs: tuple[str, str]) -> str:
    return "(case " + " ".join(f"when {c} then {v}" for c, v in pairs) + " else 0 end)"


_BULL, _BEAR = "['EngulfingBullish','MorningStar','ThreeWhiteSoldiers']", "['EngulfingBearish','EveningStar','ThreeBlackCrows']"
_ANY = lambda a, b: f"case when up then list_has_any(patterns, {a}) else list_has_any(patterns, {b}) end"
SCORES: dict[str, tuple[int, str]] = {
    "structure": (25, _case(("trend = direction", "0.6e0"), ("trend = 0", "0"), ("true", "-0.4e0")) + "+" + _case(("bos_dir = direction", "0.25e0")) + "+" + _case(("choch_dir <> direction and choch_rn > coalesce(bos_rn, choch_rn)", "-0.3e0")) + "+" + _case(("case when up then hh else lw2 end", "0.15e0"))),
    "trend": (20, _case(("case when up then ema_20 > ema_50 else ema_20 < ema_50 end", "0.4e0"), ("ema_20 is not null and ema_50 is not null", "-0.2e0")) + "+" + _case(("adx_14 > 25", "0.3e0")) + "+" + _case(("has_ex", "-0.25e0"), ("true", "0.3e0"))),
    "momentum": (15, _case(("case when up then rsi_14 >= 50 else rsi_14 <= 50 end", "0.4e0"), ("rsi_14 is not null", "-0.2e0")) + "+" + _case(("case when up then macd > 0 else macd < 0 end", "0.35e0")) + "+" + _case(("case when up then stoch >= 80 else stoch <= 20 end", "-0.15e0"), ("stoch is not null", "0.25e0"))),
    "volume": (15, _case(("relv > 1.5", "0.5e0"), ("relv < 0.7", "-0.2e0")) + "+" + _case(("has_ab", "-0.3e0")) + "+ 0.2e0"),
    "volatility": (10, _case(("rta between 1 and 2.5", "0.6e0"), ("rta > 2.5", "-0.2e0")) + "+" + _case(("hv is not null", "0.4e0"))),
    "psychology": (5, _case((_ANY(_BULL, _BEAR), "0.7e0")) + "+" + _case((_ANY(_BEAR, _BULL), "-0.5e0"))),
    "support": (5, _case(("case when up then live_long > 0 else live_short > 0 end", "0.8e0"))),
    "strength": (5, _case(("case when up then rs_short > 1 else rs_short < 1 end", "0.6e0"), ("rs_short is not null", "-0.3e0")) + "+" + _case(("not supp", "0.4e0"))),
}

_TOTAL = "score_trend + score_momentum + score_volume + score_volatility + score_psychology + score_support + score_strength"
DECIDED = f"""sc1 as (select *, {', '.join(f'greatest(-{n}e0, least({n}e0, ({x})*{n}e0)) score_{k}' for k, (n, x) in SCORES.items())} from ste),
sc2 as (select *, greatest(0e0, least(100e0, score_structure + {_TOTAL})) confidence,
 traded_days >= 30 g1, not ((direction = 1 and circuit = 'UpperLocked') or (direction = -1 and circuit = 'LowerLocked')) g2, not supp g3, not coalesce(choch_dir <> direction and choch_rn > coalesce(bos_rn, 0), false) g4 from sc1),
sc3 as (select *, case when not g1 then 'DataQuality' when not g2 then 'CircuitLocked' when not g3 then 'RegimeSuppressed' when not g4 then 'StructureBreakAgainstDirection' end gate from sc2),
dec as materialized (select *, case when gate is not null and not (gate = 'RegimeSuppressed' and confidence >= 90) then 'NoTrade' when confidence >= 80 then 'StrongBuy' when confidence >= 65 then 'Buy' when confidence >= 50 then 'Watch' when confidence >= 35 then 'Hold' when confidence >= 20 then 'Sell' else 'StrongSellExit' end outcome from sc3)"""

LAST = "lst as (select * from dec where ts = (select max(ts) from c m where m.symbol_id = dec.symbol_id))"


def plans(src: str) -> str:
    """pln: rows of ``src`` that are Buy or StrongBuy, with their plan."""
    tg = lambda k: f"case when abs(zone - close) < {k}*risk and sg*(zone - close) > 0 then zone else close + sg*{k}*risk end target{k}"
    return f"""pa as (select * from {src} where outcome in ('Buy', 'StrongBuy')),
pz as (select a.symbol_id, a.ts, min(case when a.direction = 1 and z.kind in ('SupplyZone', 'OrderBlockBearish') and z.lower > a.close then z.lower end) za, max(case when a.direction = -1 and z.kind in ('DemandZone', 'OrderBlockBullish') and z.upper < a.close then z.upper end) zb
 from pa a join zm z on z.symbol_id = a.symbol_id and z.created_rn <= a.rn and (z.full_rn is null or z.full_rn > a.rn) group by all),
pd as (select a.symbol_id, a.ts, avg(l.ts - l.st) d, count(*) n from pa a join lg l on l.symbol_id = a.symbol_id and l.leg_kind = 'Impulse' and l.ts <= a.ts and l.ts >= a.ts - interval 6 month group by all),
p0 as (select pa.*, coalesce(za, zb) zone, case when n >= 3 then d end dur, case when direction = 1 then 1e0 else -1e0 end sg from pa left join pz using (symbol_id, ts) left join pd using (symbol_id, ts)),
p1 as (select *, case when direction = 1 then least(close - 1.5*coalesce(atr_14, 0), low_swing) else greatest(close + 1.5*coalesce(atr_14, 0), high_swing) end stop from p0), p2 as (select *, abs(close - stop) risk from p1),
pln as materialized (select *, {tg(1)}, {tg(2)}, {tg(3)} from p2 where risk > 0)"""


_HIT = lambda k: f"case when p.direction = 1 then b.high >= p.target{k} else b.low <= p.target{k} end"
TRADES = f"""aso as (select * from (select *, (rn - 1) % 10 k from dec) where k = 0 and rn >= 60), {plans('aso')},
fw as (select p.symbol_id, p.ts, b.rn, b.ts bts, b.close bc, case when case when p.direction = 1 then b.low <= p.stop else b.high >= p.stop end then 'HitStop' when {_HIT(3)} then 'HitTarget3' when {_HIT(2)} then 'HitTarget2' when {_HIT(1)} then 'HitTarget1' end kind
 from pln p join b on b.symbol_id = p.symbol_id and b.rn > p.rn and b.rn <= p.rn + case when p.dur is null then 40 else greatest(1, cast(ceil(p.dur*5/7) as bigint)) end),
fx as (select symbol_id, ts, min(case when kind is not null then rn end) hrn, arg_min(kind, case when kind is not null then rn end) hk, arg_min(bts, case when kind is not null then rn end) ht, max(rn) ern, arg_max(bc, rn) ec, arg_max(bts, rn) et from fw group by all),
tr0 as (select p.*, coalesce(hk, case when ern is not null then 'TimedOut' end, 'InsufficientForwardData') result, case when hk = 'HitStop' then stop when hk = 'HitTarget3' then target3 when hk = 'HitTarget2' then target2 when hk = 'HitTarget1' then target1 when ern is not null then ec else close end exit_price,
 coalesce(ht, et) exit_ts, coalesce(hrn, ern, p.rn) - p.rn holding from pln p left join fx using (symbol_id, ts)),
trd as materialized (select *, case when result = 'InsufficientForwardData' then 0 else sg*(exit_price - close)/risk end r from tr0)"""


def as_wired(state: str) -> str:
    """``state`` where structure and metrics do not know a candle's own ATR and volume mean."""
    for old, new in (
        ("coalesce(atr_14 > 0 and abs(close - sc) >= 1.5*atr_14, false) or since_bos <= 3", "since_bos <= 3"),
        ("case when volume_sma > 0 then volume/volume_sma end relv, case when atr_14 > 0 then (high - low)/atr_14 end rta", "cast(null as double) relv, cast(null as double) rta"),
        (EXHAUSTION, f"{EXHAUSTION} and false"), ("select * from lg where volume_sma > 0 and", "select * from lg where false and"),
    ):
        if old not in state:
            raise ValueError(f"no {old!r} in the statement")
        state = state.replace(old, new)
    return state


def q(chain: str, select: str) -> str:
    return f"with recursive {chain} {select}"

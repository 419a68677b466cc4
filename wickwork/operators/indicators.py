"""Technical indicators: window expressions where the look-back is bounded, recurrences where it is not.

Recursive columns come from one ordered pass over the first candles of a series, and from scans in blocks over the
rest, so no task holds more than a block. All windows share one partitioning and order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.functions.scalars import direction, ladder, last_n, r4, ratio, series, sign, so_far
from wickwork.functions.staging import staged
from wickwork.operators import scans
from wickwork.operators.scans import Affine, Hold
from wickwork.schema import SERIES


@dataclass(frozen=True)
class Indicator:
    """``columns`` are made by ``window`` (name to expression) or by the fold; the first is the value."""

    key: str
    columns: tuple[str, ...]
    first: int
    warm: int
    signal: Callable[[], Column]
    window: Callable[[], dict[str, Column]] | None = None
    #: Intermediate columns the window expressions read, made before them.
    helpers: Callable[[], dict[str, Column]] | None = None


def _c(name: str) -> Column:
    return F.col(name)


def _from(n: int, value: Column) -> Column:
    """``value`` from the n-th bar on."""
    return F.when(_c("rn") >= n, value)


def _mean(col: str, n: int) -> Column:
    return F.avg(col).over(last_n(n))


def _wma(col: str, n: int, rows: str = "rn") -> Column:
    """Linearly weighted mean, newest heaviest, by two window sums."""
    w = last_n(n)
    return (F.sum(_c(col) * _c(rows)).over(w) - (_c(rows) - n) * F.sum(col).over(w)) / (n * (n + 1) / 2)


def _high(n: int) -> Column:
    return F.max("high").over(last_n(n))


def _low(n: int) -> Column:
    return F.min("low").over(last_n(n))


def _sum(col: Column, n: int) -> Column:
    return F.sum(col).over(last_n(n))


def _regression_lags() -> dict[str, Column]:
    return {f"_y{k}": F.lag("close", k).over(series()) for k in range(1, 20)} | {"_y19_rn": F.lag("rn", 19).over(series())}


def _regression() -> dict[str, Column]:
    """A line through the last 20 closes, of which each is a column: sums of differences, where a sliding frame of
    regressions would go over 20 rows for every candle. Missing closes are left out, by the way of lists; candles that the
    frame at hand has not 20 of have no line.
    """
    n, y = 20, [_c("close"), *(_c(f"_y{k}") for k in range(1, 20))]
    d = [v - y[0] for v in y[1:]]
    moved = sum(d[1:], d[0])
    tilt = sum((((n - 1) / 2 - k) * (y[k] - y[n - 1 - k]) for k in range(1, n // 2)), (n - 1) / 2 * (y[0] - y[-1]))
    sxx = n * (n * n - 1) / 12
    slope = tilt / sxx
    value, spread = y[0] + moved / n + (n - 1) / 2 * slope, sum((v * v for v in d[1:]), d[0] * d[0]) - moved * moved / n - slope * slope * sxx
    points = F.filter(F.transform(F.array(*y), lambda v, k: F.struct((-k).cast("double").alias("x"), v.alias("y"))), lambda p: p["y"].isNotNull())
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p))
    held = F.when(F.size(points) > 0, F.size(points))
    mx, my = total(lambda p: p["x"]) / held, total(lambda p: p["y"]) / held
    over = total(lambda p: (p["x"] - mx) * (p["x"] - mx))
    some = total(lambda p: (p["x"] - mx) * (p["y"] - my)) / F.when(over > 0, over)
    whole = lambda a, b: F.when(moved.isNotNull(), a).when(_c("_y19_rn").isNotNull(), b)
    at = whole(value, my - some * mx)
    rest = F.sqrt(F.greatest(whole(spread, total(lambda p: (p["y"] - my) * (p["y"] - my)) - some * some * over), F.lit(0.0)) / n)
    return {"regression": _from(20, at), "regression_upper": _from(20, at + 2 * rest), "regression_lower": _from(20, at - 2 * rest), "regression_slope": _from(20, whole(slope, some))}


def _cci() -> dict[str, Column]:
    mean = F.avg("tp").over(last_n(20))
    dev = F.aggregate(F.transform(F.collect_list("tp").over(last_n(20)), lambda x: F.abs(x - mean)), F.lit(0.0), lambda a, b: a + b) / 20
    return {"cci_20": _from(20, ratio(_c("tp") - mean, 0.015 * dev, 0))}


def _mfi() -> dict[str, Column]:
    flow = _c("tp") * _c("volume")
    up, down = _sum(F.when(_c("tp") > _c("tp_1"), flow).otherwise(0.0), 14), _sum(F.when(_c("tp") < _c("tp_1"), flow).otherwise(0.0), 14)
    return {"mfi_14": _from(15, F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.when(down != 0, down))))}


def _bollinger() -> dict[str, Column]:
    m, s = _mean("close", 20), F.stddev_pop("close").over(last_n(20))
    return {"bollinger": _from(20, m), "bollinger_upper": _from(20, m + 2 * s), "bollinger_lower": _from(20, m - 2 * s), "bollinger_bandwidth": _from(20, ratio(4 * s * 100, m, 0))}


def _stochastic() -> dict[str, Column]:
    k = _c("stoch_k")
    return {"stochastic_k": k, "stochastic_d": _from(16, F.avg("stoch_k").over(last_n(3)))}


def _obv_signal() -> Column:
    before = F.lag("obv", 4).over(series())
    return F.when(before.isNull(), "Neutral").otherwise(sign(_c("obv") - before))


WINDOWS: tuple[Indicator, ...] = (
    *(Indicator(f"SMA_{n}", (f"sma_{n}",), n, n, lambda n=n: direction(_c("close"), _c(f"sma_{n}")), lambda n=n: {f"sma_{n}": _from(n, _mean("close", n))}) for n in (20, 50)),
    Indicator("WMA_20", ("wma_20",), 20, 20, lambda: direction(_c("close"), _c("wma_20")), lambda: {"wma_20": _from(20, _wma("close", 20))}),
    Indicator("HMA_20", ("hma_20",), 23, 24, lambda: direction(_c("close"), _c("hma_20")), lambda: {"hma_20": _from(23, _wma("hma_raw", 4))}, lambda: {"hma_raw": _from(20, 2 * _wma("close", 10) - _wma("close", 20))}),
    Indicator("VWMA_20", ("vwma_20",), 20, 20, lambda: direction(_c("close"), _c("vwma_20")), lambda: {"vwma_20": _from(20, ratio(_sum(_c("close") * _c("volume"), 20), _sum(_c("volume"), 20)))}),
    Indicator("RegressionChannel_20", ("regression", "regression_upper", "regression_lower", "regression_slope"), 20, 20, lambda: sign(_c("regression_slope")), _regression, _regression_lags),
    Indicator("Donchian_20", ("donchian_mid", "donchian_upper", "donchian_lower"), 20, 20, lambda: F.when(_c("close") >= _c("donchian_upper"), "Bullish").when(_c("close") <= _c("donchian_lower"), "Bearish").otherwise("Neutral"), lambda: {"donchian_mid": _from(20, (_high(20) + _low(20)) / 2), "donchian_upper": _from(20, _high(20)), "donchian_lower": _from(20, _low(20))}),
    Indicator(
        "Ichimoku_9_26_52", ("kijun", "tenkan", "senkou_a", "senkou_b", "chikou"), 26, 52, lambda: direction(_c("close"), _c("kijun")),
        lambda: {"kijun": _from(26, (_high(26) + _low(26)) / 2), "tenkan": _from(9, (_high(9) + _low(9)) / 2), "senkou_a": _from(26, ((_high(9) + _low(9)) / 2 + (_high(26) + _low(26)) / 2) / 2), "senkou_b": _from(52, (_high(52) + _low(52)) / 2), "chikou": _c("close")},
    ),
    Indicator("Stochastic_14_3", ("stochastic_k", "stochastic_d"), 14, 17, lambda: F.when(_c("stochastic_d").isNull(), "Neutral").otherwise(ladder(_c("stochastic_k"), 80, 20, 50)), _stochastic, lambda: {"stoch_k": _from(14, ratio((_c("close") - _low(14)) * 100, _high(14) - _low(14), 50))}),
    Indicator("CCI_20", ("cci_20",), 20, 20, lambda: ladder(_c("cci_20"), 100, -100, 0), _cci),
    Indicator("ROC_12", ("roc_12",), 13, 13, lambda: sign(_c("roc_12")), lambda: {"roc_12": _from(13, ratio((_c("close") - F.lag("close", 12).over(series())) * 100, F.lag("close", 12).over(series()), 0))}),
    Indicator("WilliamsR_14", ("williams_r",), 14, 14, lambda: ladder(_c("williams_r"), -20, -80, -50), lambda: {"williams_r": _from(14, ratio((_high(14) - _c("close")) * -100, _high(14) - _low(14), -50))}),
    Indicator("StdDev_20", ("stddev_20",), 20, 20, lambda: F.lit("Neutral"), lambda: {"stddev_20": _from(20, F.stddev_pop("close").over(last_n(20)))}),
    Indicator("BollingerBands_20_2", ("bollinger", "bollinger_upper", "bollinger_lower", "bollinger_bandwidth"), 20, 20, lambda: F.when(_c("close") >= _c("bollinger_upper"), "Overbought").when(_c("close") <= _c("bollinger_lower"), "Oversold").otherwise("Neutral"), _bollinger),
    Indicator("HistVol_20", ("hist_vol",), 21, 21, lambda: F.lit("Neutral"), lambda: {"hist_vol": _from(21, F.stddev_samp("log_ret").over(last_n(20)) * (252**0.5) * 100)}),
    Indicator("RangeCompressionExpansion_20", ("range_ratio",), 20, 20, lambda: F.when(_c("range_ratio") <= 0.6, "Compression").when(_c("range_ratio") >= 1.5, "Expansion").otherwise("Neutral"), lambda: {"range_ratio": _from(20, ratio(_c("tr"), _mean("tr", 20), 1))}),
    Indicator("OBV", ("obv",), 1, 2, _obv_signal, lambda: {"obv": F.sum(F.when(_c("close") > _c("close_1"), _c("volume")).when(_c("close") < _c("close_1"), -_c("volume")).otherwise(0)).over(so_far()).cast("double")}),
    Indicator("VolumeSMA_20", ("volume_sma",), 20, 20, lambda: F.when(_c("volume_sma").isNull(), "Neutral").when(_c("volume") > _c("volume_sma"), "AboveAverage").otherwise("BelowAverage"), lambda: {"volume_sma": _from(20, _mean("volume", 20))}),
    Indicator("VolumeSpike_20_2", ("volume_spike",), 20, 20, lambda: F.when(_c("volume_spike").isNull(), "Neutral").when(_c("volume_spike") >= 2, "VolumeSpike").otherwise("Normal"), lambda: {"volume_spike": _from(20, ratio(_c("volume").cast("double"), _mean("volume", 20)))}),
    Indicator("VWAP", ("vwap",), 1, 1, lambda: direction(_c("close"), _c("vwap")), lambda: {"vwap": ratio(F.sum(_c("tp") * _c("volume")).over(so_far()), F.sum("volume").over(so_far()))}),
    Indicator("RollingVWAP_20", ("rolling_vwap",), 20, 20, lambda: direction(_c("close"), _c("rolling_vwap")), lambda: {"rolling_vwap": _from(20, ratio(_sum(_c("tp") * _c("volume"), 20), _sum(_c("volume"), 20)))}),
    Indicator("CMF_20", ("cmf_20",), 20, 20, lambda: F.when(_c("cmf_20") > 0.05, "Bullish").when(_c("cmf_20") < -0.05, "Bearish").otherwise("Neutral"), lambda: {"cmf_20": _from(20, ratio(_sum(ratio((_c("close") - _c("low")) - (_c("high") - _c("close")), _c("high") - _c("low"), 0) * _c("volume"), 20), _sum(_c("volume"), 20), 0))}),
    Indicator("MFI_14", ("mfi_14",), 15, 15, lambda: ladder(_c("mfi_14"), 80, 20, 50), _mfi),
)

FOLDS: tuple[Indicator, ...] = (
    *(Indicator(f"EMA_{n}", (f"ema_{n}",), n, n, lambda n=n: direction(_c("close"), _c(f"ema_{n}"))) for n in (20, 50)),
    Indicator("DEMA_20", ("dema_20",), 39, 40, lambda: direction(_c("close"), _c("dema_20"))),
    Indicator("TEMA_20", ("tema_20",), 58, 60, lambda: direction(_c("close"), _c("tema_20"))),
    Indicator("KAMA_10", ("kama_10",), 11, 11, lambda: direction(_c("close"), _c("kama_10"))),
    Indicator("SuperTrend_14_3", ("supertrend", "supertrend_up"), 14, 15, lambda: F.when(_c("supertrend_up") == 1, "Bullish").when(_c("supertrend_up") == 0, "Bearish").otherwise("Neutral")),
    Indicator("RSI_14", ("rsi_14",), 15, 15, lambda: ladder(_c("rsi_14"), 70, 30, 50)),
    Indicator("MACD_12_26_9", ("macd", "macd_signal", "macd_hist"), 26, 35, lambda: F.when(_c("macd_signal").isNull(), "Neutral").otherwise(sign(_c("macd") - _c("macd_signal")))),
    Indicator("ADX_14", ("adx_14", "di_plus", "di_minus"), 28, 28, lambda: F.when(_c("adx_14") >= 25, F.when(_c("di_plus") > _c("di_minus"), "Bullish").otherwise("Bearish")).otherwise("Neutral")),
    Indicator("StochRSI_14_14_3", ("stoch_rsi_k", "stoch_rsi_d"), 28, 31, lambda: F.when(_c("stoch_rsi_d").isNull(), "Neutral").otherwise(ladder(_c("stoch_rsi_k"), 80, 20, 50))),
    Indicator("TRIX_15", ("trix_15",), 44, 46, lambda: sign(_c("trix_15"))),
    Indicator("ATR_14", ("atr_14",), 14, 14, lambda: F.lit("Neutral")),
    Indicator("KeltnerChannel_20", ("keltner", "keltner_upper", "keltner_lower"), 20, 20, lambda: F.when(_c("close") > _c("keltner_upper"), "Bullish").when(_c("close") < _c("keltner_lower"), "Bearish").otherwise("Neutral")),
    Indicator("VolumeEMA_20", ("volume_ema",), 20, 20, lambda: F.when(_c("volume") > 1.5 * _c("volume_ema"), "Bullish").when(_c("volume") < 0.5 * _c("volume_ema"), "Bearish").otherwise("Neutral")),
)

REGISTRY: dict[str, Indicator] = {i.key: i for i in (*WINDOWS, *FOLDS)}
FOLD_COLUMNS: tuple[str, ...] = tuple(c for i in FOLDS for c in i.columns)


def prepared(candles: DataFrame) -> DataFrame:
    """Candles with bar number, previous closes, typical price, true range and log return.

    ``error`` says which value was missing first, from that candle on: what is worked out from a series ends there, and
    no other series is touched.
    """
    w = series()
    pc = F.lag("close").over(w)
    tp = (_c("high") + _c("low") + _c("close")) / 3
    out = candles.withColumns({"rn": F.row_number().over(w), "close_1": pc, "tp": tp, "log_ret": F.when(pc > 0, F.log(_c("close") / pc)), "tr": F.greatest(_c("high") - _c("low"), F.abs(_c("high") - pc), F.abs(_c("low") - pc))})
    missing = F.coalesce(*(F.when(_c(x).isNull(), F.concat(F.lit(f"null {x} on "), _c("ts").cast("date").cast("string"))) for x in ("high", "low", "close", "volume")))
    return out.withColumns({"tp_1": F.lag("tp").over(w), "error": F.first(missing, ignorenulls=True).over(so_far())})


def window_indicators(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``prepared`` candles with the columns of window indicators."""
    chosen = [i for i in WINDOWS if keys is None or i.key in keys]
    helpers = {k: v for i in chosen if i.helpers for k, v in i.helpers().items()}
    if helpers:
        bars = bars.withColumns(helpers)
    return bars.withColumns({k: v for i in chosen for k, v in i.window().items()}).drop(*helpers)


def _ema(xs, n):
    """Mean of the first n values that are not None, then e += (x - e) * 2 / (n + 1)."""
    out, seed, e, k = [], [], None, 2 / (n + 1)
    for x in xs:
        if x is not None:
            if e is not None:
                e += (x - e) * k
            else:
                seed.append(x)
                if len(seed) == n:
                    e = sum(seed) / n
        out.append(e)
    return out


def _wilder(xs, n):
    out, seed, e = [], [], None
    for x in xs:
        if x is not None:
            if e is not None:
                e = (e * (n - 1) + x) / n
            else:
                seed.append(x)
                if len(seed) == n:
                    e = sum(seed) / n
        out.append(e)
    return out


def _each(f, *columns):
    return [None if None in row else f(*row) for row in zip(*columns, strict=True)]


def _kama(c, n=10):
    out, e = [], None
    moves = [0.0, *(abs(b - a) for a, b in zip(c, c[1:], strict=False))]
    for i in range(len(c)):
        if i >= n:
            if e is None:
                e = c[i]
            else:
                noise = sum(moves[i - n + 1 : i + 1])
                er = abs(c[i] - c[i - n]) / noise if noise else 0.0
                e += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - e)
        out.append(e)
    return out


def _supertrend(h, lo, c, atr, multiple=3.0):
    value, up, upper, lower, rising = [], [], None, None, None
    for i, a in enumerate(atr):
        if a is None:
            value.append(None)
            up.append(None)
            continue
        mid = (h[i] + lo[i]) / 2
        high, low = mid + multiple * a, mid - multiple * a
        if upper is None:
            upper, lower, rising = high, low, c[i] >= mid
        else:
            upper = high if high < upper or c[i] > upper else upper
            lower = low if low > lower or c[i] < lower else lower
            rising = c[i] >= lower if rising else c[i] > upper
        value.append(lower if rising else upper)
        up.append(1.0 if rising else 0.0)
    return value, up


def _rsi(c, n=14):
    change = [None, *(b - a for a, b in zip(c, c[1:], strict=False))]
    gain, loss = (_wilder([None if d is None else max(s * d, 0.0) for d in change], n) for s in (1, -1))
    return _each(lambda g, x: (50.0 if g == 0 else 100.0) if x == 0 else 100 - 100 / (1 + g / x), gain, loss)


def _adx(h, lo, tr, n=14):
    plus, minus = [None], [None]
    for i in range(1, len(h)):
        up, down = h[i] - h[i - 1], lo[i - 1] - lo[i]
        plus.append(up if up > down and up > 0 else 0.0)
        minus.append(down if down > up and down > 0 else 0.0)

    def smooth(xs):
        out, seed, e = [], [], None
        for x in xs:
            if x is not None:
                if e is not None:
                    e = e - e / n + x
                else:
                    seed.append(x)
                    e = sum(seed) if len(seed) == n else None
            out.append(e)
        return out

    t, p, m = smooth([None, *tr[1:]]), smooth(plus), smooth(minus)
    dip, dim = (_each(lambda x, r: 100 * x / r if r else 0.0, s, t) for s in (p, m))
    dx = _each(lambda a, b: 100 * abs(a - b) / (a + b) if a + b else 0.0, dip, dim)
    return _wilder(dx, n), dip, dim


def _stoch_rsi(rsi, n=14, d=3):
    k, out, seen = [], [], []
    for x in rsi:
        if x is not None:
            seen.append(x)
        if len(seen) < n:
            k.append(None)
        else:
            low, high = min(seen[-n:]), max(seen[-n:])
            k.append((x - low) / (high - low) * 100 if high > low else 50.0)
        out.append(sum(k[-d:]) / d if len(k) >= d and None not in k[-d:] else None)
    return k, out


def fold_series(h, lo, c, v, tr, wanted=None) -> dict[str, list]:
    """Every recursive column of one series, oldest bar first."""
    need = lambda *names: wanted is None or any(x in wanted for x in names)
    out: dict[str, list] = {}
    if need("ema_20", "dema_20", "tema_20", "keltner", "keltner_upper", "keltner_lower"):
        out["ema_20"] = _ema(c, 20)
    if need("ema_50"):
        out["ema_50"] = _ema(c, 50)
    if need("dema_20", "tema_20"):
        e1 = out["ema_20"]
        e2 = _ema(e1, 20)
        out["dema_20"] = _each(lambda a, b: 2 * a - b, e1, e2)
        out["tema_20"] = _each(lambda a, b, d: 3 * a - 3 * b + d, e1, e2, _ema(e2, 20))
    if need("kama_10"):
        out["kama_10"] = _kama(c)
    if need("atr_14", "supertrend", "supertrend_up"):
        out["atr_14"] = _wilder(tr, 14)
    if need("supertrend", "supertrend_up"):
        out["supertrend"], out["supertrend_up"] = _supertrend(h, lo, c, out["atr_14"])
    if need("rsi_14", "stoch_rsi_k", "stoch_rsi_d"):
        out["rsi_14"] = _rsi(c)
    if need("stoch_rsi_k", "stoch_rsi_d"):
        out["stoch_rsi_k"], out["stoch_rsi_d"] = _stoch_rsi(out["rsi_14"])
    if need("macd", "macd_signal", "macd_hist"):
        out["macd"] = _each(lambda a, b: a - b, _ema(c, 12), _ema(c, 26))
        out["macd_signal"] = _ema(out["macd"], 9)
        out["macd_hist"] = _each(lambda a, b: a - b, out["macd"], out["macd_signal"])
    if need("adx_14", "di_plus", "di_minus"):
        out["adx_14"], out["di_plus"], out["di_minus"] = _adx(h, lo, tr)
    if need("trix_15"):
        e = _ema(_ema(_ema(c, 15), 15), 15)
        out["trix_15"] = _each(lambda a, b: (b - a) / a * 100 if a else 0.0, [None, *e[:-1]], e)
    if need("keltner", "keltner_upper", "keltner_lower"):
        a = _wilder(tr, 20)
        out["keltner"] = out["ema_20"]
        out["keltner_upper"] = _each(lambda m, r: m + 2 * r, out["ema_20"], a)
        out["keltner_lower"] = _each(lambda m, r: m - 2 * r, out["ema_20"], a)
    if need("volume_ema"):
        out["volume_ema"] = _ema(v, 20)
    return {k: x for k, x in out.items() if wanted is None or k in wanted}


#: Candles of a series that one task folds at once; longer series go through ``scans`` in blocks of this size.
BLOCK = 65_536


def fold_indicators(bars: DataFrame, columns: tuple[str, ...] | None = None, block: int = BLOCK) -> DataFrame:
    """``prepared`` candles with the recursive columns.

    The first ``block`` candles of every series are one ordered pass in Arrow; those after them are scanned in blocks.
    """
    import pyarrow as pa

    wanted = [c for c in FOLD_COLUMNS if columns is None or c in columns]
    bars = staged(bars, "bars")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("ts")
        error = t.column("error").to_pylist()
        whole = next((k for k, e in enumerate(error) if e is not None), len(error))  # candles before the first failure
        try:
            made = fold_series(*(t.column(x).slice(0, whole).to_pylist() for x in ("high", "low", "close", "volume", "tr")), set(wanted))
        except Exception as failed:  # one series fails by itself: its rows say why
            made, error = {k: [] for k in wanted}, [e or f"{type(failed).__name__}: {failed}" for e in error]
            t = t.set_column(t.column_names.index("error"), "error", pa.array(error, pa.string()))
        for k in wanted:
            t = t.append_column(k, pa.array(made[k] + [None] * (t.num_rows - len(made[k])), pa.float64()))
        return t

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    head = bars.filter(F.col("rn") <= block).groupBy(*SERIES).applyInArrow(run, fields + "".join(f", {k} double" for k in wanted))
    long = bars.filter(F.col("rn") > block).select(*SERIES).distinct()
    if long.isEmpty():
        return head
    tail = long_series(bars.join(staged(long, "long-series"), SERIES, "left_semi"), wanted, block)
    known = {k: F.when(F.col("error").isNull(), F.col(k)) for k in wanted}
    return head.unionByName(tail.filter(F.col("rn") > block).withColumns(known))


def _mean_from(x: str, n: int, at: int, k: float) -> Affine:
    """x' = x + k (value - x), from the mean of the last n values at candle ``at`` on."""
    rn, seed = _c("rn"), _mean(x, n)
    return Affine(F.when(rn == at, 0.0).when(rn > at, 1 - k), F.when(rn == at, seed).otherwise(_c(x) * k))


def _ema_step(x: str, n: int, first: int = 1) -> Affine:
    """The moving average of a column that has values from candle ``first`` on."""
    return _mean_from(x, n, first + n - 1, 2 / (n + 1))


def _wilder_step(x: str, n: int, first: int = 1) -> Affine:
    return _mean_from(x, n, first + n - 1, 1 / n)


def _sum_step(x: str, n: int, first: int) -> Affine:
    rn, at = _c("rn"), first + n - 1
    return Affine(F.when(rn == at, 0.0).when(rn > at, 1 - 1 / n), F.when(rn == at, _sum(_c(x), n)).otherwise(_c(x)))


def _kama_step(n: int = 10) -> Affine:
    rn, w = _c("rn"), series()
    noise = _sum(F.abs(_c("close") - _c("close_1")), n)
    er = ratio(F.abs(_c("close") - F.lag("close", n).over(w)), noise, 0)
    k = F.pow(er * (2 / 3 - 2 / 31) + 2 / 31, F.lit(2.0))
    return Affine(F.when(rn == n + 1, 0.0).when(rn > n + 1, 1 - k), F.when(rn == n + 1, _c("close")).otherwise(k * _c("close")))


def long_series(bars: DataFrame, wanted: list[str], block: int) -> DataFrame:
    """``prepared`` candles of long series with the recursive columns ``wanted``, by scans of blocks, level by level."""
    need = lambda *names: any(x in wanted for x in names)
    before = bars.columns
    w = series()
    change, up, down = _c("close") - _c("close_1"), _c("high") - F.lag("high").over(w), F.lag("low").over(w) - _c("low")
    rows = bars.withColumns({
        "_v": _c("volume").cast("double"), "_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0)),
        "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    steps: dict[str, Affine | Hold] = {}
    if need("ema_20", "dema_20", "tema_20", "keltner", "keltner_upper", "keltner_lower"):
        steps["e20"] = _ema_step("close", 20)
    if need("ema_50"):
        steps["e50"] = _ema_step("close", 50)
    if need("macd", "macd_signal", "macd_hist"):
        steps |= {"e12": _ema_step("close", 12), "e26": _ema_step("close", 26)}
    if need("trix_15"):
        steps["t1"] = _ema_step("close", 15)
    if need("kama_10"):
        steps["k10"] = _kama_step()
    if need("atr_14", "supertrend", "supertrend_up"):
        steps["a14"] = _wilder_step("tr", 14)
    if need("keltner_upper", "keltner_lower"):
        steps["a20"] = _wilder_step("tr", 20)
    if need("rsi_14", "stoch_rsi_k", "stoch_rsi_d"):
        steps |= {"g14": _wilder_step("_gain", 14, 2), "l14": _wilder_step("_loss", 14, 2)}
    if need("adx_14", "di_plus", "di_minus"):
        steps |= {"s_tr": _sum_step("tr", 14, 2), "s_plus": _sum_step("_plus", 14, 2), "s_minus": _sum_step("_minus", 14, 2)}
    if need("volume_ema"):
        steps["v20"] = _ema_step("_v", 20)
    rows = scans.run(rows, steps, block)
    own = dict(zip(("ema_20", "ema_50", "kama_10", "atr_14", "volume_ema", "keltner"), ("e20", "e50", "k10", "a14", "v20", "e20"), strict=True))
    made = {k: _c(v) for k, v in own.items() if need(k)}
    if need("keltner_upper", "keltner_lower"):
        made |= {"keltner_upper": _c("e20") + 2 * _c("a20"), "keltner_lower": _c("e20") - 2 * _c("a20")}
    if "g14" in steps:
        made["rsi_14"] = F.when(_c("l14") == 0, F.when(_c("g14") == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + _c("g14") / F.when(_c("l14") != 0, _c("l14"))))
    if "e12" in steps:
        made["macd"] = _c("e12") - _c("e26")
    if "s_tr" in steps:
        share = lambda x: ratio(100 * _c(x), _c("s_tr"), 0)
        both = share("s_plus") + share("s_minus")
        made |= {"di_plus": share("s_plus"), "di_minus": share("s_minus"), "_dx": ratio(100 * F.abs(share("s_plus") - share("s_minus")), both, 0)}
    rows = rows.withColumns(made)
    steps = {}
    if need("dema_20", "tema_20"):
        steps["e20_2"] = _ema_step("e20", 20, 20)
    if need("trix_15"):
        steps["t2"] = _ema_step("t1", 15, 15)
    if need("macd", "macd_signal", "macd_hist"):
        steps["m9"] = _ema_step("macd", 9, 26)
    if need("adx_14", "di_plus", "di_minus"):
        steps["adx_14"] = _wilder_step("_dx", 14, 15)
    if need("supertrend", "supertrend_up"):
        rows, mid, seed = rows.withColumn("_mid", (_c("high") + _c("low")) / 2), F.lit(None).cast("double"), _c("rn") == 14
        top, bottom, close = _c("_mid") + 3 * _c("a14"), _c("_mid") - 3 * _c("a14"), _c("close")
        never, live = F.lit(float("inf")), _c("rn") > 14
        steps["_upper"] = Hold(F.when(seed, never).when(live, close), F.when(seed, -never).when(live, top), F.when(live | seed, top).otherwise(mid))
        steps["_lower"] = Hold(F.when(seed, never).when(live, bottom), F.when(seed, -never).when(live, close), F.when(live | seed, bottom).otherwise(mid))
    rows = scans.run(rows, steps, block) if steps else rows
    made = {}
    if "m9" in steps:
        made |= {"macd_signal": _c("m9"), "macd_hist": _c("macd") - _c("m9")}
    if "e20_2" in steps:
        made["dema_20"] = 2 * _c("e20") - _c("e20_2")
    if need("stoch_rsi_k", "stoch_rsi_d"):
        low, high = F.min("rsi_14").over(last_n(14)), F.max("rsi_14").over(last_n(14))
        made["stoch_rsi_k"] = F.when(_c("rn") >= 28, F.when(high > low, (_c("rsi_14") - low) / (high - low) * 100).otherwise(50.0))
    rows = rows.withColumns(made) if made else rows
    steps = {}
    if "_upper" in rows.columns:
        above, over, live = (_c("close") >= _c("_lower")).cast("double"), (_c("close") > _c("_upper")).cast("double"), _c("rn") > 14
        steps["supertrend_up"] = Affine(F.when(_c("rn") == 14, 0.0).when(live, above - over), F.when(_c("rn") == 14, (_c("close") >= _c("_mid")).cast("double")).otherwise(over))
    if need("tema_20"):
        steps["e20_3"] = _ema_step("e20_2", 20, 39)
    if need("trix_15"):
        steps["t3"] = _ema_step("t2", 15, 29)
    rows = scans.run(rows, steps, block) if steps else rows
    made = {}
    if "supertrend_up" in steps:
        made["supertrend"] = F.when(_c("supertrend_up") == 1, _c("_lower")).otherwise(_c("_upper"))
    if "e20_3" in steps:
        made["tema_20"] = 3 * _c("e20") - 3 * _c("e20_2") + _c("e20_3")
    if "t3" in steps:
        last = F.lag("t3").over(w)
        made["trix_15"] = F.when(last.isNotNull(), ratio((_c("t3") - last) * 100, last, 0))
    if need("stoch_rsi_d"):
        made["stoch_rsi_d"] = F.when(_c("rn") >= 30, F.avg("stoch_rsi_k").over(last_n(3)))
    return rows.withColumns(made).select(*before, *wanted) if made else rows.select(*before, *wanted)


def indicator_frame(candles: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Candles with the columns of every indicator or of those in ``keys``: the fold over narrow rows first, then the windows."""
    folded = None if keys is None else tuple(c for i in FOLDS if i.key in keys for c in i.columns)
    return window_indicators(fold_indicators(prepared(candles), folded), None if keys is None else list(keys))


#: Window indicators that sum from a series' first candle on; all others look back by less than ``RECENT`` candles.
CUMULATIVE = ("OBV", "VWAP")
RECENT = 64


def tail_of(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` candles of each series (series, rn, ...): the last numbers are found in the keys and written, so that
    their size is known and no other candle is moved where they are few.
    """
    last = staged(rows.groupBy(*SERIES).agg(F.max("rn").alias("_last")), "last-numbers")
    return rows.join(last, SERIES).filter(F.col("rn") > F.col("_last") - n).drop("_last")


def recent_indicators(folded: DataFrame) -> DataFrame:
    """The last ``RECENT`` candles of each series of ``folded`` (see ``fold_indicators``) with every indicator's columns.

    Those of the last five are whole. Sliding windows cost their length a candle, so they are worked out for these alone;
    cumulative ones that ``folded`` has are taken as they are, and the candles before are not moved.
    """
    due = [k for k in CUMULATIVE if not set(REGISTRY[k].columns) <= set(folded.columns)]
    if due:
        rows = window_indicators(folded, due).withColumn("_later", F.lead("rn", RECENT).over(series())).filter(F.col("_later").isNull()).drop("_later")
    else:
        rows = staged(tail_of(folded, RECENT), "recent")
    return window_indicators(rows, [i.key for i in WINDOWS if i.key not in CUMULATIVE])


def last_indicators(candles: DataFrame) -> DataFrame:
    """``recent_indicators`` of ``candles``."""
    return recent_indicators(fold_indicators(prepared(candles)))


def indicator(candles: DataFrame, key: str, rounded: bool = False) -> DataFrame:
    """symbol_id, timeframe, ts, the columns and the signal of one indicator; ``rounded`` to four decimals first."""
    i = REGISTRY[key]
    bars = prepared(candles)
    bars = window_indicators(bars, [key]) if i.window else fold_indicators(bars.select(*SERIES, "ts", "high", "low", "close", "close_1", "volume", "tr", "rn", "error"), i.columns)
    if rounded:
        bars = bars.withColumns({c: r4(F.col(c)) for c in i.columns})
    return bars.select(*SERIES, "ts", *i.columns, i.signal().alias("signal"))


def _confidence(i: Indicator) -> Column:
    """1 with a value and 0 without; two-line oscillators need their second line, OBV its look-back, a cloud all its span."""
    value = _c(i.columns[0]).isNotNull()
    second = {"Stochastic_14_3": "stochastic_d", "StochRSI_14_14_3": "stoch_rsi_d", "MACD_12_26_9": "macd_signal", "OBV": "_obv_4"}.get(i.key)
    if second:
        value = value & _c(second).isNotNull()
    if i.key == "Ichimoku_9_26_52":
        return F.when(value, F.when(_c("rn") >= i.warm, 1.0).otherwise(0.5)).otherwise(0.0)
    return F.when(value, 1.0).otherwise(0.0)


def snapshot(frame: DataFrame) -> DataFrame:
    """The latest value, signal, confidence and health of every indicator, one row a series and indicator.

    The last candle of each series is picked before anything is built on it; the one signal that looks back comes first.
    """
    last = frame.withColumns({"_next": F.lead("ts").over(series()), "_obv_signal": _obv_signal(), "_obv_4": F.lag("obv", 4).over(series())}).filter(F.col("_next").isNull())
    signal = lambda i: F.col("_obv_signal") if i.key == "OBV" else i.signal()
    health = lambda i: F.when((F.col("rn") < i.warm) | (_confidence(i) == 0), "InsufficientData").otherwise("Ok")
    values = [
        F.struct(F.lit(i.key).alias("indicator_key"), F.col(i.columns[0]).cast("double").alias("value"), signal(i).alias("signal_state"), _confidence(i).alias("confidence"), health(i).alias("health"))
        for i in REGISTRY.values()
    ]
    return last.select(*SERIES, "ts", F.inline(F.array(*values)))

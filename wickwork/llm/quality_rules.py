"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions alone.

Per language and source, and over all rows, the minimum covariance determinant (MCD) is sought from four fixed starts:
mean and variances, medians and median deviations, spatial signs, and hyperbolic tangents of the robust z-values. A
concentration step takes mean and covariance of the share ``h`` of rows nearest to the current centre. All starts make two
steps, the one with the least determinant goes on until its determinant falls no more. A step is one pass: rows are binned
by log squared distance, moments are pre-aggregated per (group, bin), and the bins that hold the nearest share are summed,
of the last one the part that makes up ``h``. The estimate of a group is drawn towards that of all rows as by
``prior_rows`` rows of its own. Rows beyond the chi-square quantile of 1 - ``tail`` are rejected.

Defined results: null or empty text counts no words and fails the base rule; null lang or source form groups of their
own; groups of failed rows alone are measured against all rows; with no row that passes the base rule none is measured;
repeated rows count as often as they occur; empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import staged, text_of

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
POS_BITS = 24
FEATURES = ("f_len", "f_sym", "f_dup", "f_rep", "f_words")
D = len(FEATURES)
GROUP = ["start", "_lang", "_source"]
#: Groups whose estimates (about 400 bytes each) are broadcast; beyond it they are joined.
BROADCAST_GROUPS = 20_000


@dataclass(frozen=True)
class McdOptions:
    h: float = 0.75
    bins_per_e: int = 32
    #: Standard deviations added in quadrature to each feature: the resolution below which a difference means nothing.
    floors: tuple[float, ...] = (0.05, 0.04, 0.06, 0.06, 0.8)
    #: Rows of the all-rows estimate that are added to each group's own.
    prior_rows: float = 60.0
    #: Share of a normal population beyond the cut. Text statistics have longer tails than normal ones.
    tail: float = 1e-10
    #: Least fall of the log determinant that another step is made for.
    fall: float = 1e-4


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function with ``k`` degrees of freedom, by the series of the lower gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def consistency(h: float) -> float:
    """Factor that makes the covariance of the nearest share ``h`` of a normal population that of the whole."""
    return h / chi2_cdf(chi2_quantile(h, D), D + 2) if h < 1 else 1.0


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Windows become (hash, position) codes, sorted; neighbours of equal hash are compared word by word. Where any are not
    equal, the windows themselves are sorted. Up to 2^24 words a code is one long, beyond that a struct.
    """

    def covered(codes: Column, pos, near, equal, otherwise) -> Column:
        """Words covered by windows whose neighbour is equal; ``otherwise`` where different windows share a code."""

        def found(s: Column) -> Column:
            same = lambda a, b: near(a, b) & equal(a, b)
            hits = F.filter(s, lambda x, i: ((i > 0) & same(F.get(s, i - 1), x)) | ((i < F.size(s) - 1) & same(x, F.get(s, i + 1))))
            at = F.sort_array(F.transform(hits, lambda x: pos(x)))
            steps = lambda p: F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))))
            out = _let(at, lambda p: F.aggregate(steps(p), F.lit(0).cast("long"), lambda a, b: a + b))
            if otherwise is None:
                return out
            mixed = F.filter(s, lambda x, i: (i > 0) & near(F.get(s, i - 1), x) & ~equal(F.get(s, i - 1), x))
            return F.when(F.size(mixed) > 0, otherwise).otherwise(out)

        return _let(F.sort_array(codes), found)

    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    digest = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    at = lambda pos: lambda a, b: (words[pos(a)] == words[pos(b)]) & (words[pos(a) + 1] == words[pos(b) + 1]) & (words[pos(a) + 2] == words[pos(b) + 2])
    field = lambda x: x["i"]
    whole = F.transform(starts, lambda i: F.struct(words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i")))
    exact = covered(whole, field, at(field), lambda a, b: F.lit(True), None)
    low = lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")
    packed = covered(
        F.transform(starts, lambda i: F.shiftleft(digest(i), POS_BITS).bitwiseOR(i.cast("long"))), low,
        lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), POS_BITS) == 0, at(low), exact,
    )
    wide = covered(F.transform(starts, lambda i: F.struct(digest(i).alias("h"), i.alias("i"))), field, lambda a, b: a["h"] == b["h"], at(field), exact)
    return F.when(n < 3, F.lit(0).cast("long")).when(n < (1 << POS_BITS), packed).otherwise(wide)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = text_of()
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    out = docs.withColumns({"_w": F.filter(F.split(t, SPACES), lambda x: x != ""), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_w"), F.size("_w")),
        }
    ).drop("_w", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def features() -> dict[str, Column]:
    """Transformed statistics: word length, symbol share, repeated lines, repeated windows, text length."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "f_len": F.log(chars / n),
        "f_sym": F.sqrt(F.col("n_symbols") / chars),
        "f_dup": F.log1p(F.col("n_dup_lines").cast("double")) / 4,
        "f_rep": F.col("n_repeat_words") / n,
        "f_words": F.log1p(n),
    }


def _moments(columns=FEATURES) -> list[Column]:
    out = [F.sum(F.lit(1.0)).alias("m_n")]
    out += [F.sum(F.col(a)).alias(f"m_{i}") for i, a in enumerate(columns)]
    out += [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"m_{i}_{j}") for i in range(D) for j in range(i + 1)]
    return out


def _sums() -> list[str]:
    return ["m_n", *(f"m_{i}" for i in range(D)), *(f"m_{i}_{j}" for i in range(D) for j in range(i + 1))]


def _factored(rows: DataFrame, centre, cov, floors: tuple[float, ...]) -> DataFrame:
    """Adds centre c_i, the Cholesky factor l_i_j of covariance + floors, and logdet, its log determinant."""
    out = rows.withColumns({f"c_{i}": centre(i) for i in range(D)})
    for i in range(D):
        for j in range(i + 1):
            v = F.greatest(cov(i, i), F.lit(0.0)) + F.lit(floors[i] ** 2) if i == j else cov(i, j)
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l_{j}_{j}"))
    return out.withColumn("logdet", 2 * sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, D)), F.log(F.col("l_0_0"))))


def _estimate(moments: DataFrame, scale: float, floors: tuple[float, ...]) -> DataFrame:
    """Mean and ``scale`` times the covariance of moments, factored."""
    cov = lambda i, j: F.lit(scale) * (F.col(f"m_{i}_{j}") / F.col("m_n") - F.col(f"m_{i}") * F.col(f"m_{j}") / (F.col("m_n") * F.col("m_n")))
    return _factored(moments, lambda i: F.col(f"m_{i}") / F.col("m_n"), cov, floors)


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(D):
        y = F.col(FEATURES[i]) - F.col(f"c_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        rows = rows.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, D)), F.col("y_0") * F.col("y_0")))


def _measured(good: DataFrame, est: DataFrame) -> DataFrame:
    """Each row of ``good`` beside the estimates of its own group and of all rows: one row a start and group."""
    est = est.select(*GROUP, *(f"c_{i}" for i in range(D)), *(f"l_{i}_{j}" for i in range(D) for j in range(i + 1)))
    own, whole = est.filter(F.col("_lang") != ALL), est.filter(F.col("_lang") == ALL)  # all rows: one estimate a start
    few = F.broadcast if own.count() <= BROADCAST_GROUPS else (lambda x: x)
    alone = good.drop("_lang", "_source").join(F.broadcast(whole), F.lit(True))
    return good.join(few(own), ["_lang", "_source"]).unionByName(alone)


def _concentrated(good: DataFrame, est: DataFrame, o: McdOptions, name: str) -> DataFrame:
    """The next estimate of each group and start, with its moments, from pre-aggregated bins of log distance."""
    scored = _distance(_measured(good, est))
    binned = staged(scored.withColumn("bin", F.floor(F.lit(o.bins_per_e) * F.log(F.col("d2") + 1e-6))).groupBy(*GROUP, "bin").agg(*_moments()), f"{name}-bins")
    w = Window.partitionBy(*GROUP)
    ranked = binned.withColumns({"upto": F.sum("m_n").over(w.orderBy("bin")), "whole": F.sum("m_n").over(w)})
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(o.h) * F.col("whole") - F.col("upto") + F.col("m_n")) / F.col("m_n")))
    near = ranked.withColumn("part", part).filter("part > 0").groupBy(*GROUP).agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in _sums()))
    return staged(_estimate(near, consistency(o.h), o.floors), name)


#: The group of all rows. Keys of real groups begin with "=" or are empty.
ALL = " all"


def _doubled(good: DataFrame) -> DataFrame:
    """Each row in its own group and in that of all rows; both are summed per task before any shuffle."""
    to = F.explode(F.array(F.struct("_lang", "_source"), F.struct(F.lit(ALL).alias("_lang"), F.lit(ALL).alias("_source"))))
    rest = [c for c in good.columns if c not in GROUP]
    return good.select(*rest, to.alias("_g")).select("_g.*", *rest)


def _robust_scales(good: DataFrame, o: McdOptions) -> DataFrame:
    """Per group (one row each): medians d_i and deviations s_i of each feature, from bins of half its floor."""
    keys = ["_lang", "_source", "f"]
    bins = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.floor(F.col(c) / (o.floors[i] / 2)).alias("b")) for i, c in enumerate(FEATURES))))
    counts = staged(_doubled(good.withColumn("_b", bins).select("_lang", "_source", "_b.*")).groupBy(*keys, "b").agg(F.count("*").alias("n")), "mcd-histogram")

    def median(rows: DataFrame, by: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        ranked = rows.withColumns({"upto": F.sum("n").over(w.orderBy(by)), "whole": F.sum("n").over(w)})
        return ranked.filter(2 * F.col("upto") >= F.col("whole")).groupBy(*keys).agg(F.min(by).alias("median"))

    middle = median(counts, "b")
    away = counts.join(middle, keys).withColumn("away", F.abs(F.col("b") - F.col("median"))).groupBy(*keys, "away").agg(F.sum("n").alias("n"))
    both = middle.join(median(away, "away").withColumnRenamed("median", "away"), keys)
    width = F.element_at(F.array(*(F.lit(x / 2) for x in o.floors)), F.col("f") + 1)
    spread = F.sqrt((1.4826 * F.col("away") * width) ** 2 + (2 * width) ** 2)
    at = lambda i, c: F.max(F.when(F.col("f") == i, c))
    return both.groupBy("_lang", "_source").agg(*(at(i, (F.col("median") + 0.5) * width).alias(f"d_{i}") for i in range(D)), *(at(i, spread).alias(f"s_{i}") for i in range(D)))


def _starts(good: DataFrame, o: McdOptions) -> DataFrame:
    """The first estimates of each group: start, c_i, l_i_j."""
    keys = ["_lang", "_source"]
    scales = staged(_robust_scales(good, o), "mcd-scales")
    own, whole = scales.filter(F.col("_lang") != ALL), scales.filter(F.col("_lang") == ALL)
    few = F.broadcast if own.count() <= BROADCAST_GROUPS else (lambda x: x)
    rows = good.join(few(own), keys).unionByName(good.drop(*keys).join(F.broadcast(whole), F.lit(True)))
    z = [(F.col(c) - F.col(f"d_{i}")) / F.col(f"s_{i}") for i, c in enumerate(FEATURES)]
    size = F.sqrt(sum((v * v for v in z), F.lit(1e-12)))
    kinds = {"sign": [v / size for v in z], "tanh": [F.tanh(v) for v in z]}
    shapes = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), *(v.alias(f"z_{i}") for i, v in enumerate(values))) for k, values in kinds.items())))
    shaped = rows.select(*keys, shapes.alias("_z")).select(*keys, "_z.*").groupBy("start", *keys).agg(*_moments(tuple(f"z_{i}" for i in range(D)))).join(scales, keys)
    corr = lambda i, j: F.col(f"s_{i}") * F.col(f"s_{j}") * F.col(f"m_{i}_{j}") / F.col("m_n")
    out = [_factored(shaped, lambda i: F.col(f"d_{i}"), corr, o.floors)]
    alone = lambda v: lambda i, j: v(i) if i == j else F.lit(0.0)
    out.append(_factored(scales.withColumn("start", F.lit("median")), lambda i: F.col(f"d_{i}"), alone(lambda i: F.col(f"s_{i}") ** 2), o.floors))
    means = _doubled(good).groupBy(*keys).agg(*_moments()).withColumn("start", F.lit("mean"))
    mean = lambda i: F.col(f"m_{i}") / F.col("m_n")
    out.append(_factored(means, mean, alone(lambda i: F.col(f"m_{i}_{i}") / F.col("m_n") - mean(i) ** 2), o.floors))
    cols = [*GROUP, *(f"c_{i}" for i in range(D)), *(f"l_{i}_{j}" for i in range(D) for j in range(i + 1)), "logdet"]
    return staged(out[0].select(*cols).unionByName(out[1].select(*cols)).unionByName(out[2].select(*cols)), "mcd-starts")


def mcd(good: DataFrame, options: McdOptions | None = None) -> DataFrame:
    """_lang, _source, moments of the nearest share, c_i, l_i_j and logdet of each group of ``good`` and of all its rows."""
    o = options or McdOptions()
    est = _concentrated(good, _starts(good, o), o, "mcd-first")
    est = _concentrated(good, est, o, "mcd-second")
    least = Window.partitionBy("_lang", "_source").orderBy("logdet", "start")
    est = staged(est.withColumn("_r", F.row_number().over(least)).filter("_r = 1").drop("_r"), "mcd-best")
    done = []
    while True:
        further = _concentrated(good, est, o, "mcd-step")
        old = est.select(*GROUP, F.col("logdet").alias("_before"))
        falls = F.col("logdet") < F.col("_before") - o.fall
        done.append(est.join(further.join(old, GROUP).filter(falls).select(*GROUP), GROUP, "left_anti"))
        est = staged(further.join(old, GROUP).filter(falls).drop("_before"), "mcd-open")
        if est.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return staged(out.drop("start"), "mcd")


def mcd_outliers(stats: DataFrame, options: McdOptions | None = None, lang: str = "lang", source: str = "source") -> DataFrame:
    """``stats`` (with the text statistics) plus d2 and kept. Rows that fail the base rule take no part in the estimates."""
    o = options or McdOptions()
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows = stats.withColumns(features()).withColumns({"_lang": named(lang), "_source": named(source)})
    found = mcd(rows.filter(~F.col("base_failed")).select("_lang", "_source", *FEATURES), o)
    shape = [*(f"c_{i}" for i in range(D)), *(f"l_{i}_{j}" for i in range(D) for j in range(i + 1))]
    whole = found.filter(F.col("_lang") == ALL)
    prior = whole.select(*(F.col(c).alias(f"a_{c}") for c in _sums()))
    own = found.filter(F.col("_lang") != ALL).select("_lang", "_source", *_sums()).join(F.broadcast(prior), F.lit(True))  # one row
    own = own.select("_lang", "_source", *((F.col(c) + F.lit(o.prior_rows) * F.col(f"a_{c}") / F.col("a_m_n")).alias(c) for c in _sums()))
    own = staged(_estimate(own, consistency(o.h), o.floors).select("_lang", "_source", *shape), "mcd-groups")
    few = F.broadcast if own.count() <= BROADCAST_GROUPS else (lambda x: x)
    general = whole.select(*(F.col(c).alias(f"all_{c}") for c in shape))
    scored = rows.join(few(own), ["_lang", "_source"], "left").join(F.broadcast(general), F.lit(True), "left")  # one row
    scored = _distance(scored.withColumns({c: F.coalesce(F.col(c), F.col(f"all_{c}")) for c in shape}))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(1 - o.tail, D))
    return scored.withColumn("kept", kept).select(*stats.columns, "d2", "kept")


def quality_rules(docs: DataFrame, options: McdOptions | None = None, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``carry`` of ``docs`` with the text statistics, base_failed, d2 (squared robust distance) and kept.

    Other columns of ``docs`` are left out, so no name can clash with the statistics.
    """
    need = list(dict.fromkeys((*carry, "text", "lang", "source")))
    held = text_statistics(docs.select(*need))
    if "text" not in carry:
        held = held.drop("text")
    return mcd_outliers(staged(held, "quality-stats"), options)

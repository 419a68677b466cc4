"""URL filters: host and path rules, then a path-template tree, in DataFrame functions alone.

The tree is built level by level over distinct (host, path) rows. Per host and branch point, from the root down:

1. Variable segments become one wildcard: of the children, those with digits if there are two or more, and with them the
   others of at most ``max_mean`` urls if there are ``min_children`` of these. It is named by the shape that all of them
   have (``{n}`` for digits), or ``{*}``.
2. Of the other children, those that are statistically similar are merged into ``{first|number}``. That takes evidence on
   both sides: ``min_urls`` urls of the child and of the others, and shares of the shapes below it that fit those below all
   (chi-square within ``z`` standard deviations; rare shapes are one). Children with labels and without are compared among
   themselves alone, and the former must fit in their share of blocked urls too. Both tests are made twice, the second time
   against the children that passed the first.

Labels are the rules' verdicts, and a rule labels only what it can speak of. One of ``k`` path segments says nothing of nodes
above depth ``k``, keeps the child that it names apart from its siblings, and where a wildcard has taken one of its ``k``
segments it is a single label, however many urls it fits. So no host goes for one blocked branch, and a wildcard goes if many
rules agree on what it stands for.

Levels go on until no branch point has two children left, at any depth. A node's purity, its share of blocked urls among its
labels, is smoothed towards its parent's as by ``prior_weight`` urls, the root's towards that of all labelled urls or one
half, whichever is less, each label counted once on the way; a template without labels so takes that of the branch above.
From ``purity`` on a template is rejected.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed by the method's default if
no such url is labelled; without any label every purity is 0; repeated rows count as often as they occur; an empty table
gives an empty result; other columns of the input are left out; empty segments count for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Separates the segments of a prefix; no path segment holds a slash.
SEP = "/"


@dataclass(frozen=True)
class TemplateOptions:
    min_children: int = 16
    max_mean: float = 3.0
    #: Urls below which a branch is no evidence of likeness.
    min_urls: int = 12
    z: float = 2.58
    #: Urls that a parent's purity counts for in its child's.
    prior_weight: float = 4.0
    purity: float = 0.9
    #: Copies of a root's or its children's purity, which all paths of the host need.
    salts: int = 16
    #: Rows of a key beyond which what they need is sent to all tasks.
    hot: int = 1_000


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """page_id, host (A-Z lower-cased) and path of every row."""
    u = F.coalesce(F.col(url), F.lit(""))
    part = lambda g: F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)([^?#]*)", g)
    return pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict); null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(segment: Column) -> Column:
    return F.regexp_replace(segment, "[0-9]+", "{n}")


def _met(rows: DataFrame, points: DataFrame, on: list[str], o: TemplateOptions) -> DataFrame:
    """``rows`` (a staged table) left joined to ``points`` (one row a key).

    Keys of more than ``o.hot`` rows, and of more than one in 1,000, are at most 1,000: their points are broadcast. All others
    are merged: points may be as many as paths, and a table that is short in Parquet can be long in the driver's memory.
    """
    n = rows.count()
    if n <= o.hot:
        return rows.join(points.hint("merge"), on, "left")
    few = staged(rows.groupBy(*on).count().filter(F.col("count") > max(o.hot, n // 1000)).select(*on), "hot-keys")
    large = F.broadcast(few)
    found = F.broadcast(points.join(large, on, "left_semi"))
    return rows.join(large, on, "left_semi").join(found, on, "left").unionByName(rows.join(large, on, "left_anti").join(points.hint("merge"), on, "left"))


def _alike(children: DataFrame, below: DataFrame, among: Column, o: TemplateOptions) -> DataFrame:
    """``children`` plus ``alike``, tested against those of their point and pool where ``among``."""
    pool = ["host", "prefix", "pool"]
    near = children.filter(among)
    sums = near.groupBy(*pool).agg(F.sum("n").alias("p_n"), F.sum("n_lab").alias("p_lab"), F.sum("n_bad").alias("p_bad"))
    part = below.join(children.select(*pool, "child", among.alias("_in")), ["host", "prefix", "child"])
    shares = part.filter("_in").groupBy(*pool, "next").agg(F.sum("n").alias("s_n"))
    rare = F.when(F.col("s_n") <= o.max_mean, F.lit(True)).otherwise(F.lit(False))
    part = part.join(shares, [*pool, "next"], "left")
    kind = F.when(rare | F.col("s_n").isNull(), F.lit("{*}")).otherwise(F.col("next"))
    shares = shares.groupBy(*pool, F.when(rare, F.lit("{*}")).otherwise(F.col("next")).alias("kind")).agg(F.sum("s_n").alias("k_n"))
    kinds = shares.groupBy(*pool).agg(F.count("*").alias("kinds"))
    part = part.groupBy(*pool, "child", kind.alias("kind")).agg(F.sum("n").alias("n"))
    # Sum of squared deviations over expectations = sum(n^2 / expected) - n; a shape unknown to the pool is as rare as one url.
    part = part.join(shares, [*pool, "kind"], "left").join(sums.select(*pool, "p_n"), pool)
    fit = part.groupBy(*pool, "child").agg(F.sum(F.col("n") * F.col("n") * F.col("p_n") / F.coalesce("k_n", F.lit(1))).alias("q"))
    out = children.join(sums, pool).join(kinds, pool).join(fit, [*pool, "child"])
    free = F.greatest(F.col("kinds") - 1, F.lit(1))
    shape = F.col("q") / F.col("n") - F.col("n") <= free + o.z * F.sqrt(2 * free)
    mine = F.when(among, F.lit(1)).otherwise(F.lit(0))
    enough = (F.col("n") >= o.min_urls) & (F.col("p_n") - mine * F.col("n") >= o.min_urls)
    lab, bad = F.col("p_lab") - mine * F.col("n_lab"), F.col("p_bad") - mine * F.col("n_bad")
    p = (F.col("p_bad") + 1) / (F.col("p_lab") + 2)
    gap = F.abs(F.col("n_bad") / F.col("n_lab") - bad / lab) <= o.z * F.sqrt(p * (1 - p) * (1 / F.col("n_lab") + 1 / lab))
    label = F.when(F.col("n_lab") == 0, lab == 0).otherwise((lab > 0) & gap)
    return out.select(*children.columns, F.coalesce(enough & shape & label, F.lit(False)).alias("alike"))


def _level(rows: DataFrame, depth: int, o: TemplateOptions) -> DataFrame:
    """``rows`` with one segment of ``rest`` moved to ``prefix``, which then has ``depth`` segments."""
    point = ["host", "prefix"]
    cut = F.split("rest", SEP, 2)
    rows = rows.withColumns({"child": cut[0], "later": F.coalesce(F.get(cut, F.lit(1)), F.lit(""))})
    wide, named = F.col("scope") < depth, F.col("scope") >= depth
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = {"n": F.sum("n"), "n_lab": count(wide), "n_bad": count(wide & F.col("bad")), "shut": count(named & F.col("bad")), "open": count(named & ~F.col("bad"))}
    below = rows.groupBy(*point, "child", shape_of(F.split("later", SEP, 2)[0]).alias("next")).agg(*(v.alias(k) for k, v in counts.items()))
    children = staged(below.groupBy(*point, "child").agg(*(F.sum(c).alias(c) for c in counts)), "children")
    digits = F.col("child").rlike("[0-9]")
    light = ~digits & (F.col("n") <= o.max_mean)
    points = children.groupBy(*point).agg(F.count(F.when(digits, 1)).alias("n_digits"), F.count(F.when(light, 1)).alias("n_light"))
    points = points.select(*point, (F.col("n_digits") > 1).alias("_digits"), (F.col("n_light") >= o.min_children).alias("_light"))
    varies = (digits & (F.col("_digits") | F.col("_light"))) | (light & F.col("_light"))
    varying = _met(children, points.filter("_digits OR _light"), point, o).filter(varies)
    shapes = varying.groupBy(*point).agg(F.min(shape_of(F.col("child"))).alias("a"), F.max(shape_of(F.col("child"))).alias("b"))
    shapes = shapes.select(*point, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("{*}").alias("branch"))
    wild = staged(_met(staged(varying.select(*point, "child"), "varying"), shapes, point, o), "wild")
    # Fenced: a rule names the child or something below it.
    pool = F.concat((F.col("shut") > 0).cast("string"), (F.col("open") > 0).cast("string"), (F.col("n_lab") > 0).cast("string"))
    fenced = (F.col("shut") > 0) | (F.col("open") > 0)
    few = children.filter(~fenced & (F.col("n") >= o.min_urls)).join(wild.select(*point, "child").hint("merge"), [*point, "child"], "left_anti").withColumn("pool", pool)
    few = staged(few, "few")
    first = staged(_alike(few, below.select(*point, "child", "next", "n"), F.lit(True), o), "similar")
    second = _alike(first.withColumnRenamed("alike", "before"), below.select(*point, "child", "next", "n"), F.col("before"), o).filter("alike AND before")
    merged = second.groupBy(*point, "pool").agg(F.count("*").alias("k"), F.min("child").alias("least")).filter("k > 1")
    branch = F.concat(F.lit("{"), "least", F.lit("|"), F.col("k").cast("string"), F.lit("}")).alias("branch")
    merged = second.select(*point, "pool", "child").join(merged.select(*point, "pool", branch), [*point, "pool"]).drop("pool")
    out = _met(rows, wild.unionByName(merged), [*point, "child"], o)
    name = F.coalesce("branch", "child")
    return out.select("host", F.concat("prefix", F.lit(SEP), name).alias("prefix"), F.col("later").alias("rest"), "path", "n", "rule", "scope", "bad")


def path_templates(leaves: DataFrame, o: TemplateOptions) -> DataFrame:
    """host, path, template, n, rule, scope, bad for distinct rows (host, path, n, rule, scope, bad).

    A branch point with one child left is no branch: its rows are done, so a very deep path costs no more levels than
    it has branches.
    """
    rest = F.concat_ws(SEP, F.filter(F.split("path", SEP), lambda s: s != ""))
    open_ = leaves.withColumns({"prefix": F.lit(""), "rest": rest})
    done, depth = [], 0
    while True:
        depth += 1
        several = open_.groupBy("host", "prefix").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).filter("a <> b").select("host", "prefix")
        split = staged(_met(open_, several.withColumn("_more", F.lit(True)), ["host", "prefix"], o), "level")
        more = F.coalesce("_more", F.lit(False)) & (F.col("rest") != "")
        end = F.concat("prefix", F.when(F.col("rest") == "", F.lit("")).otherwise(F.concat(F.lit(SEP), shape_of(F.col("rest")))))
        done.append(split.filter(~more).select("host", "path", F.when(end == "", F.lit(SEP)).otherwise(end).alias("template"), "n", "rule", "scope", "bad"))
        open_ = split.filter(more).drop("_more")
        if open_.isEmpty():
            break
        open_ = staged(_level(open_, depth, o), "templates")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def template_purity(templates: DataFrame, o: TemplateOptions) -> DataFrame:
    """host, template, n, n_lab, purity: each template's smoothed share of blocked urls, from the root of its host down."""
    label = ["rule", "scope", "bad"]
    ends = staged(templates.groupBy("host", "template", *label).agg(F.sum("n").alias("n")), "ends")
    parts = F.filter(F.split("template", SEP), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.concat_ws(SEP, F.slice(parts, F.lit(1), k)).alias("node")))
    vague = F.exists(F.slice(parts, F.lit(1), F.col("scope")), lambda s: s.startswith("{"))
    spoken = ends.filter("rule IS NOT NULL").withColumn("vague", vague).withColumn("_p", F.explode(prefixes)).select("host", *label, "vague", "n", "_p.*")
    spoken = spoken.filter("scope <= depth").groupBy("host", "depth", "node", *label, "vague").agg(F.sum("n").alias("n"))
    weight = F.when(F.col("vague"), F.lit(1)).otherwise(F.col("n"))
    count = lambda c: F.sum(F.when(c, weight).otherwise(0))
    wide = F.col("scope") < F.col("depth")
    nodes = spoken.groupBy("host", "depth", "node").agg(
        F.sum(weight).alias("lab"), count(F.col("bad")).alias("bad"), count(wide).alias("up_lab"), count(wide & F.col("bad")).alias("up_bad"))
    own = ends.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rule").isNotNull(), F.col("n")).otherwise(0)).alias("n_lab"))
    paths = own.withColumn("_p", F.explode(prefixes)).select("host", "template", "n", "n_lab", "_p.*")
    copies = F.when(F.col("depth") < 2, F.lit(o.salts)).otherwise(F.lit(1))
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    paths = paths.withColumn("salt", F.pmod(F.xxhash64("template"), copies).cast("int"))
    joined = paths.join(nodes, ["host", "depth", "node", "salt"], "left").na.fill(0, ["lab", "bad", "up_lab", "up_bad"])
    along = joined.groupBy("host", "template").agg(F.first("n").alias("n"), F.first("n_lab").alias("n_lab"), F.sort_array(F.collect_list(F.struct("depth", "lab", "bad", "up_lab", "up_bad"))).alias("along"))
    labelled = F.col("rule").isNotNull()
    prior = ends.agg(F.sum(F.when(labelled, F.col("n"))).alias("all_lab"), F.sum(F.when(labelled & F.col("bad"), F.col("n")).otherwise(0)).alias("all_bad"))
    along = along.join(F.broadcast(prior), F.lit(True))  # one row
    # Labels count once on a path: those of a child are taken from its parent.
    less = lambda x, i, c: x[c] - F.coalesce(F.get("along", i + 1)["up_" + c], F.lit(0))
    left = F.transform("along", lambda x, i: F.struct(less(x, i, "lab").alias("lab"), less(x, i, "bad").alias("bad")))
    step = lambda p, x: (x["bad"] + o.prior_weight * p) / (x["lab"] + o.prior_weight)
    purity = F.aggregate(left, F.coalesce(F.least(F.lit(0.5), F.col("all_bad") / F.col("all_lab")), F.lit(0.0)), step)
    return along.select("host", "template", "n", "n_lab", purity.alias("purity"))


def url_filter(pages: DataFrame, rules=RULES, options: TemplateOptions | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages``."""
    o = options or TemplateOptions()
    rows = url_parts(pages).withColumn("_r", rule_of(rules))
    scope = F.size(F.filter(F.slice(F.split("_r.rule", SEP), 2, 1 << 30), lambda s: s != ""))
    leaves = rows.groupBy("host", "path", "_r").agg(F.count("*").alias("n"))
    leaves = leaves.select("host", "path", "n", "_r.rule", F.when(F.col("_r.rule").isNotNull(), scope).alias("scope"), (F.col("_r.verdict") == "block").alias("bad"))
    templates = staged(path_templates(staged(leaves, "paths"), o), "all-templates")
    judged = staged(_met(templates, staged(template_purity(templates, o).select("host", "template", "purity"), "purity"), ["host", "template"], o).select("host", "path", "template", "purity"), "judged")
    out = rows.join(judged.hint("merge"), ["host", "path"], "left")
    by_method = F.when(F.col("purity") >= o.purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", by_method).alias("verdict"), "template", "purity")

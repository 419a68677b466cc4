"""PII: exact patterns, and information-theoretic sanitisation of the terms that reveal them.

An entity is the value of a pattern match. Texts are cut into sections of ``section`` words; a section is the event that
everything is counted by, over all documents: how many hold a term outside matches, an entity, and both. How strongly a term
discloses an entity is the lower confidence bound (Wilson's, at ``z`` deviations) of P(e | t) = both / df: one joint sighting is
no proof, many are, and the bound does not move with the size of the corpus. A term discloses if that reaches ``disclosed``
and is above P(e), so an entity that is everywhere is disclosed by nothing. In sections of the entity such terms are found,
and all their occurrences in the whole document are spans of kind ``term``.

Terms are generalised along a hierarchy that the corpus fills: classes of all words that begin alike, of ``levels`` letters.
The disclosure of a class is its own, counted over the sections that hold any of its words. In the sanitised text a
term becomes its narrowest class that does not disclose the entity, and is left out where each class does.

Pairs are within sections, so they grow with the text, and are counted before a shuffle.

Defined results: a null text counts as empty; words that overlap a match are no terms; terms have any length and ignore
case; an entity in every section reveals nothing; rows with equal id and text have equal results and count as often as
they occur, a null id is an id of its own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import map_texts, sliced, staged, text_of
from wickwork.llm.spans import joined, personal, replaced

KINDS = ("email", "ip", "card", "phone", "term")
_TERM = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class DisclosureOptions:
    #: Words of a section: what one entity's pairs are bounded by.
    section: int = 256
    z: float = 1.0
    disclosed: float = 0.6
    #: Letters of the classes of a term, narrowest first.
    levels: tuple[int, ...] = (4, 2)
    #: Rows (about 60 bytes each) of entities or of disclosures that are broadcast at most.
    broadcast_rows: int = 50_000
    #: Tasks that the rows of a frequent term meet in.
    salts: int = 16


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]+', '', value)}"


def sections(text: str, spans, size: int) -> list[dict]:
    """The sections of a text: entities (distinct) and occurrences of terms (term, start, end), in one sweep over words and spans."""
    out: list[dict] = [{"entities": set(), "terms": []}]
    todo = sorted((a, b, k) for k, a, b in spans)
    at = words = covered = 0
    for m in _TERM.finditer(text):
        if words == size:
            out.append({"entities": set(), "terms": []})
            words = 0
        while at < len(todo) and todo[at][0] < m.end():
            a, b, kind = todo[at]
            out[-1]["entities"].add(entity(kind, text[a:b]))
            covered, at = max(covered, b), at + 1
        words += 1
        if m.start() >= covered:
            out[-1]["terms"].append({"term": m[0].lower(), "start": m.start(), "end": m.end()})
    return [{"entities": sorted(s["entities"]), "terms": s["terms"]} for s in out]


def class_of(term: str, letters: int) -> str:
    """The key of a class of words; no term holds a star."""
    return term[:letters] + "*"


def identity() -> Column:
    """A digest, equal for rows of equal id and text alone."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit(":"), text_of()).cast("binary")))


def scan(docs: DataFrame, o: DisclosureOptions) -> DataFrame:
    """doc_id, key, the counts, base spans, and, where there are any, the sections of every row."""

    def make():
        term = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        kind = pa.list_(pa.struct([("entities", pa.list_(pa.string())), ("terms", pa.list_(term))]))

        def work(texts):
            base = [personal(t) for t in texts]
            near = [sections(t, b, o.section) if b else [] for t, b in zip(texts, base, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS[:4]]
            return [*counts, pa.array([joined(b, KINDS) for b in base], pa.string()), pa.array(near, kind)]

        return work

    fields = "n_email long, n_ip long, n_card long, n_phone long, base string, sections array<struct<entities:array<string>,terms:array<struct<term:string,start:int,end:int>>>>"
    return map_texts(docs.withColumn("key", identity()), make, fields, ("doc_id", "key"))


def term_frequencies(docs: DataFrame, o: DisclosureOptions) -> DataFrame:
    """term, df: sections that hold the term or class outside matches, counted per task before the shuffle; "" counts all sections."""

    def run(batches):
        from collections import Counter

        counts: Counter = Counter()

        def add(terms: set) -> None:
            counts.update(terms)
            for k in o.levels:
                counts.update({t[:k] + "*" for t in terms})
            counts[""] += 1

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])
            counts.clear()

        for batch in sliced(batches):
            for t in batch.column("text").to_pylist():
                t = t or ""
                base = personal(t)
                if base:
                    for s in sections(t, base, o.section):
                        add({x["term"] for x in s["terms"]})
                else:
                    words = _TERM.findall(t.lower()) if t.isascii() else [w.lower() for w in _TERM.findall(t)]
                    for at in range(0, max(len(words), 1), o.section):
                        add(set(words[at : at + o.section]))
                if len(counts) > 200_000:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _pairs(scanned: DataFrame, letters: int | None = None) -> DataFrame:
    """key, entity, term: once for each section that holds both; with ``letters`` the term is its class."""
    one = scanned.select("key", F.explode("sections").alias("s")).filter(F.size("s.entities") > 0)
    name = (lambda t: t) if letters is None else (lambda t: F.concat(F.substring(t, 1, letters), F.lit("*")))
    terms = F.array_distinct(F.transform("s.terms", lambda t: name(t["term"])))
    return one.select("key", terms.alias("terms"), F.explode("s.entities").alias("entity")).select("key", "entity", F.explode("terms").alias("term"))


def bound(both: Column, df: Column, z: float) -> Column:
    """Wilson's lower bound of a share."""
    p = both / df
    return (p + z * z / (2 * df) - z * F.sqrt(p * (1 - p) / df + z * z / (4 * df * df))) / (1 + z * z / df)


def _within(rows: DataFrame, few: DataFrame, on: list[str], small: bool, by: str, salts: int) -> DataFrame:
    """``rows`` joined to ``few`` (one row a key): broadcast where that is small, else the rows of a key meet in ``salts`` tasks, dealt by ``by``."""
    if small:
        return rows.join(F.broadcast(few), on)
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(few, [*on, "_salt"]).drop("_salt")


def disclosures(docs: DataFrame, scanned: DataFrame, o: DisclosureOptions) -> DataFrame:
    """entity, term, both, holders, df, strength, level: the terms that disclose an entity, and their first class that does not.

    Levels count from 0; ``len(o.levels)`` is removal.
    """
    counts = staged(term_frequencies(docs, o), "term-frequencies")
    total = counts.filter("term = ''").select(F.col("df").alias("n"))
    holders = scanned.select(F.explode("sections").alias("s")).select(F.explode("s.entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("holders"))
    holders = staged(holders, "holders")
    few_holders = holders.count() <= o.broadcast_rows

    def judged(both: DataFrame) -> DataFrame:
        # The bound is at most both / df: terms too frequent for their best pair go before pairs meet their counts.
        both = staged(both, "joint")
        best = both.groupBy("term").agg(F.max("both").alias("best"))
        able = staged(counts.join(best, "term").filter(F.col("best") >= F.col("df") * F.lit(o.disclosed)).drop("best"), "able")
        joint = _within(both, able, ["term"], able.count() <= o.broadcast_rows, "entity", o.salts)
        joint = _within(joint, holders, ["entity"], few_holders, "term", o.salts)
        joint = joint.join(F.broadcast(total), F.lit(True)).withColumn("strength", bound(F.col("both"), F.col("df"), o.z))  # one row
        return joint.filter((F.col("strength") >= o.disclosed) & (F.col("strength") > F.col("holders") / F.col("n")))

    both = _pairs(scanned).groupBy("entity", "term").agg(F.count("*").alias("both"))
    # Below this many joint sightings the bound is under the threshold whatever else holds.
    least = o.disclosed * o.z * o.z / (1 - o.disclosed) if o.disclosed < 1 else float("inf")
    found = staged(judged(both.filter(F.col("both") >= least)).select("entity", "term", "both", "holders", "df", "strength"), "disclosing")
    small = found.count() <= o.broadcast_rows
    out = found.withColumn("level", F.lit(0))
    for k, letters in enumerate(o.levels):
        name = F.concat(F.substring("term", 1, letters), F.lit("*"))
        asked = found.select("entity", name.alias("term")).distinct()
        both = _within(_pairs(scanned, letters), asked, ["entity", "term"], small, "key", o.salts).groupBy("entity", "term").agg(F.count("*").alias("both"))
        unsafe = judged(both).select("entity", F.col("term").alias("_class"), F.lit(True).alias("_unsafe"))
        out = out.withColumn("_class", name).join(unsafe, ["entity", "_class"], "left")
        # A class is passed on from only if all narrower ones were.
        out = out.withColumn("level", F.when((F.col("level") == k) & F.col("_unsafe"), F.lit(k + 1)).otherwise(F.col("level"))).drop("_class", "_unsafe")
    return out


def term_spans(docs: DataFrame, scanned: DataFrame, o: DisclosureOptions) -> DataFrame:
    """key, terms: the spans (start, end, level) of disclosing terms, for documents that have any; of levels the widest."""
    found = staged(disclosures(docs, scanned, o).select("entity", "term", "level"), "disclosures")
    hits = _within(_pairs(scanned), found, ["entity", "term"], found.count() <= o.broadcast_rows, "key", o.salts)
    hits = hits.groupBy("key", "term").agg(F.max("level").alias("level"))
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("term", "level")).alias("hits"))
    every = scanned.filter(F.size("sections") > 0).groupBy("key").agg(F.first(F.flatten(F.transform("sections", lambda s: s["terms"]))).alias("terms"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("level", pa.int32())]))

    def run(batches):
        for batch in sliced(batches):
            out = []
            for terms, hit in zip(batch.column("terms").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                level = {h["term"]: h["level"] for h in hit}
                out.append([{"start": t["start"], "end": t["end"], "level": level[t["term"]]} for t in terms if t["term"] in level])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, kind)], names=["key", "terms"])

    return every.join(hits, "key").select("key", "terms", "hits").mapInArrow(run, "key binary, terms array<struct<start:int,end:int,level:int>>")


def find_pii(docs: DataFrame, options: DisclosureOptions | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans of every row of ``docs``."""
    o = options or DisclosureOptions()
    scanned = staged(scan(docs, o), "scanned")
    rows = scanned.drop("sections").join(term_spans(docs, scanned, o), "key", "left")
    start = lambda s: F.split(s, ":")[1].cast("int")
    base = F.filter(F.split("base", ","), lambda s: s != "")
    more = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,level:int>>")), lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    # Base spans come in order and before a term that starts at the same place.
    both = F.transform(base, lambda s, i: F.struct(start(s).alias("at"), F.lit(0).alias("k"), i.alias("i"), s.alias("s")))
    both = F.concat(both, F.transform(more, lambda s, i: F.struct(start(s).alias("at"), F.lit(1).alias("k"), i.alias("i"), s.alias("s"))))
    spans = F.array_join(F.transform(F.array_sort(both), lambda x: x["s"]), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size(more).cast("long").alias("n_term"), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def mark(term: str, level: int, o: DisclosureOptions) -> str:
    """What a disclosing term becomes: its class, or nothing."""
    return f"[{class_of(term.lower(), o.levels[level])}]" if level < len(o.levels) else ""


def sanitise(docs: DataFrame, options: DisclosureOptions | None = None) -> DataFrame:
    """doc_id and the sanitised text of every row: matches become their kind, terms the class that is safe, or nothing."""
    o = options or DisclosureOptions()
    scanned = staged(scan(docs, o), "scanned")
    rows = docs.select("doc_id", "text", identity().alias("key")).join(term_spans(docs, scanned, o), "key", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches):
            out = []
            for t, more in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                t = t or ""
                spans = [(a, b, f"[{k}]") for k, a, b in personal(t)]
                spans += [(x["start"], x["end"], mark(t[x["start"] : x["end"]], x["level"], o)) for x in more or []]
                out.append(replaced(t, spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "text", "terms").mapInArrow(run, f"doc_id {kind}, text string")

"""Each operator against a plain version, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wickwork.llm import queries
from wickwork.llm.spans import emails, joined, luhn

SF = "/root/testdata/sf0.001"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
EXTRA = "score double, spans string, node string, label string, n_words long, bands string, template string"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def odd_documents(spark, empty=False):
    """Null and empty texts, a long one, repeated rows, null ids and columns, and names that operators use themselves."""
    long = " ".join(f"word{k % 977} the and of" for k in range(30_000))
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, long, "en", None), (4, "The cat sat on a mat by the door of that house.", "en", "b"), (4, "The cat sat on a mat by the door of that house.", "en", "b"), (None, "token = 'abcdefghijkl1234' mail me@example.org", "en", "b"), (7, " \n\t ", None, None), (8, "🙂" * 50, "fr", "b")]
    clash = (0.5, "x", "y", "z", 3, "q", "t")
    return spark.createDataFrame([] if empty else [(*r, len(r[1] or ""), *clash) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def odd_labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")


def document_operators():
    from wickwork.llm.compression_quality import score_quality
    from wickwork.llm.language_id import predict_language
    from wickwork.llm.minhash_dedup import keep_one, near_duplicates
    from wickwork.llm.packing import pack_documents
    from wickwork.llm.pii import find_pii, sanitise
    from wickwork.llm.piece_codec import encode_documents
    from wickwork.llm.quality_rules import quality_rules
    from wickwork.llm.secret_scan import find_secrets, redact_secrets

    return {
        "find_pii": find_pii, "sanitise": sanitise, "encode": lambda d: encode_documents(d, PIECES), "pack": lambda d: pack_documents(d, WORDS), "near_duplicates": near_duplicates, "keep_one": keep_one,
        "score_quality": lambda d: score_quality(d, odd_labels(d.sparkSession)), "predict_language": predict_language, "find_secrets": find_secrets, "redact": redact_secrets, "quality_rules": quality_rules,
    }


@pytest.mark.parametrize("name", ["find_pii", "sanitise", "encode", "pack", "near_duplicates", "keep_one", "score_quality", "predict_language", "find_secrets", "redact", "quality_rules"])
def test_odd_rows(spark, name):
    f = document_operators()[name]
    got = f(odd_documents(spark)).collect()
    assert f(odd_documents(spark, empty=True)).collect() == []
    if name == "pack":
        assert sum(r["start"] == 0 for r in got) == 8
    elif name == "keep_one":
        assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 3, 4, 7, 8]
    else:
        assert len(got) == 8
    if name == "near_duplicates":
        assert all(r["class_id"] == r["doc_id"] for r in got)
    if name == "predict_language":
        assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 7, 8)} == dict.fromkeys((1, 2, 7, 8), "und")


def test_op1_recall_against_brute_force(spark):
    got = defaultdict(list)
    for r in queries.op1_additive_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype("f8")
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(1)
        best = [ids[k] for k in np.lexsort((ids, -s)) if ids[k] != ids[q]][:20]
        assert len(got[ids[q]]) == 20
        assert all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-12 for v, score in got[ids[q]])
        hits, total = hits + len(set(best) & {v for v, _ in got[ids[q]]}), total + 20
    assert hits / total >= 0.9


def test_op1_odd_vectors_and_ties(spark):
    from wickwork.llm.additive_ann import nearest

    good = [1.0, 0.0, 0.0, 0.0]
    rows = [(k, good) for k in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, None, 0.0, 0.0]), (63, [float("nan")] * 4), (64, [1.0]), (20, good), (None, good)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r["vec_id"])
    assert set(by) == {0, 20, 40}
    assert by[0] == list(range(1, 21))
    assert by[20] == [k for k in range(22) if k != 20][:20]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op1_finds_all_where_vectors_are_close_together(spark):
    """Codes of few codebooks, which tell little of the score; long vectors and very small ones beside."""
    from wickwork.llm.additive_ann import AdditiveOptions, nearest

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (1, 24)) + rng.normal(0, 1e-3, (4000, 24)), rng.normal(0, 1, (2000, 24)), rng.normal(0, 1, (60, 24)) * 50, rng.normal(0, 1, (40, 24)) * 1e-6])
    x = x[rng.permutation(len(x))]
    got = defaultdict(list)
    found = nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), AdditiveOptions(codebooks=2, codewords=16, sample=500, shortlist=100), every=50)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, len(x), 50):
        s = x @ x[q]
        s[q] = -np.inf
        assert set(got[q]) == set(np.argsort(-s)[:20].tolist())


def test_op1_fits_codebooks_in_a_task(spark, monkeypatch):
    from wickwork.llm import additive_ann

    monkeypatch.setattr(additive_ann.AdditiveQuantiser, "fit", None)  # in the driver alone
    x = np.random.default_rng(4).normal(0, 1, (80, 8))
    o = additive_ann.AdditiveOptions(codebooks=2, codewords=16)
    assert additive_ann.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), o).count() == 80


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_personal(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]


def test_op2_base_spans(spark, documents):
    kinds = ("email", "ip", "card", "phone")
    for r in queries.op2_pii(spark, SF).collect():
        base = plain_personal(documents[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(base, kinds).encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in base) for k in kinds)


def test_op2_finders_on_random_text():
    from wickwork.llm.spans import personal

    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("aZ0919@..-+ _%() ") for _ in range(rng.randint(0, 40)))
        assert emails(t) == [m.span() for m in EMAIL.finditer(t)]
        assert personal(t) == plain_personal(t), t


def plain_disclosures(texts, o):
    """{(entity, term): level} by plain counts over sections, and the sections of each text."""
    from wickwork.llm.pii import entity

    df, holders, both, n, every = Counter(), Counter(), Counter(), 0, []
    for t in texts:
        spans, words = plain_personal(t), list(re.finditer(r"[^\W_]+", t))
        ends = [m.end() for m in words]
        held = []
        for s in range(0, max(1, len(words)), o.section):
            part = words[s : s + o.section]
            low = ends[s - 1] if s else 0
            high = part[-1].end() if part and s + o.section < len(words) else len(t) + 1
            entities = {entity(k, t[a:b]) for k, a, b in spans if low <= a < high}
            terms = [m for m in part if not any(a < m.end() and m.start() < b for _, a, b in spans)]
            held.append((entities, terms))
            n += 1
            plain = {m[0].lower() for m in terms}
            keys = plain | {t[:k] + "*" for t in plain for k in o.levels}
            df.update(keys)
            holders.update(entities)
            both.update({(e, x) for e in entities for x in keys})
        every.append(held)

    def disclosed(e, x):
        c, d, z = both[e, x], df[x], o.z
        p = c / d
        low = (p + z * z / (2 * d) - z * math.sqrt(p * (1 - p) / d + z * z / (4 * d * d))) / (1 + z * z / d)
        return low >= o.disclosed and low > holders[e] / n

    def level(e, t):
        return next((k for k, size in enumerate(o.levels) if not disclosed(e, t[:size] + "*")), len(o.levels))

    return {(e, t): level(e, t) for e, t in both if not t.endswith("*") and disclosed(e, t)}, every


@pytest.mark.parametrize("section", [256, 20])
def test_op2_terms_against_plain_counts(spark, section):
    from wickwork.llm.pii import DisclosureOptions, disclosures, find_pii, scan

    o = DisclosureOptions(section=section)
    rng = random.Random(section)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(400)]
    people = [f"user{k}@corp.example" for k in range(12)]
    texts = []
    for k in range(250):
        text = rng.choices(words, k=rng.randint(0, 90))
        for who in rng.sample(range(12), rng.choice([0, 0, 1, 2])):
            text[rng.randint(0, len(text)) : 0] = [people[who], *rng.sample([f"Nick{who}", f"zq{who}", f"ab{chr(99 + who)}", "team"], 2)]
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    strong, every = plain_disclosures(texts, o)
    assert len(set(strong.values())) > 1
    rows = disclosures(docs, scan(docs, o), o).collect()
    assert {(r["entity"], r["term"]): r["level"] for r in rows} == strong and len(rows) == len(strong)
    got = {r["doc_id"]: r for r in find_pii(docs, o).collect()}
    for d, held in enumerate(every):
        revealed = {m[0].lower() for entities, terms in held for m in terms for e in entities if (e, m[0].lower()) in strong}
        want = sorted(f"term:{m.start()}:{m.end()}" for _, terms in held for m in terms if m[0].lower() in revealed)
        assert sorted(s for s in got[d]["spans"].split(",") if s.startswith("term")) == want
        assert got[d]["n_term"] == len(want)


def test_op2_joins_without_broadcast(spark):
    from wickwork.llm.pii import DisclosureOptions, find_pii

    rows = [(k, f"mail user{k % 5}@corp.example by Nick{k % 5} of team") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide, narrow = (sorted(map(tuple, find_pii(docs, DisclosureOptions(broadcast_rows=n)).collect())) for n in (0, 50_000))
    assert wide == narrow and all(r[5] == 1 for r in narrow)


@pytest.mark.parametrize("times", [1, 10])
def test_op2_planted_terms_do_not_move_with_the_table(spark, times):
    """A term beside its entity alone is found, one seen once or as often without it is not, whatever else the table holds."""
    from wickwork.llm.pii import find_pii

    rows = [(k, "meet Zanzibar or boss@corp.example near the office") for k in range(6)]
    rows += [(10, "one unique sighting of ann@corp.example"), (11, "the office is near"), (12, "meet me")]
    rows += [(100 + k, f"the office of number {k} is near and we meet or do not") for k in range(60 * times)]
    got = {r["doc_id"]: r["spans"] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == "term:5:13,email:17:34" for k in range(6))
    assert "term" not in got[10] and got[11] == got[12] == got[100] == ""


def test_op2_sanitised_text(spark):
    from wickwork.llm.pii import find_pii, sanitise

    rows = [(k, "Common words here then Zanzibar and Qoph writes to boss@corp.example about things") for k in range(8)]
    rows += [(100 + k, f"Common words here and then Zanzania and things about writes to number {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_pii(docs).collect()}
    at = rows[0][1].index("Zanzibar")
    assert f"term:{at}:{at + 8}" in got[0]["spans"].split(",")
    assert got[0]["n_term"] == 2 and got[100]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs).collect()}
    # The class of words in zanz is safe; no class of Qoph is, so it goes.
    assert clean[0] == "Common words here then [zanz*] and  writes to [email] about things" and clean[100] == rows[8][1]


def test_op2_rows_neither_multiply_nor_vanish(spark):
    from wickwork.llm.pii import find_pii, sanitise

    text = "the curious zebra mails a@b.example of it"
    rows = [(None, text), (0, text), (0, text), (None, None), (1, "")] + [(9 + k, "the and of it") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = find_pii(docs).collect()
    assert len(got) == len(rows) and len({(r["n_term"], r["spans"]) for r in got if r["n_email"]}) == 1
    assert sanitise(docs).count() == len(rows)


def test_op3_equals_the_library(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in queries.op3_piece_codec(spark, SF).collect():
        ids = model.encode(documents[r["doc_id"]])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_op3_random_text():
    import sentencepiece

    from wickwork.llm.piece_codec import PieceCodec

    model, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceCodec(PIECES), random.Random(4)
    for _ in range(20_000):
        t = "".join(rng.choice(" \n\t▁aeinthr,.ß日本🙂é0123  ") for _ in range(rng.randint(0, 30)))
        ids = model.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == model.decode(ids)


def test_op4_every_id_is_in_one_piece(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    by, filled = defaultdict(list), defaultdict(list)
    for r in queries.op4_packing(spark, SF).collect():
        by[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in documents.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(n for p in filled.values() for _, n in p) / (2048 * len(filled)) > 0.9


def test_op4_words_equal_the_library():
    from wickwork.llm.packing import WordTokenizer

    t, rng = WordTokenizer(WORDS), random.Random(5)
    for _ in range(20_000):
        s = "".join(rng.choice(" \n\t\x85 'sSΣσİéẽ́aE日1²½,.<|endoftext|>\x1c(#)!?") for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "a", "'s"])
        assert t.coded([s])[0] == np.array(t.inner.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), s


def test_op4_level_array_is_the_sum_of_squares_rule():
    from wickwork.llm.packing import LevelPacker

    rng, p, bins = random.Random(6), LevelPacker(16), []
    for _ in range(3000):
        size = rng.randint(1, 16)
        counts = Counter(b for b in bins if b < 16)

        def after(level, size=size, counts=counts):
            c = Counter(counts)
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return sum(v * v for v in c.values())

        options = [0] + [h for h in counts if h + size <= 16]
        number, level = p.place(size)
        assert after(level) == min(map(after, options))
        if number == len(bins):
            bins.append(0)
        assert bins[number] == level
        bins[number] += size


def test_op5_against_brute_force(spark):
    """Every pair of weighted similarity 0.8 or more is linked, and every member has such a partner."""
    from wickwork.llm.minhash_dedup import DedupOptions, Likeness, Shingler, near_duplicates, shingle_weights

    rng = random.Random(7)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(30)]
    rows = []
    for b, text in enumerate(base):
        for k in range(12):
            words = text.split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            rows.append((100 * b + k, " ".join(words) + (" shared passage of seven words stands here" if b % 2 else "")))
    rows += [(5000 + k, rows[0][1]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    o = DedupOptions()
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs, o).collect()}
    like, sh = Likeness(shingle_weights(docs, o)), Shingler(5)
    parsed = {d: like.parsed(np.sort(sh.shingles(t).astype("u4")).tobytes()) for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if like.similarity(parsed[a], parsed[b], 0.8) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {d: find(d) for d in ids}


def crafted(groups, shared):
    """Rows (node, bands, shingles) for the search of links: nodes of a group are near copies, nodes of different groups are not alike.

    ``shared`` names the band that all nodes of a bucket share: (band, groups) each; other bands are unique.
    """
    rng, rows, keys = np.random.default_rng(7), [], iter(range(10**6, 10**9))
    place = {g: (band, -1 - k) for k, (band, members) in enumerate(shared) for g in members}
    for g, size in groups.items():
        base = rng.choice(1 << 32, 200, replace=False).astype("u4")
        for k in range(size):
            own = base.copy()
            own[k] = rng.integers(1 << 32)
            bands = [next(keys) for _ in range(20)]
            bands[place[g][0]] = place[g][1]
            rows.append((hashlib.md5(f"{g} {k}".encode()).digest(), bands, np.sort(own).tobytes()))
    return rows


def even_weights():
    from wickwork.llm.minhash_dedup import ShingleWeights

    return ShingleWeights(np.zeros((3, 1 << 17), "f4"), 1000)


def linked_groups(spark, rows, options):
    from wickwork.llm.minhash_dedup import similarity_links

    frame = spark.createDataFrame(rows, "node binary, bands array<long>, shingles binary")
    return dict(similarity_links(frame, even_weights(), options).collect())


def test_op5_links_of_the_last_turn_stay(spark):
    """A small group settled while a large bucket, whose members share one band only, is still open."""
    from wickwork.llm.minhash_dedup import DedupOptions

    groups = {"lone 1": 1, "lone 2": 1, "twins": 2} | {f"other {k}": 1 for k in range(30)}
    rows = crafted(groups, [(3, ["lone 1", "lone 2", "twins"]), (5, [g for g in groups if g.startswith("other")])])
    # The star of the small bucket compares the twins with a lone node: they are settled afterwards.
    for turn in range(6):
        moved = [(hashlib.md5(n + bytes([turn])).digest(), b, s) for n, b, s in rows]
        labels = linked_groups(spark, moved, DedupOptions(group=4))
        assert labels.get(moved[2][0], 1) == labels.get(moved[3][0], 2)


def test_op5_pairs_of_a_large_bucket_against_brute_force(spark):
    """Near copies that share one band, in a bucket far larger than a task settles, or one of two large buckets, are linked."""
    from wickwork.llm.minhash_dedup import DedupOptions, Likeness

    groups = {f"pair {k}": 1 + k % 3 for k in range(45)}
    rows = crafted(groups, [(5, list(groups))])
    for k, (_, bands, _) in enumerate(rows):  # a part shares a later band, in which its copies may be apart
        bands[11] = -99 if k % 4 else bands[11]
    o = DedupOptions(group=4)
    labels = linked_groups(spark, rows, o)
    like = Likeness(even_weights())
    parsed = [like.parsed(r[2]) for r in rows]
    every = like.every_similarity(parsed)
    for i in range(len(rows)):
        for j in range(i):
            s = like.similarity(parsed[i], parsed[j])
            assert abs(every[i, j] - s) < 1e-5
            assert (labels.get(rows[i][0], i) == labels.get(rows[j][0], j)) == (s >= 0.8)


def test_op5_similarities_of_all_pairs():
    """Repeats, rows that share a feature in numbers below and above the step from pairs to matrices, and rows without company."""
    from wickwork.llm.minhash_dedup import Likeness, ShingleWeights

    rng = np.random.default_rng(4)
    like = Likeness(ShingleWeights(rng.integers(0, 900, (3, 1 << 17)).astype("f4"), 1000))
    rows = [like.parsed(np.sort(np.concatenate((rng.integers(0, 60, 80), rng.integers(0, 4000, 300)))).astype("u4").tobytes()) for _ in range(70)]
    rows.append(like.parsed(np.arange(10**6, 10**6 + 9, dtype="u4").tobytes()))
    every = like.every_similarity(rows)
    assert max(abs(every[i, j] - like.similarity(rows[i], rows[j])) for i in range(71) for j in range(i)) < 1e-5


def test_op5_shingles_are_words_of_five():
    from wickwork.llm.minhash_dedup import Shingler

    s, rng = Shingler(5), random.Random(8)
    a = s.shingles("One two, three FOUR five six")
    assert len(a) == 2 and (s.shingles("one two three four five") == a[:1]).all() and (s.shingles("x two three four five six")[1:] == a[1:]).all()
    assert len(s.shingles("")) == 0 and len(s.shingles("a b")) == 1
    small = Shingler(5)
    small.BLOCK = 64
    words = " ".join("w" * rng.randint(1, 9) + str(k) for k in range(300))
    assert (small.shingles(words) == s.shingles(words)).all()


def test_op6_hosts_rules_and_templates(spark):
    from wickwork.llm.url_filter import url_filter

    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_url_filter(spark, SF).collect():
        rest = urls[r["page_id"]].partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [x for x in rules if (host.lower() == x.partition("/")[0] or host.lower().endswith("." + x.partition("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, rule)
        assert rule is None or r["verdict"] == rules[rule]
    rows = [(k, f"http://spam.example/buy/item{k}/{'good' if k == 3 else 'x'}") for k in range(40)] + [(100, None), (101, "no scheme"), (102, "http://H?x"), (103, "http://spam.example/buy/new/x"), (104, "http://fine.example/a")]
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), (("spam.example/buy/item", "block"), ("spam.example/buy/item3/good", "allow"))).collect()}
    assert (got[100]["host"], got[101]["host"], got[102]["host"], got[102]["path"]) == ("", "", "h", "")
    assert got[100]["verdict"] == got[104]["verdict"] == "allow" and got[5]["verdict"] == "block" and got[3]["verdict"] == "allow"
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def shaped(segment):
    return re.sub("[0-9]+", "{n}", segment)


def plain_alike(kids, below, pool, o):
    """The members of ``pool`` that are alike by two turns of the tests."""
    among = set(pool)
    for _ in range(2):
        p_n, p_lab, p_bad = (sum(kids[k][c] for k in among) for c in ("n", "lab", "bad"))
        shares = sum((below[k] for k in among), Counter())
        kind = lambda s, shares=shares: "{*}" if shares.get(s, 0) <= o.max_mean else s
        lumped = Counter()
        for s, v in shares.items():
            lumped[kind(s)] += v
        free, alike = max(len(lumped) - 1, 1), set()
        for k in pool if among else ():
            n, n_lab, n_bad = (kids[k][c] for c in ("n", "lab", "bad"))
            mine = Counter()
            for s, v in below[k].items():
                mine[kind(s)] += v
            q = sum(v * v * p_n / lumped.get(s, 1) for s, v in mine.items()) / n - n
            inside = k in among
            lab, bad, others = p_lab - inside * n_lab, p_bad - inside * n_bad, p_n - inside * n
            if n_lab and lab:
                p = (p_bad + 1) / (p_lab + 2)
                label = abs(n_bad / n_lab - bad / lab) <= o.z * math.sqrt(p * (1 - p) * (1 / n_lab + 1 / lab))
            else:
                label = not n_lab and not lab
            if n >= o.min_urls and others >= o.min_urls and label and q <= free + o.z * math.sqrt(2 * free):
                alike.add(k)
        among &= alike
    return among


def plain_tree(leaves, o):
    """{(host, path): template} and {(host, template): purity} by recursion over a plain tree of {(host, path): (n, rule, bad)}."""
    templates = {}
    scope = lambda rule: len([x for x in rule.split("/")[1:] if x])

    def branch(host, prefix, rows):
        """rows: (rest, path, n, rule, bad), rest a tuple of segments."""
        if len({r[0] for r in rows}) < 2:
            for rest, path, *_ in rows:
                templates[host, path] = "/" + "/".join((*prefix, *map(shaped, rest)))
            return
        for rest, path, *_ in rows:
            if not rest:
                templates[host, path] = "/" + "/".join(prefix)
        rows = [r for r in rows if r[0]]
        kids, below = defaultdict(Counter), defaultdict(Counter)
        for rest, _, n, rule, bad in rows:
            wide = rule is not None and scope(rule) <= len(prefix)
            kids[rest[0]].update({"n": n, "lab": n * wide, "bad": n * (wide and bad), "named": n * (rule is not None and not wide)})
            below[rest[0]][shaped(rest[1]) if len(rest) > 1 else ""] += n
        digits = {k for k in kids if re.search("[0-9]", k)}
        light = {k for k in kids if k not in digits and kids[k]["n"] <= o.max_mean}
        wild = (light | digits if len(light) >= o.min_children else digits if len(digits) > 1 else set())
        shapes = {shaped(k) for k in wild}
        name = {k: k for k in kids} | dict.fromkeys(wild, shapes.pop() if len(shapes) == 1 else "{*}")
        rest = [k for k in kids if k not in wild and not kids[k]["named"] and kids[k]["n"] >= o.min_urls]
        for labelled in (False, True):
            among = plain_alike(kids, below, [k for k in rest if (kids[k]["lab"] > 0) == labelled], o)
            if len(among) > 1:
                name |= dict.fromkeys(among, f"{{{min(among)}|{len(among)}}}")
        parts = defaultdict(list)
        for segments, *more in rows:
            parts[name[segments[0]]].append((segments[1:], *more))
        for k, part in parts.items():
            branch(host, (*prefix, k), part)

    hosts = defaultdict(list)
    for (host, path), leaf in leaves.items():
        hosts[host].append((tuple(x for x in path.split("/") if x), path, *leaf))
    for host, rows in hosts.items():
        branch(host, (), rows)
    spoken, ends = defaultdict(Counter), set()
    for (host, path), (n, rule, bad) in leaves.items():
        parts = tuple(x for x in templates[host, path].split("/") if x)
        ends.add((host, templates[host, path]))
        for depth in range(len(parts) + 1):
            if rule is not None and scope(rule) <= depth:
                key = (rule, bad, any(x.startswith("{") for x in parts[: scope(rule)]))
                spoken[host, parts[:depth]][key] += n

    def labels(node, depth):
        """(labels, blocked) of a node by rules of at most ``depth`` segments."""
        own = [(1 if vague else n, bad) for (rule, bad, vague), n in spoken[node].items() if scope(rule) <= depth]
        return sum(n for n, _ in own), sum(n for n, bad in own if bad)

    lab = sum(n for n, rule, _ in leaves.values() if rule is not None)
    start = min(0.5, sum(n for n, rule, bad in leaves.values() if rule is not None and bad) / lab) if lab else 0.0
    purity = {}
    for host, t in ends:
        parts, p = tuple(x for x in t.split("/") if x), start
        for depth in range(len(parts) + 1):
            n, bad = labels((host, parts[:depth]), depth)
            less, less_bad = labels((host, parts[: depth + 1]), depth) if depth < len(parts) else (0, 0)
            p = (bad - less_bad + o.prior_weight * p) / (n - less + o.prior_weight)
        purity[host, t] = p
    return templates, purity


def random_pages(seed):
    """Hosts with branches of equal and of different shapes, deep paths, and segments that vary."""
    rng, urls = random.Random(seed), []
    for _ in range(1500):
        host, kind = f"h{rng.randint(0, 3)}.example", rng.random()
        if kind < 0.3:
            path = f"/{rng.choice(['de', 'en', 'fr'])}/{rng.choice(['{}', '{}.html', 'list/{}']).format(rng.randint(0, 999))}"
        elif kind < 0.5:
            path = f"/user/{''.join(rng.choices('abcdef', k=4))}/{rng.choice(['photos', 'posts'])}"
        elif kind < 0.6:
            path = "/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 7)))
        else:
            path = f"/shop/{rng.choice(['tea', 'ink', 'oil'])}/{rng.choice(['a', 'b', 'c', ''])}"
        urls.append(f"http://{host}{path}")
    return urls


@pytest.mark.parametrize("source", ["table", 1])
def test_op6_tree_equals_a_plain_one(spark, source):
    from wickwork.llm.url_filter import RULES, TemplateOptions, url_filter

    o = TemplateOptions()
    rules = RULES if source == "table" else (("h0.example/de/", "block"), ("h1.example/", "block"), ("h1.example/en/", "allow"), ("h3.example/shop/tea/", "block"), ("h3.example/shop/ink/", "allow"), *((f"h2.example/user/{a}{b}", "block") for a in "abc" for b in "abcdef"))
    pages = spark.read.parquet(f"{SF}/pages.parquet") if source == "table" else spark.createDataFrame(list(enumerate(random_pages(source))), "page_id long, url string")
    got = url_filter(pages, rules, o).collect()
    assert len(got) == pages.count()
    leaves = {}
    for r in got:
        n = leaves.get((r["host"], r["path"]), (0,))[0]
        leaves[r["host"], r["path"]] = (n + 1, r["rule"], dict(rules).get(r["rule"]) == "block")
    templates, purity = plain_tree(leaves, o)
    for r in got:
        assert r["template"] == templates[r["host"], r["path"]]
        p = purity[r["host"], r["template"]]
        assert abs(r["purity"] - p) < 1e-9
        assert r["verdict"] == (dict(rules).get(r["rule"]) or ("block" if p >= o.purity else "allow"))
    if source != "table":
        assert any("{*}" in r["template"] for r in got) and any("|" in r["template"] for r in got) and len({r["verdict"] for r in got if r["rule"] is None}) == 2


def test_op6_templates_of_the_given_hosts(spark):
    """Wildcards arise, hosts keep several templates, and no url goes for a label of a branch that it is not in."""
    from wickwork.llm.url_filter import url_filter

    got = url_filter(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()
    by_host = defaultdict(set)
    for r in got:
        by_host[r["host"]].add(r["template"])
        assert r["rule"] is not None or r["verdict"] == "allow"
    assert sum("{*}" in r["template"] for r in got) > len(got) / 2 and any("|" in r["template"] for r in got)
    branches = defaultdict(Counter)
    for r in got:
        branches[r["host"]][r["path"].split("/")[1]] += 1
    several = [h for h, b in branches.items() if h.endswith(".com") and b["de"] and len(b) > 1]
    assert several and all(len(by_host[h]) > 1 for h in several)
    for r in got:
        if r["host"].endswith("example.com") and not r["path"].startswith("/de/"):
            assert not r["template"].startswith("/de") and r["purity"] <= 0.5


def broadcast_rows(spark):
    """The rows of all broadcasts of the session so far."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, out = store.executionsList(), []
    for i in range(runs.size()):
        values, nodes = store.executionMetrics(runs.apply(i).executionId()), store.planGraph(runs.apply(i).executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = [node.metrics().apply(k) for k in range(node.metrics().size())] if node.name() == "BroadcastExchange" else []
            found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
            out += [int(x.get().replace(",", "")) for x in found if x.isDefined()]
    return out


def test_op6_broadcasts_no_table_that_grows_with_the_paths(spark):
    """One host with many variable segments: what its paths need is merged, and only hot keys are sent to all tasks."""
    from wickwork.llm.url_filter import TemplateOptions, url_filter

    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://a.example.com/', if(id % 3 = 0, 'de', 'en'), '/', id, '/', id % 7) AS url")
    seen = len(broadcast_rows(spark))
    got = {o.hot: url_filter(pages, options=o).select("page_id", "template", "verdict", "purity").orderBy("page_id").collect() for o in (TemplateOptions(hot=500), TemplateOptions(hot=10_000))}
    sent = broadcast_rows(spark)[seen:]
    assert sent and max(sent) <= 1000
    assert got[500] == got[10_000] and len(got[500]) == 3000 and {r["verdict"] for r in got[500]} == {"block", "allow"}


def test_op6_one_rule_is_one_label_of_a_wildcard(spark):
    """A rule of a part of a wildcard's segments does not reject the rest, many rules do."""
    from wickwork.llm.url_filter import url_filter

    rows = [(k, f"http://a.example/p/{x}{y}/1") for k, (x, y) in enumerate((x, y) for x in "abcdefgh" for y in "ijklmnop")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    one = url_filter(pages, tuple((f"a.example/p/{x}", "block") for x in "abcdefg")).collect()
    assert {r["template"] for r in one} == {"/p/{*}/{n}"}
    few = url_filter(pages, (("a.example/p/a", "block"),)).collect()
    assert {r["verdict"] for r in few if r["rule"] is None} == {"allow"} and {r["verdict"] for r in few if r["rule"]} == {"block"}
    many = url_filter(pages, tuple((f"a.example/p/{x}{y}/", "block") for x in "abcdef" for y in "ijklmnop")).collect()
    assert {r["verdict"] for r in many} == {"block"}


def test_op6_odd_rows(spark):
    from wickwork.llm.url_filter import url_filter

    rows = [(1, None, "x", 0.1), (1, None, "x", 0.1), (2, "", None, None), (3, "http://a.net/b", "y", 0.2), (3, "http://a.net/b", "y", 0.2), (None, "http://" + "/x" * 3000, "z", 0.3), (5, "http://c.de" + "/d" * 2000 + "/e", "z", 0.3)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, template string, purity double")).collect()
    assert len(got) == len(rows) and [r["verdict"] for r in got if r["page_id"] == 3] == ["block"] * 2
    assert all(r["verdict"] == "allow" for r in got if r["page_id"] != 3)


def test_op6_rejects_by_template_purity(spark):
    from wickwork.llm.url_filter import url_filter

    rows = [(k, f"http://a.example/p/{chr(97 + k % 26)}{chr(97 + k // 26)}/1") for k in range(60)]
    rules = tuple((f"a.example/p/{chr(97 + k % 26)}{chr(97 + k // 26)}/", "block") for k in range(50))
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {r["template"] for r in got} == {"/p/{*}/{n}"}
    assert all(r["verdict"] == "block" for r in got)


def test_op7_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op7_compression_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.9


def test_op8_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_op8_fast_form_equals_the_plain_one():
    from wickwork.llm.language_id import ByteCnn, ByteCnnOptions

    net = ByteCnn(["a", "b", "c"], ByteCnnOptions())
    x = np.concatenate([net.windows(t) for t in ("", "short", "Straße " * 90)])
    h, _ = net.responses(x)
    e = np.exp(h @ net.out + net.base)
    assert np.allclose(net.pooled()(x), e / e.sum(1, keepdims=True), atol=1e-5)


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]


def test_op9_base_spans(spark, documents):
    kinds = ("assign", "access", "hex")
    for r in queries.op9_secret_scan(spark, SF).collect():
        base = plain_secrets(documents[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(base, kinds).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in kinds)


def test_op9_incremental_entropy():
    from wickwork.llm.secret_scan import EntropyOptions, EntropyScanner

    s, rng, o = EntropyScanner(EntropyOptions()), random.Random(9), EntropyOptions()
    for _ in range(300):
        t = "".join(rng.choice(rng.choice(["abcdef0123456789", "abcXYZ019", "ab1"])) for _ in range(rng.randint(20, 60)))
        marked = set()
        for k in range(len(t) - o.window + 1):
            w = t[k : k + o.window]
            h = -sum(c / o.window * math.log2(c / o.window) for c in Counter(w).values())
            if h >= o.thresholds[s.kind(t)] - 1e-9 and sum(map(str.isdigit, w)) >= o.min_digits and sum(map(str.isalpha, w)) >= o.min_letters:
                marked |= set(range(k, k + o.window))
        assert {k for a, b in s.windows(t) for k in range(a, b)} == marked
    assert s.spans("see 123e4567-e89b-12d3-a456-426614174000 and internationalisation") == []
    assert s.spans("key Zk3v9QpL7xTn2WbR8sYc now") == [("entropy", 4, 24)]


def test_op9_base64_with_slashes():
    from wickwork.llm.secret_scan import EntropyOptions, EntropyScanner

    s, rng = EntropyScanner(EntropyOptions()), random.Random(10)
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    assert s.spans(f"aws_secret_access_key = {key}")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for size, least in ((24, 0.9), (40, 0.99)):
        drawn = [t for t in ("".join(rng.choices(letters, k=size)) for _ in range(6000)) if "/" in t]
        assert sum(bool(s.spans(f"key {t} now")) for t in drawn) >= least * len(drawn)
    for path in ("src/main/java/com/exampleSite/UserService2", "example.com/de/articles/2024/page-17", "2024/01/31/backup-files/archive12"):
        assert s.spans(f"see {path} end") == []


def plain_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at, seen, dup = defaultdict(list), set(), 0
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})


def test_op10_statistics(spark, documents):
    for r in queries.op10_quality_rules(spark, SF).collect():
        want = plain_statistics(documents[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and (not r["kept"] or not failed)


def test_op10_outliers_planted_far_away(spark):
    from wickwork.llm.quality_rules import quality_rules

    rng = random.Random(10)
    rows = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 200))), "en", "s") for k in range(150)]
    rows += [(1000 + k, " ".join("#$%&" + str(rng.randint(0, 10**6)) for _ in range(100)), "en", "s") for k in range(5)]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + k]["kept"] for k in range(5))
    assert all(got[k]["kept"] for k in range(150))


def test_op10_estimate_against_numpy(spark):
    """Centre, covariance and distances of exact concentration steps from many random starts; a fifth of the rows are outliers."""
    from wickwork.llm.quality_rules import FEATURES, McdOptions, _distance, consistency, mcd

    rng, o = np.random.default_rng(3), McdOptions()
    mix = rng.normal(0, 0.4, (5, 5)) + np.eye(5)
    x = np.vstack((rng.normal(0, 1, (800, 5)) @ mix, rng.normal(9, 0.5, (200, 5))))
    h, floors = int(o.h * len(x)), np.diag(np.array(o.floors) ** 2)
    best = None
    for start in range(60):
        near = rng.choice(len(x), 6 if start else len(x), replace=False)
        for _ in range(40):
            centre, cov = x[near].mean(0), consistency(o.h) * np.cov(x[near].T, bias=True) + floors
            d2 = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(cov), x - centre)
            near = np.argsort(d2)[:h]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = (det, d2)
    frame = spark.createDataFrame([("=en", "=s", *map(float, r)) for r in x], ", ".join(["_lang string", "_source string", *(f"{f} double" for f in FEATURES)]))
    found = mcd(frame, o)
    assert {r["_lang"] for r in found.collect()} == {"=en", " all"}
    logdet = found.filter("_lang = '=en'").first()["logdet"]
    assert abs(logdet - best[0]) < 0.02
    got = _distance(frame.join(found, ["_lang", "_source"])).select(*FEATURES, "d2").toPandas()
    d2 = {tuple(np.round(r, 9)): v for r, v in zip(x, best[1], strict=True)}
    want = np.array([d2[tuple(np.round(r, 9))] for r in got[list(FEATURES)].to_numpy()])
    assert np.abs(got["d2"].to_numpy() / want - 1).max() < 0.1
    assert (np.sort(got["d2"].to_numpy())[800:] > 100).all()


def test_op10_windows_of_one_code_are_told_apart(spark):
    """With codes of a few values nearly all windows share one, so the windows themselves are compared."""
    from wickwork.llm import quality_rules as q

    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    real = q.F.xxhash64
    q.F.xxhash64 = lambda *c: F.pmod(real(*c), F.lit(3))
    try:
        got = q.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_repeat_words").collect()
    finally:
        q.F.xxhash64 = real
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {k: plain_statistics(t)[4] for k, t in enumerate(texts)}


def test_op5_sketch_against_plain_counts(spark, documents):
    from wickwork.llm.minhash_dedup import DedupOptions, Shingler, shingle_weights

    o, sh = DedupOptions(), Shingler(5)
    weights = shingle_weights(spark.read.parquet(f"{SF}/documents.parquet"), o)
    df = Counter(s for t in documents.values() for s in np.unique(sh.shingles(t) & np.uint64(0xFFFFFFFF)).tolist())
    x, n = np.array(list(df), "u8"), len(documents)
    want = 1 + np.log((1 + n) / (1 + np.array([df[s] for s in x.tolist()]))) / np.log(1 + n)
    off = np.abs(weights.of(x) - want)
    assert weights.n == n and np.median(off) < 0.05 and np.percentile(off, 99) < 0.2

"""Set joins, token alignment and vector codes against plain versions, and on odd rows and empty tables."""

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from tests.llm.test_operators import odd_documents
from wickwork.llm.parity_join import Bands, Frequencies, JoinOptions, ShingleSets, active_sets, block_keys, frequencies, met, parity, possible, set_components, settled, sketched
from wickwork.llm.token_alignment import MARK, Aligner, AlignmentOptions, align_tokenizers, byte_level
from wickwork.llm.vector_codes import Codebook, CodeOptions, codebooks_digest, lloyd_round, train_codes, vector_codes

SF = "/root/testdata/sf0.001"
LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def plain_components(rows, numerator=85, denominator=100):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and denominator * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return Counter((name, len(sets[i]), least.get(find(i))) for i, (name, _) in enumerate(rows))


def near_copies(seed, groups=12, size=14):
    """Texts of several lengths with copies at all distances from their first, around the threshold, and shared passages."""
    rng, out = random.Random(seed), []
    word = lambda: "w%d" % rng.randrange(3000)
    passage = [word() for _ in range(60)]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 4, 7, 9, 12, 30, 90, 300]))] + (passage if g % 3 == 0 else [])
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 2 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    rng.shuffle(out)
    return [(1000 + 7 * k if k % 31 else None, t) for k, t in enumerate(out)] + [(5, None), (6, ""), (7, " \n"), (8, out[0])]


def test_op11_moves_a_long_and_an_int_a_block(spark):
    """Blocks and digests survive the narrow row, their ends included, and are dealt once."""
    docs = spark.createDataFrame([([0, 1, (1 << 44) - 1, (1 << 43) + 5], (1 << 52) - 1), ([7], 0), ([1], (1 << 51) + 12345), ([1 << 20], 1 << 51), ([9], (1 << 20) - 1)], "keys array<long>, t long")
    assert sorted(map(tuple, met(docs).collect())) == sorted((k, r["t"]) for r in docs.collect() for k in r["keys"])
    plan = met(docs).groupBy("bucket").agg(F.min("t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min" in plan
    moved = plan[plan.index("Exchange hashpartitioning") :].split("Project [", 1)[1].split("\n", 1)[0]
    assert "AS both" in moved and "AS high" in moved and "centre" not in moved
    x = np.arange(1, 400, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    bands = Bands(JoinOptions())
    for j in (bands.of(len(x)), bands.of(len(x)) - 1):
        keys = block_keys(np.sort(x), np.ones(len(x), bool), j, bands)
        assert int(keys.max()) < 1 << 44 and set((keys & np.uint64(1)).tolist()) == {j & 1}


def test_op11_blocks_of_two_bands_with_one_key_stay_apart(spark):
    """Keys of 44 bits meet by chance: texts of bands 2 apart in one bucket have sketches of different lengths."""
    o, bands, words = JoinOptions(), Bands(JoinOptions()), [f"w{k}" for k in range(400)]
    bands.of(400)
    j = bands.of(60)
    sizes = (60, 60, bands.starts[j + 2] + 1, bands.starts[j + 4] + 1)
    texts = [" ".join(words[k % 2 : n + 3 + k % 2]) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sketched(docs, frequencies(docs, o), o).filter("node is not null")
    sets = active_sets(docs, rows, rows, o)
    assert {(r["n"], r["band"] - j) for r in sets.collect()} == {(60, 0), (sizes[2], 2), (sizes[3], 4)}
    groups = sets.select(F.lit(5).cast("long").alias("bucket"), F.lit(j % 2).alias("at"), "node", F.col("node").alias("label"))
    pair = {bytes(r["node"]) for r in sets.filter("n = 60").collect()}
    assert {bytes(r["node"]) for r in possible(groups, sets, o).collect()} == pair
    assert [{bytes(r["a"]), bytes(r["b"])} for r in settled(groups, sets, o).collect()] == [pair]


@pytest.mark.parametrize("options", [JoinOptions(), JoinOptions(rare=3, turns=1, group=8, broadcast_rows=5), JoinOptions(rare=0, rare_share=0.0, turns=0, group=4)])
def test_components_equal_a_plain_join(spark, options):
    rows = near_copies(3)
    got = set_components(spark.createDataFrame(rows, "doc_id long, text string"), options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == plain_components(rows)


def test_linked_sets_share_a_block_and_sketches_bound_the_difference():
    o, bands, sets, rng = JoinOptions(), Bands(JoinOptions()), ShingleSets(4), random.Random(5)
    for n in (1, 2, 5, 6, 8, 13, 40, 200, 1500):
        for _ in range(20):
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], "u8"))
            gone = rng.randrange(0, 1 + int(n * 0.08))
            b = np.unique(np.concatenate((a[gone:], np.array([rng.getrandbits(64) for _ in range(rng.randrange(0, 1 + int(n * 0.08)))], "u8"))))
            both = len(np.intersect1d(a, b))
            if o.denominator * both < o.numerator * (len(a) + len(b) - both):
                continue
            x, y = sorted((a, b), key=len)
            j = bands.of(len(x))
            assert bands.of(len(y)) == j or bands.of(len(y)) == j + 1 and bands.meets_below(len(y), j + 1)
            for frequent in (0.0, 0.5, 0.9, 1.0):  # of any choice of rare shingles that is made shingle by shingle
                rare = lambda h, f=frequent: (h >> np.uint64(3)) % np.uint64(1000) >= 1000 * f
                assert set(block_keys(x, rare(x), j, bands)) & set(block_keys(y, rare(y), j, bands))
            bits = bands.bits(j)
            assert np.bitwise_count(parity(x, bits) ^ parity(y, bits)).sum() <= len(np.setxor1d(x, y))
    assert len(sets.of("one two")) == 1 and len(sets.of("a b c d e")) == 2 and len(sets.of("\x1c")) == 1


def test_frequencies_never_fall_short():
    o = JoinOptions(sketch_bits=8, rare=2, rare_share=0.0)
    x = np.arange(1, 400, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    table = np.stack([np.bincount(Frequencies.cell(np.repeat(x, 3), r, 64 - 8), minlength=256) for r in range(2)])
    seldom = Frequencies(table, 400, o)
    assert seldom.most == 2 + 3 * 399 // 256
    assert not seldom.rare(x[:1]).all() or table[0].max() > 3


@pytest.mark.parametrize("empty", [False, True])
def test_components_of_odd_rows(spark, empty):
    docs = odd_documents(spark, empty)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(tuple(r) for r in set_components(docs).collect()) == plain_components(rows)


def plain_alignment(texts):
    """The counted columns of every text, from the two libraries and byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(LEFT)
    left.encode_special_tokens = True
    right, table = sentencepiece.SentencePieceProcessor(model_file=RIGHT), byte_level()
    made = []
    for t in texts:
        a, b = (left.encode(" " + t, add_special_tokens=False).ids, right.encode(t)) if t else ([], [])
        xs = [bytes(table[c] for c in left.id_to_token(i)) for i in a]
        ys = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace(MARK, " ").encode() for i in b]
        if not t or not b"".join(xs) == b"".join(ys) == (" " + t).encode():
            made.append(([], [], [], []))
            continue
        ends = [list(np.cumsum([len(x) for x in z])) for z in (xs, ys)]
        cut = sorted(set(ends[0]) & set(ends[1]))
        places = [[0, *(bisect_right(e, c) for c in cut)] for e in ends]
        groups = ";".join(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:e]))}" for i, k, j, e in zip(places[0], places[0][1:], places[1], places[1][1:]))
        links, j0 = [], 0
        for i, (x, e) in enumerate(zip(xs, ends[0])):
            for j in range(j0, len(ys)):
                start = ends[1][j] - len(ys[j])
                if ends[1][j] <= e - len(x):
                    j0 = j + 1
                elif start < e:
                    links.append((a[i], b[j]))
                else:
                    break
        made.append((a, b, cut, links, groups))
    count = Counter(p for m in made for p in set(m[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(len(m[0]), len(m[1]), len(m[2]), len(m[3]), hashlib.sha256(m[4].encode()).hexdigest() if m[3] else "", sum(count[p] == best[p[0]] for p in m[3]), sum(count[p] for p in m[3])) for m in made]


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("options", [None, AlignmentOptions(held_pairs=40, buffer=500, cache=50, cache_chars=6)])
def test_alignment_equals_the_libraries(spark, options):
    rng = random.Random(11)
    alphabet = [" ", " ", "a", "b", "the", "é", "\n", "\t", "😀", "▁", "<s>", "<|endoftext|>", "9", "'s", "\x1c", " ", "ing", ".", "  ", "日本"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(400)] + [None, "", " ", "x ", " x", "no mark here", "a▁b"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = align_tokenizers(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), LEFT, RIGHT, digests=True, options=options)
    assert got.columns == ALIGNED
    want = plain_alignment(texts)
    assert [tuple(r)[1:] for r in sorted(got.collect())] == want


@pytest.mark.parametrize("empty", [False, True])
def test_alignment_of_odd_rows(spark, empty):
    docs = odd_documents(spark, empty)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((name, *w) for (name, _), w in zip(rows, plain_alignment([t for _, t in rows]), strict=True))
    assert Counter(tuple(r) for r in align_tokenizers(docs, LEFT, RIGHT, digests=True).collect()) == want


def test_a_transducer_tells_other_bytes():
    t = Aligner(LEFT, RIGHT).transducer
    x = next(i for i, b in enumerate(t.bytes[0]) if b == b" the")
    y = next(i for i, b in enumerate(t.bytes[1]) if b == b" then")
    z = next(i for i, b in enumerate(t.bytes[0]) if b == b"n")
    assert t.align([x, z], [y]) == ([([x, z], [y])], [(x, y), (z, y)])
    assert t.align([x], [y]) is None and t.align([z], [y]) is None and t.align([], []) == ([], [])


def plain_codes(rows, o=CodeOptions()):
    """(codes and errors by row, codebooks) of the contract, in Python integers."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * c) for c in r[1]]))
    q = len(kept[0][1]) // o.parts
    cut = [[[math.floor(1024 * c) for c in v[p * q : (p + 1) * q]] for p in range(o.parts)] for _, v in kept]
    books = [[cut[k][p] for k in range(min(o.entries, len(cut)))] for p in range(o.parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(o.rounds):
        for p in range(o.parts):
            held = defaultdict(list)
            for parts in cut:
                held[nearest(parts[p], books[p])[1]].append(parts[p])
            for k, parts in held.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    out = []
    for (i, _), parts in zip(kept, cut, strict=True):
        found = [nearest(parts[p], books[p]) for p in range(o.parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def vectors(seed, n, d=8, step=1 / 64):
    """Vectors on a coarse grid, so that ties and equal entries abound."""
    rng = random.Random(seed)
    return [(rng.randrange(n) if k % 50 else None, [rng.randrange(-6, 7) * step for _ in range(d)]) for k in range(n)]


@pytest.mark.parametrize(("o", "n"), [(CodeOptions(entries=16), 600), (CodeOptions(entries=7, rounds=6), 300), (CodeOptions(), 90), (CodeOptions(rounds=0, entries=5), 40)])
def test_codes_equal_plain_lloyd(spark, o, n):
    rows = vectors(n, n)
    bad = [(9001, None), (9002, []), (9003, [1.0] * 7 + [None]), (9004, [float("nan")] * 8), (9005, [float("inf")] * 8), (9006, [0.5] * 3), (9007, [1e30] * 8)]
    table = spark.createDataFrame([(i, v, k % 3 if k % 7 else None, "x") for k, (i, v) in enumerate(rows + bad)], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    got = vector_codes(table, o).collect()
    want, digest = plain_codes(rows, o)
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in got) == Counter(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert sum(r["error"] for r in got) == sum({(r["label_error"]) for r in got}) or len({r["label_error"] for r in got}) < 4


def test_large_components_are_counted_in_integers():
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 27), 1 << 27, (50, 4))
    book = Codebook(x[:9])
    at, upper, lower = book.scan(x)
    plain = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(x[:9].tolist())) for v in x.tolist()]
    assert at.tolist() == [k for _, k in plain] and book.errors(x, at).tolist() == [d for d, _ in plain]
    assert all(float(u) ** 2 >= d for u, (d, _) in zip(upper, plain)) and (lower >= 0).all()


def test_bounds_spare_most_scans(spark):
    """Codes of later rounds are right though few parts are scanned."""
    from wickwork.functions.staging import staged
    from wickwork.llm.vector_codes import integer_vectors, moved_books

    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 8))
    data = [(k, (centres[k % 12] + rng.normal(0, 0.01, 8)).tolist(), 0) for k in range(1200)]
    o = CodeOptions(parts=2, entries=12)
    x, d = integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), o)
    start = np.array([r["x"] for r in x.orderBy("vec_id").limit(12).collect()])
    books, state = [Codebook(start[:, :4]), Codebook(start[:, 4:])], x
    for _ in range(2):
        state = staged(lloyd_round(state.filter("part is null") if "part" in state.columns else state, books, d, o), "round")
        books = moved_books(state, books, d, o)
    assert 0 < state.filter("part is not null").agg({"scanned": "sum"}).first()[0] + 1 < 240


def test_no_rows_no_codes(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, x int, part int")
    assert vector_codes(none).collect() == [] and vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert train_codes(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int"))[1] == []
    assert codebooks_digest([]) == hashlib.sha256(b"").hexdigest()

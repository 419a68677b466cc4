"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Texts become multisets of hashed word shingles. Document frequencies of shingles are counted over all documents in
   a count-min sketch of fixed size; the smoothed idf, scaled to (1, 2], times the term frequency is a shingle's weight.
2. Equal texts collapse to one node by their digest. Each node gets ``bands * rows`` consistent weighted samples.
3. Nodes that share a band meet in a bucket. A bucket is a star: every node is compared with one centre, so pairs
   grow with the members and not with their square. Where a comparison fails, the members that may still be alike
   (those that failed, and by the triangle inequality those near the border) and are not yet of one class are
   compared further, each pair in the bucket of the last band that it shares: in one task where they are few and small,
   which gives back the links that join classes; else in blocks, those outside the main class against all. Where many
   are outside the main class, further stars with other centres come first, as long as they halve those.
4. Links of similarity >= ``threshold`` are joined to classes; a class is named by its least doc_id.

Defined results: null texts, empty texts and texts without a word are a class each; texts under ``words`` words are one
shingle; repeated rows share a class; a null doc_id is the least only of classes without any other; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import map_texts, sliced, staged, text_of, worker_state


@dataclass(frozen=True)
class DedupOptions:
    words: int = 5
    bands: int = 20
    rows: int = 3
    threshold: float = 0.8
    #: Rows and bits of a row of the sketch of document frequencies.
    sketch_rows: int = 3
    sketch_bits: int = 17
    #: Bits of a shingle that choose its random draws.
    draw_bits: int = 14
    #: Keys (about 40 bytes each) that are broadcast at most.
    broadcast_rows: int = 500_000
    #: Members and bytes of an unsettled group that one task settles; larger ones are settled in blocks of four times the members.
    group: int = 256
    group_bytes: int = 8 << 20


def _mix(x):
    """A bijective scramble of unsigned 64-bit numbers."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of word shingles, by prefix sums over the bytes of a text."""

    BLOCK = 1 << 16

    def __init__(self, words: int):
        import numpy as np

        self.words = words
        rng = np.random.default_rng(11)
        self.table = rng.integers(1, 1 << 63, 256, dtype="u8")
        self.factors = rng.integers(1, 1 << 63, words + 1, dtype="u8") | np.uint64(1)
        p = 0x9E3779B97F4A7C15
        inverse = pow(p, -1, 1 << 64)
        self.power = np.cumprod(np.full(self.BLOCK + 1, p, "u8"))
        self.inverse = np.cumprod(np.full(self.BLOCK + 1, inverse, "u8"))
        letters = [b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)]
        self.letter = np.array(letters)

    def word_hashes(self, text: str):
        import numpy as np

        data = np.frombuffer(text.lower().encode("utf-8", "replace"), "u1")
        out, at = [], 0
        while at < len(data):
            part = data[at : at + self.BLOCK]
            inside = self.letter[part]
            if at + len(part) < len(data) and inside[-1]:  # cut where a word ends; a word longer than a block is cut
                gaps = np.flatnonzero(~inside)
                if len(gaps):
                    part, inside = part[: gaps[-1] + 1], inside[: gaps[-1] + 1]
            edge = np.diff(np.concatenate(([0], inside.view("i1"), [0])))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(self.table[part] * self.power[: len(part)], dtype="u8")))
            out.append(_mix((sums[ends] - sums[starts]) * self.inverse[starts] + ends.astype("u8") - starts.astype("u8")))
            at += len(part)
        return np.concatenate(out) if out else np.zeros(0, "u8")

    def shingles(self, text: str):
        """One hash a shingle, repeats included; one in all for a short text, none without a word."""
        import numpy as np

        w, k = self.word_hashes(text), self.words
        n = len(w)
        if n == 0:
            return w
        m = min(n, k)
        out = w[: n - m + 1] * self.factors[0]
        for j in range(1, m):
            out = out + w[j : n - m + 1 + j] * self.factors[j]
        return _mix(out + self.factors[k:] * np.uint64(k - m))


class ShingleWeights:
    """Smoothed idf of 32-bit shingles in (1, 2], from a count-min sketch of document frequencies.

    A cell counts the documents of all shingles in it: on average T / cells too many, where T is the number of distinct
    (document, shingle) pairs. That mean is taken off the least cell of a shingle; what is left is off by about its square
    root, so frequencies far above the root of T / cells are right at any input, and rarer ones count as rare.
    """

    def __init__(self, table, documents: int):
        import numpy as np

        self.table, self.n = table, documents
        self.noise = float(table[0].sum()) / table.shape[1]
        self.shift = np.uint64(32 - int(table.shape[1]).bit_length() + 1)

    @staticmethod
    def cell(x, row: int, shift):
        import numpy as np

        factor = np.uint64((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[row])
        return (((x * factor) & np.uint64(0xFFFFFFFF)) >> shift).astype("i8")

    def of(self, shingles):
        import numpy as np

        x = shingles.astype("u8") & np.uint64(0xFFFFFFFF)
        least = self.table[0][self.cell(x, 0, self.shift)]
        for row in range(1, len(self.table)):
            least = np.minimum(least, self.table[row][self.cell(x, row, self.shift)])
        df = np.maximum(1.0, least - self.noise)
        return 1 + np.log((1 + self.n) / np.minimum(1 + df, 1 + self.n)) / max(np.log(1.0 + self.n), 1e-9)


class Sampler:
    """Consistent weighted samples of a multiset of shingles.

    The draws r, c and beta of Ioffe's scheme (two Gamma(2, 1) and a uniform one) are tables over ``draw_bits`` bits of a
    shingle. Of shingles that share draws in one text the heavier, then the smaller hash, stands for both, as in min-hashing.
    """

    BLOCK = 2048

    def __init__(self, weights: ShingleWeights, options: DedupOptions):
        import numpy as np

        self.o, self.weights, self.n = options, weights, options.bands * options.rows
        self.mask, self.h = np.uint64((1 << options.draw_bits) - 1), np.arange(self.n, dtype="u8") * np.uint64(0x632BE59BD9B4E019)
        shape = (1 << options.draw_bits, self.n)
        self.r, self.c, self.beta = np.empty(shape, "f4"), np.empty(shape, "f4"), np.empty(shape, "f4")
        for f in range(0, shape[0], 1024):
            feature = np.arange(f, min(f + 1024, shape[0]), dtype="u8")[:, None]
            seed = _mix(feature + np.uint64(0x9E3779B97F4A7C15) * (np.arange(self.n, dtype="u8") + np.uint64(1)))
            u = [((_mix(seed + np.uint64(k)) >> np.uint64(11)).astype("f8") + 0.5) / float(1 << 53) for k in range(1, 6)]
            self.r[f : f + 1024], self.c[f : f + 1024], self.beta[f : f + 1024] = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]

    def samples(self, shingles, counts):
        """One 64-bit code a hash."""
        import numpy as np

        log_weight = (np.log(self.weights.of(shingles)) + np.log(counts)).astype("f4")
        feature = (shingles & self.mask).astype("i8")
        least, best, turn = np.full(self.n, np.inf, "f4"), np.zeros(self.n, "i8"), np.zeros(self.n, "f4")
        for s in range(0, len(shingles), self.BLOCK):
            f = feature[s : s + self.BLOCK]
            r, beta = self.r[f], self.beta[f]
            t = np.floor(log_weight[s : s + self.BLOCK, None] / r + beta)
            value = self.c[f] - r * (t - beta) - r
            at = value.argmin(0)
            found = np.take_along_axis(value, at[None], 0)[0]
            better = found < least
            least[better], best[better], turn[better] = found[better], at[better] + s, np.take_along_axis(t, at[None], 0)[0][better]
        return _mix(shingles[best] + _mix(turn.astype("i8").view("u8") + self.h))

    def band_keys(self, codes):
        import numpy as np

        o = self.o
        codes = codes.reshape(o.bands, o.rows)
        out = np.arange(o.bands, dtype="u8")
        for j in range(o.rows):
            out = _mix(out + codes[:, j])
        return out.view("i8")


def shingle_weights(docs: DataFrame, o: DedupOptions) -> ShingleWeights:
    """The sketch over all of ``docs``: of fixed size at any input, so it may pass through the driver.

    Each task adds up its documents; parts of the table meet in one shuffle and are added as they stream in.
    """
    import numpy as np

    rows, width, parts = o.sketch_rows, 1 << o.sketch_bits, o.sketch_rows * 16
    shift, size = np.uint64(32 - o.sketch_bits), rows * width // parts

    def count(batches):
        shingler, table, n = Shingler(o.words), np.zeros((rows, width), "i8"), 0
        for batch in sliced(batches):
            held = [np.unique(shingler.shingles(t or "") & np.uint64(0xFFFFFFFF)) for t in batch.column("text").to_pylist()]
            n, x = n + len(held), np.concatenate(held)
            for row in range(rows):
                table[row] += np.bincount(ShingleWeights.cell(x, row, shift), minlength=width)
        flat = table.reshape(parts, size).astype("u4" if n < 1 << 32 else "u8")
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([n] * parts, pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["part", "n", "counts"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for part, n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(part, [0, np.zeros(size, "i8")])
                held[0] += n
                held[1] += np.frombuffer(counts, f"u{len(counts) // size}")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], names=["part", "n", "counts"])

    fields = "part int, n long, counts binary"
    got = docs.select("text").mapInArrow(count, fields).repartition("part").mapInArrow(add, fields).toArrow().sort_by("part")
    if not got.num_rows:
        return ShingleWeights(np.zeros((rows, width), "i8"), 0)
    table = np.concatenate([np.frombuffer(x, "i8") for x in got.column("counts").to_pylist()]).reshape(rows, width)
    return ShingleWeights(table.astype("f4"), got.column("n")[0].as_py())


def signatures(docs: DataFrame, weights: ShingleWeights, o: DedupOptions) -> DataFrame:
    """doc_id, node (digest of the text; null without words), bands, shingles (sorted, 32 bits each, repeats included)."""
    held, key = docs.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex

    def make():
        import numpy as np

        shingler, drawn = worker_state(key, lambda: (Shingler(o.words), Sampler(held.value, o)))

        def work(texts):
            bands, kept = [], []
            for t in texts:
                s, c = np.unique(shingler.shingles(t), return_counts=True)
                bands.append(drawn.band_keys(drawn.samples(s, c)) if len(s) else None)
                kept.append(np.sort(np.repeat(s, c).astype("u4")).tobytes() if len(s) else None)
            return pa.array(bands, pa.list_(pa.int64())), pa.array(kept, pa.binary())

        return work

    rows = docs.select("doc_id", "text", F.unhex(F.md5(text_of().cast("binary"))).alias("node"))
    out = map_texts(rows, make, "bands array<long>, shingles binary", ("doc_id", "node"))
    return out.withColumn("node", F.when(F.col("bands").isNotNull(), F.col("node")))


class Likeness:
    """Weighted Jaccard similarity of shingle multisets (sorted 32-bit hashes, repeats included)."""

    def __init__(self, weights: ShingleWeights):
        self.weights = weights

    def parsed(self, data: bytes):
        """(distinct shingles, their counts, whole weight)."""
        import numpy as np

        u, c = np.unique(np.frombuffer(data, "u4"), return_counts=True)
        return u, c, float((self.weights.of(u) * c).sum())

    def similarity(self, x, y, least: float = 0.0) -> float:
        """The similarity, or 0 where the weights alone keep it under ``least``."""
        import numpy as np

        if min(x[2], y[2]) < least * max(x[2], y[2]):
            return 0.0
        both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
        common = float((self.weights.of(both) * np.minimum(x[1][i], y[1][j])).sum())
        return common / (x[2] + y[2] - common)

    def every_similarity(self, rows):
        """The similarities of all pairs of ``rows``, to about six digits.

        The n-th repeat of a shingle is a feature of its own, so common weights are sums over common features: by products
        of matrices for features that many rows hold, pair by pair for the others.
        """
        import numpy as np

        n, many, width = len(rows), 32, 4096
        key = [np.repeat(u.astype("u8"), c) << np.uint64(32) | (np.arange(c.sum()) - np.repeat(c.cumsum() - c, c)).astype("u8") for u, c, _ in rows]
        row = np.repeat(np.arange(n), [len(k) for k in key])
        key, at, held = np.unique(np.concatenate(key), return_inverse=True, return_counts=True)
        weight = self.weights.of(key >> np.uint64(32))
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        common = np.zeros((n, n))
        some = (held[at] > 1) & (held[at] <= many)
        f, r = at[some], row[some]
        for k in range(1, many):
            same = np.flatnonzero(f[k:] == f[:-k])
            if not len(same):
                break
            common += np.bincount(r[same] * n + r[same + k], weight[f[same]], n * n).reshape(n, n)
        common += common.T
        f, r = at[held[at] > many], row[held[at] > many]
        columns, f = np.unique(f, return_inverse=True)
        for c in range(0, len(columns), width):
            i, j = np.searchsorted(f, (c, c + width))
            x = np.zeros((n, min(width, len(columns) - c)), "f4")
            x[r[i:j], f[i:j] - c] = np.sqrt(weight[columns[f[i:j]]])
            common += x @ x.T
        whole = np.array([x[2] for x in rows])
        return common / (whole[:, None] + whole - common)


def weighted_similarity(pairs: DataFrame, vectors: DataFrame, weights: ShingleWeights, o: DedupOptions) -> DataFrame:
    """a, b, s: the weighted Jaccard similarity of each pair of nodes."""
    held = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        like = Likeness(held.value)
        for batch in sliced(batches):
            out = [like.similarity(like.parsed(x), like.parsed(y)) for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "s"])

    va = vectors.select(F.col("node").alias("a"), F.col("shingles").alias("va"))
    vb = vectors.select(F.col("node").alias("b"), F.col("shingles").alias("vb"))
    return pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(run, "a binary, b binary, s double")


def settled(groups: DataFrame, weights: ShingleWeights, o: DedupOptions) -> DataFrame:
    """a, b, s: links that join the classes of each group (bucket, at, node, label, bands, shingles), of bounded size.

    A pair that shares a later band than the group's is compared there.
    """
    held = groups.sparkSession.sparkContext.broadcast(weights)

    def run(t: pa.Table) -> pa.Table:
        import numpy as np

        like = Likeness(held.value)
        t = t.sort_by("node")
        node, label, at = t.column("node").to_pylist(), t.column("label").to_pylist(), t.column("at").to_pylist()[0]
        bands = np.array(t.column("bands").to_pylist(), "i8")
        rows = [like.parsed(x) for x in t.column("shingles").to_pylist()]
        number = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
        root = list(range(number.max() + 1))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        near = (like.every_similarity(rows) >= o.threshold - 1e-4) & (number[:, None] > number)
        for b in range(at + 1, o.bands):
            near &= bands[:, None, b] != bands[:, b]
        out = []
        for i, j in np.argwhere(near).tolist():
            if (x := find(number[i])) != (y := find(number[j])):
                s = like.similarity(rows[i], rows[j], o.threshold)
                if s >= o.threshold:
                    root[x] = y
                    out.append((node[min(i, j)], node[max(i, j)], s))
        return pa.table({"a": pa.array([r[0] for r in out], pa.binary()), "b": pa.array([r[1] for r in out], pa.binary()), "s": pa.array([r[2] for r in out], pa.float64())})

    return groups.groupBy("bucket").applyInArrow(run, "a binary, b binary, s double")


def blocks(large: DataFrame, o: DedupOptions) -> DataFrame:
    """Groups of bounded size (bucket, at, node, label) in which every pair of ``large`` of different classes meets.

    The main class of a group and the rest are cut into parts; parts of the rest meet each other and those of the main.
    """
    half, half_bytes = 2 * o.group, o.group_bytes / 2
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / half), F.ceil(F.col(size) / half_bytes), F.lit(1)).cast("int")
    rows = large.withColumns({"_k": parts("n_other", "b_other"), "_m": parts("n_main", "b_main"), "_rest": F.col("label") != F.col("main")})
    rows = rows.withColumn("_i", F.pmod(F.xxhash64("node"), F.when(F.col("_rest"), F.col("_k")).otherwise(F.col("_m"))).cast("int"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meet = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    rest = F.concat(F.transform(to("_k"), lambda j: meet("rest", F.least("_i", j), F.greatest("_i", j))), F.transform(to("_m"), lambda j: meet("main", F.col("_i"), j)))
    main = F.transform(to("_k"), lambda i: meet("main", i, F.col("_i")))
    out = rows.select("bucket", "at", "node", "label", F.explode(F.when(F.col("_rest"), rest).otherwise(main)).alias("b"))
    return out.select(F.xxhash64("bucket", "b").alias("bucket"), "at", "node", "label").distinct()


def by_key(rows: DataFrame, small: DataFrame, key: str, hot: int = 10_000) -> DataFrame:
    """``rows`` (a staged table) joined with ``small``, which has one row a key.

    Keys of more than ``hot`` rows, and of more than one in 1,000, are at most 1,000: their rows of ``small`` are broadcast.
    """
    n = rows.count()
    if n <= hot:
        return rows.join(small, key)
    large = staged(rows.groupBy(key).count().filter(F.col("count") > max(hot, n // 1000)).select(key), "hot-keys")
    few = small.join(F.broadcast(large), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(large), key, "left_anti").join(small, key))


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each connected part, by neighbour minima and pointer jumps."""
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        low = staged(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label")), "low")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = staged(by_key(low, jump, "label").select("node", F.least("label", "further").alias("label"), "old"), "labels")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def stars(members: DataFrame, turn: int) -> DataFrame:
    """bucket, at, node, centre, and both as a < b: each member of a bucket (bucket, at, node) but its centre."""
    centres = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("p"), "node")).alias("c"), F.count("*").alias("n")).filter("n > 1").select("bucket", F.col("c.node").alias("centre"))
    star = members.join(centres, "bucket").filter(F.col("node") != F.col("centre"))
    return staged(star.withColumns({"a": F.least("node", "centre"), "b": F.greatest("node", "centre")}), "star")


def similarity_links(rows: DataFrame, weights: ShingleWeights, o: DedupOptions) -> DataFrame:
    """node, label: the classes of linked nodes among ``rows`` (node, bands, shingles; a node may repeat)."""
    spark = rows.sparkSession
    bands = staged(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("bands").alias("bands")), "bands")
    members = bands.select("node", F.posexplode("bands").alias("at", "key")).select(F.xxhash64("at", "key").alias("bucket"), "at", "node")
    star = stars(members, 0)
    if star.isEmpty():
        return spark.createDataFrame([], "node binary, label binary")
    # Nodes without company never have any.
    active = star.select("node").unionByName(star.select(F.col("centre").alias("node"))).distinct()
    vectors = rows.select("node", "shingles").join(active, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    vectors = staged(vectors.join(bands, "node"), "vectors")
    every = staged(weighted_similarity(star.select("a", "b").distinct(), vectors, weights, o), "similarities")
    links = [every.filter(F.col("s") >= o.threshold)]
    scored = star.join(every, ["a", "b"]).select("bucket", "at", "node", "s")
    failed = scored.filter(F.col("s") < o.threshold).groupBy("bucket").agg(F.max("s").alias("near"))
    open_ = scored.join(failed, "bucket").filter((F.col("s") < o.threshold) | (F.col("s") <= F.col("near") + (1 - o.threshold)))
    open_ = staged(open_.select("bucket", "at", "node").join(vectors.select("node", F.length("shingles").alias("size")), "node"), "open")
    turn, before = 0, None
    while True:
        labels = components(reduce(DataFrame.unionByName, links))
        labelled = staged(open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        counts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("size").alias("b"))
        most = F.struct("k", "label")
        sums = counts.groupBy("bucket").agg(F.max_by("label", most).alias("main"), F.max("k").alias("n_main"), F.sum("k").alias("n"), F.max_by("b", most).alias("b_main"), F.sum("b").alias("bytes"))
        sums = sums.filter("n > n_main").withColumns({"n_other": F.col("n") - F.col("n_main"), "b_other": F.col("bytes") - F.col("b_main")})
        left = staged(labelled.join(sums, "bucket"), "unsettled")
        wide = left.filter(F.col("n_other") > 16 * o.group)
        outside = wide.filter(F.col("label") != F.col("main")).count()
        if outside == 0 or (before is not None and 2 * outside > before):
            break
        turn, before = turn + 1, outside
        own = wide.select("bucket", "at", "node")
        again = stars(own, turn).join(wide.select("bucket", "node", "label"), ["bucket", "node"])
        again = again.join(wide.select("bucket", F.col("node").alias("centre"), F.col("label").alias("of")), ["bucket", "centre"]).filter(F.col("label") != F.col("of"))
        links.append(staged(weighted_similarity(again.select("a", "b").distinct(), vectors, weights, o).filter(F.col("s") >= o.threshold), "similarities"))
    here = (F.col("n") <= o.group) & (F.col("bytes") <= o.group_bytes)
    groups = left.filter(here).select("bucket", "at", "node", "label").unionByName(blocks(left.filter(~here), o))
    links.append(staged(settled(groups.join(vectors, "node"), weights, o), "settled"))
    return components(reduce(DataFrame.unionByName, links))


def near_duplicates(docs: DataFrame, options: DedupOptions | None = None) -> DataFrame:
    """doc_id, node and class_id of every row of ``docs``; rows of one class have equal or similar texts."""
    o = options or DedupOptions()
    weights = shingle_weights(docs, o)
    rows = staged(signatures(docs, weights, o), "signatures")
    labels = similarity_links(rows.select("node", "bands", "shingles"), weights, o)
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    named = staged(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    names = named.groupBy("label").agg(F.min("least").alias("class_id"))
    classes = by_key(named.select("node", "label"), names, "label").select("node", "class_id")
    return rows.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, options: DedupOptions | None = None) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id. Rows without a word or an id all stay."""
    o = options or DedupOptions()
    classes = staged(near_duplicates(docs, o), "classes")
    digest = F.unhex(F.md5(text_of().cast("binary")))
    dropped = classes.filter(F.col("node").isNotNull() & (F.col("doc_id") != F.col("class_id"))).select("doc_id", "node").distinct()
    repeated = classes.filter(F.col("node").isNotNull() & (F.col("doc_id") == F.col("class_id"))).groupBy("doc_id", "node").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "node")
    left = docs.withColumn("node", digest).join(_small(dropped, o), ["doc_id", "node"], "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(_small(repeated, o), ["doc_id", "node"], "left_anti")
    more = left.join(_small(repeated, o), ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"])
    return once.unionByName(more).select(*docs.columns)


def _small(keys: DataFrame, o: DedupOptions) -> DataFrame:
    """``keys`` to be broadcast where they are counted to be few, so that texts need no shuffle; else as they are."""
    keys = staged(keys, "keys")
    return F.broadcast(keys) if keys.count() <= o.broadcast_rows else keys

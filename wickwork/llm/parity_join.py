"""Jaccard self-join of word-shingle sets by parity sketches, and its connected components.

1. A document's set holds the 64-bit hashes of its distinct shingles. XOR-ing a set's hashes into bits gives a parity
   sketch: bits in which two sketches differ come from shingles of one set alone, so the Hamming distance never exceeds
   the symmetric difference. Linked sets of a size band differ in at most d shingles, which the band's sizes bound.
2. Per band a sketch is cut into more than d blocks, by the hashes. At least one block that a set has shingles in is then
   untouched, so linked sets share a block. A block's parity over all 2^64 positions is kept as the XOR of its hashes.
   A set meets its own band and, where a smaller partner can lie there, the band below.
3. Blocks of frequent shingles alone (shared passages, groups of copies) would bring together sets that have little else in
   common. Sketches are therefore taken over rare shingles where these fill more than d blocks; only sets that have too few
   rare ones give blocks of all their shingles too. A pair meets in the blocks that the set with more rare shingles gives,
   for every set gives its rare blocks. Frequencies come from a count-min sketch; whatever it says of a shingle it says of
   it in all sets, so it decides on speed and not on results.
4. Blocks that hold two texts or more are kept, one of those that hold the same texts. In each, one centre is compared with
   all others: sizes and whole sketches first, then the sets. Members that are not yet of one component meet further
   centres; what is left then meets in parts of bounded size, which give back only links that join components.

Defined results: texts that are null, empty or without a word have an empty set, are linked with nothing and are components
of their own; fewer words than a shingle are one shingle; repeated rows and texts with equal sets share a component; a null
doc_id is a component's name only where it has no other; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import sliced, staged, text_of, worker_state
from wickwork.llm.minhash_dedup import _mix, blocks, by_key, components


#: Bits of a block's key and of a text's digest. The bits of a key and the low ones of a digest fill one long of a shuffled row.
KEY_BITS, TEXT_BITS = 44, 52
LOW = 64 - KEY_BITS


@dataclass(frozen=True)
class JoinOptions:
    words: int = 4
    #: Sets link where denominator * |intersection| >= numerator * |union|.
    numerator: int = 85
    denominator: int = 100
    #: Ratio of the largest to the least size of a band; at least denominator / numerator.
    band: float = 1.5
    #: A shingle is rare up to this many documents, or up to this share of all.
    rare: int = 512
    rare_share: float = 0.001
    sketch_rows: int = 2
    sketch_bits: int = 18
    #: Rows (about 40 bytes each) that are broadcast at most.
    broadcast_rows: int = 500_000
    #: Centres that a block compares with its members before all are compared in parts.
    turns: int = 2
    #: Members and bytes of a part; the names are those that ``blocks`` reads.
    group: int = 256
    group_bytes: int = 8 << 20


class ShingleSets:
    """Sorted distinct 64-bit shingle hashes of texts: polynomial hashes of words, by prefix sums over their bytes."""

    P = 0x9E3779B97F4A7C15

    def __init__(self, words: int):
        import numpy as np

        self.words = words
        rng = np.random.default_rng(29)
        self.table = rng.integers(1, 1 << 63, 256, dtype="u8")
        self.table[65:91] = self.table[97:123]  # A-Z count as a-z
        self.factors = rng.integers(1, 1 << 63, words + 1, dtype="u8") | np.uint64(1)
        self.inside = np.ones(256, bool)
        self.inside[[32, *range(9, 14)]] = False
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        import numpy as np

        self.power = np.cumprod(np.full(n + 1, self.P, "u8"))
        self.inverse = np.cumprod(np.full(n + 1, pow(self.P, -1, 1 << 64), "u8"))

    def word_hashes(self, text: str):
        import numpy as np

        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
        if len(data) >= len(self.power):
            self._powers(2 * len(data))
        edge = np.diff(np.concatenate(([0], self.inside[data].view("i1"), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(self.table[data] * self.power[: len(data)], dtype="u8")))
        return _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype("u8"))

    def of(self, text: str):
        import numpy as np

        w, k = self.word_hashes(text), self.words
        n = len(w)
        if n == 0:
            return w
        m = min(n, k)
        out = w[: n - m + 1] * self.factors[0]
        for j in range(1, m):
            out = out + w[j : n - m + 1 + j] * self.factors[j]
        return np.unique(_mix(out + self.factors[k:] * np.uint64(k - m)))


class Bands:
    """Size bands: ``starts[j]`` is the least size of band j."""

    def __init__(self, o: JoinOptions):
        self.o, self.starts = o, [1, 2]

    def of(self, n: int) -> int:
        from bisect import bisect_right

        while self.starts[-2] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.o.band)))
        return bisect_right(self.starts, n) - 1

    def difference(self, j: int) -> int:
        """The most shingles in which linked sets differ, of which the smaller is in band j."""
        o, most = self.o, self.starts[j + 1] - 1
        return (o.denominator - o.numerator) * (most + most * o.denominator // o.numerator) // (o.denominator + o.numerator)

    def count(self, j: int) -> int:
        """Blocks of band j: over the bound, and a few more, so that sets with empty blocks still fill more than the bound."""
        d = self.difference(j)
        return d + 1 + (d // 50 + 3 if d else 0)

    def bits(self, j: int) -> int:
        return max(64, 1 << (2 * self.starts[j + 1] - 1).bit_length())

    def meets_below(self, n: int, j: int) -> bool:
        return j > 0 and (self.starts[j] - 1) * self.o.denominator >= n * self.o.numerator


def parity(hashes, bits: int):
    """The parity sketch, as 64-bit words."""
    import numpy as np

    odd = np.bincount((hashes >> np.uint64(64 - bits.bit_length() + 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1")).view("u8")


def block_keys(hashes, rare, j: int, bands: Bands):
    """The keys of the blocks in which a set can meet its partners in band j: of 44 bits, as two blocks that share a key cost
    a comparison and no result; the last bit tells odd from even bands.
    """
    import numpy as np

    k, d = bands.count(j), bands.difference(j)

    def made(h, level: int, empty: bool):
        b = ((h >> np.uint64(11)) % np.uint64(k)).astype("i8")
        order = np.argsort(b, kind="stable")
        b, h = b[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, "i8")
        block, word = b[first], np.bitwise_xor.reduceat(h, first) if len(b) else h
        filled = len(block)
        if empty and filled <= d:
            gone = np.setdiff1d(np.arange(k), block)
            block, word = np.concatenate((block, gone)), np.concatenate((word, np.zeros(len(gone), "u8")))
        place = _mix(block.astype("u8") + np.uint64((level << 20 | j) << 40 | 1))
        return _mix(word ^ place) >> np.uint64(64 - KEY_BITS) & ~np.uint64(1) | np.uint64(j & 1), filled

    keys, filled = made(hashes[rare], 0, False)
    if filled > d:
        return keys
    return np.concatenate((keys, made(hashes, 1, True)[0]))


class Frequencies:
    """Document frequencies of shingles, at least the true ones less the mean overcount of a count-min sketch."""

    def __init__(self, table, documents: int, o: JoinOptions):
        self.table, self.shift = table, 64 - o.sketch_bits
        self.most = max(o.rare, int(documents * o.rare_share)) + int(table[0].sum() / table.shape[1])

    @staticmethod
    def cell(x, row: int, shift: int):
        import numpy as np

        factor = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[row])
        return ((x * factor) >> np.uint64(shift)).astype("i8")

    def rare(self, x):
        import numpy as np

        least = self.table[0][self.cell(x, 0, self.shift)]
        for row in range(1, len(self.table)):
            least = np.minimum(least, self.table[row][self.cell(x, row, self.shift)])
        return least <= self.most


def frequencies(docs: DataFrame, o: JoinOptions) -> Frequencies:
    """The sketch over all of ``docs``: of fixed size at any input. Tasks add up; parts of the table meet in one shuffle."""
    import numpy as np

    rows, width, parts = o.sketch_rows, 1 << o.sketch_bits, o.sketch_rows * 16
    shift, size = 64 - o.sketch_bits, rows * width // parts

    def count(batches):
        sets, table, n = ShingleSets(o.words), np.zeros((rows, width), "i8"), 0
        for batch in sliced(batches):
            held = [sets.of(t) if t else np.zeros(0, "u8") for t in batch.column("text").to_pylist()]
            n, x = n + len(held), np.concatenate(held)
            for row in range(rows):
                table[row] += np.bincount(Frequencies.cell(x, row, shift), minlength=width)
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
        return Frequencies(np.zeros((rows, width), "i8"), 0, o)
    table = np.concatenate([np.frombuffer(x, "i8") for x in got.column("counts").to_pylist()]).reshape(rows, width)
    return Frequencies(table, got.column("n")[0].as_py(), o)


def _node() -> F.Column:
    return F.unhex(F.md5(text_of().cast("binary")))


def sketched(docs: DataFrame, known: Frequencies, o: JoinOptions) -> DataFrame:
    """doc_id, node (digest of the text; null without a word), n (set size), keys (of blocks) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np

        sets, bands = worker_state(f"shingle sets {o.words}", lambda: ShingleSets(o.words)), Bands(o)
        for batch in sliced(batches):
            node, n, keys = [], [], []
            for text, digest in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), strict=True):
                h = sets.of(text or "")
                n.append(len(h))
                node.append(digest if len(h) else None)
                if not len(h):
                    keys.append(None)
                    continue
                rare, j = held.value.rare(h), bands.of(len(h))
                found = [block_keys(h, rare, j, bands)]
                if bands.meets_below(len(h), j):
                    found.append(block_keys(h, rare, j - 1, bands))
                keys.append(np.concatenate(found).view("i8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "keys"])

    return docs.select("doc_id", "text", _node().alias("node")).mapInArrow(run, f"doc_id {kind}, node binary, n long, keys array<long>")


def met(keys: DataFrame) -> DataFrame:
    """bucket, t of every block of every row of ``keys`` (keys, t), dealt by bucket. Most blocks hold one text, so sums of a task
    would be as many and wider than their rows: a row is moved as a long and an int.
    """
    rows = keys.select(F.explode("keys").alias("bucket"), "t")
    rows = rows.select(F.shiftleft("bucket", LOW).bitwiseOR(F.col("t").bitwiseAND(F.lit((1 << LOW) - 1))).alias("both"), F.shiftright(F.shiftleft("t", 64 - TEXT_BITS), 32).cast("int").alias("high"))
    bucket = F.shiftrightunsigned("both", LOW)
    t = F.shiftleft(F.col("high").cast("long").bitwiseAND(F.lit((1 << 32) - 1)), LOW).bitwiseOR(F.col("both").bitwiseAND(F.lit((1 << LOW) - 1)))
    return rows.repartition(bucket).select(bucket.alias("bucket"), t.alias("t"))


def members_of(rows: DataFrame, o: JoinOptions) -> DataFrame:
    """bucket, node, n, t (digest of node), centre (the least t of its block), size (rows of the block): the texts of every
    block that holds two texts or more. Of blocks that hold the same texts one stays: the others' pairs are the same.
    """
    keys = rows.filter(F.col("node").isNotNull()).withColumn("t", F.shiftrightunsigned(F.xxhash64("node"), 64 - TEXT_BITS))
    # Two texts with one digest of 52 bits in a block, or two blocks with equal sums of 62 bits, would be taken for one.
    low = lambda k: F.sum(F.shiftright("t", k).bitwiseAND(F.lit((1 << 31) - 1)))
    held = met(keys).groupBy("bucket").agg(F.min("t").alias("centre"), F.max("t").alias("last"), F.count("*").alias("size"), low(0).alias("x"), low(31).alias("y"))
    one = held.filter("centre < last").groupBy("centre", "last", "size", "x", "y", F.col("bucket").bitwiseAND(F.lit(1)).alias("odd")).agg(F.min("bucket").alias("bucket"))
    shared = staged(one.select("bucket", "centre", "size"), "shared-blocks")
    few = F.broadcast(shared) if shared.count() <= o.broadcast_rows else shared
    return staged(keys.select(F.explode("keys").alias("bucket"), "node", "n", "t").join(few, "bucket").dropDuplicates(["bucket", "node"]), "members")


def active_sets(docs: DataFrame, rows: DataFrame, members: DataFrame, o: JoinOptions) -> DataFrame:
    """node, n, band, own, below (parity sketches for its band and the one below), hashes: of every text that has company."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    first = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(name).alias("name"))
    active = staged(members.select("node").distinct().join(first, "node"), "active")
    few = F.broadcast(active) if active.count() <= o.broadcast_rows else active
    texts = docs.select("text", _node().alias("node"), name.alias("name")).join(few, ["node", "name"], "left_semi")

    def run(batches):
        sets, bands = worker_state(f"shingle sets {o.words}", lambda: ShingleSets(o.words)), Bands(o)
        for batch in sliced(batches):
            made = [sets.of(t) for t in batch.column("text").to_pylist()]
            at = [bands.of(len(h)) for h in made]
            own = [parity(h, bands.bits(j)).tobytes() for h, j in zip(made, at, strict=True)]
            below = [parity(h, bands.bits(j - 1)).tobytes() if bands.meets_below(len(h), j) else None for h, j in zip(made, at, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(h) for h in made], pa.int64()), pa.array(at, pa.int32()), pa.array(own, pa.binary()), pa.array(below, pa.binary()), pa.array([h.tobytes() for h in made], pa.binary())],
                names=["node", "n", "band", "own", "below", "hashes"],
            )

    made = texts.select("node", "text").mapInArrow(run, "node binary, n long, band int, own binary, below binary, hashes binary")
    return staged(made.dropDuplicates(["node"]), "active-sets")


def _alike_sizes(n: str, m: str, o: JoinOptions):
    return F.least(n, m) * o.denominator >= F.greatest(n, m) * o.numerator


def _sets_of(rows: DataFrame, sets: DataFrame, o: JoinOptions, *columns: str) -> DataFrame:
    """The sets of the nodes in ``columns`` of ``rows``: where these are counted to be few, others are not shuffled."""
    nodes = staged(reduce(DataFrame.unionByName, [rows.select(F.col(c).alias("node")) for c in columns]).distinct(), "nodes")
    return sets.join(F.broadcast(nodes) if nodes.count() <= o.broadcast_rows else nodes, "node", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame, o: JoinOptions) -> DataFrame:
    """The ``pairs`` (a, b) whose sets link: by sizes, then sketches, then the sets. ``a`` may be one node's in many pairs."""
    pairs = staged(pairs.distinct(), "pairs")
    own = _sets_of(pairs, sets, o, "a", "b")
    sketch = lambda side: own.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "band", "own", "below")))
    rows = by_key(pairs, sketch("a"), "a").join(sketch("b"), "b").filter(_alike_sizes("n_a", "n_b", o))

    def near(batches):
        import numpy as np

        for batch in sliced(batches, 4096):
            keep = []
            for na, nb, ja, jb, oa, ob, la, lb in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "band_a", "band_b", "own_a", "own_b", "below_a", "below_b")), strict=True):
                x, y = (oa, ob) if ja == jb else (oa, lb) if ja < jb else (la, ob)
                differ = int(np.bitwise_count(np.frombuffer(x, "u8") ^ np.frombuffer(y, "u8")).sum())
                keep.append((o.denominator + o.numerator) * differ <= (o.denominator - o.numerator) * (na + nb))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield out

    close = staged(rows.select("a", "b", "n_a", "n_b", "band_a", "band_b", "own_a", "own_b", "below_a", "below_b").mapInArrow(near, "a binary, b binary"), "close-pairs")
    near_sets = _sets_of(close, sets, o, "a", "b")
    whole = lambda side: near_sets.select(F.col("node").alias(side), F.col("hashes").alias(f"h_{side}"))

    def verify(batches):
        import numpy as np

        for batch in sliced(batches, 1024):
            keep = []
            for x, y in zip(batch.column("h_a").to_pylist(), batch.column("h_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(o.denominator * both >= o.numerator * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(by_key(close, whole("a"), "a").join(whole("b"), "b").select("a", "b", "h_a", "h_b").mapInArrow(verify, "a binary, b binary"), "links")


def _placed(groups: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """``groups`` (bucket, at, node, label) with n, the block's band, the sketch for it, and whether the set is of the band above.

    Among many blocks some of bands 2, 4, ... apart have one key. Their sets never link, and their sketches differ in length:
    a group is the members of one bucket and one band.
    """
    above = (F.col("band") % 2) != F.col("at")
    rows = groups.join(sets.select("node", "n", "band", "own", "below", *more), "node")
    return rows.select("bucket", "at", "node", "label", "n", (F.col("band") - above.cast("int")).alias("of"), above.alias("above"), F.when(above, F.col("below")).otherwise(F.col("own")).alias("sketch"), *more)


class _Group:
    """The members of a part, and for each the later ones that sizes and sketches do not rule out."""

    def __init__(self, t: pa.Table, o: JoinOptions):
        import numpy as np

        self.o, self.n, self.above = o, t.column("n").to_numpy(), t.column("above").to_numpy(zero_copy_only=False)
        self.label = np.unique([x.hex() for x in t.column("label").to_pylist()], return_inverse=True)[1]
        self.bits = np.stack([np.frombuffer(x, "u8") for x in t.column("sketch").to_pylist()])

    def near(self, i: int):
        import numpy as np

        o, n, m = self.o, self.n[i], self.n[i + 1 :]
        at = np.flatnonzero((self.label[i + 1 :] != self.label[i]) & ~(self.above[i + 1 :] & self.above[i]) & (np.minimum(m, n) * o.denominator >= np.maximum(m, n) * o.numerator))
        differ = np.bitwise_count(self.bits[i + 1 + at] ^ self.bits[i]).sum(1)
        return at[(o.denominator + o.numerator) * differ.astype("i8") <= (o.denominator - o.numerator) * (m[at] + n)] + i + 1


def possible(groups: DataFrame, sets: DataFrame, o: JoinOptions) -> DataFrame:
    """The rows of ``groups`` that have a partner of another label which sizes and sketches do not rule out."""

    def run(t: pa.Table) -> pa.Table:
        import numpy as np

        g, keep = _Group(t, o), np.zeros(t.num_rows, bool)
        for i in range(t.num_rows - 1):
            near = g.near(i)
            if len(near):
                keep[i] = keep[near] = True
        return t.select(["bucket", "at", "node", "label"]).filter(pa.array(keep))

    return _placed(groups, sets).groupBy("bucket", "of").applyInArrow(run, "bucket long, at int, node binary, label binary")


def settled(groups: DataFrame, sets: DataFrame, o: JoinOptions) -> DataFrame:
    """a, b: links that join the labels of each group (bucket, at, node, label), of bounded size: at most one a member."""

    def run(t: pa.Table) -> pa.Table:
        import numpy as np

        g, node = _Group(t, o), t.column("node").to_pylist()
        held = [np.frombuffer(x, "u8") for x in t.column("hashes").to_pylist()]
        a, b = [], []
        for i in range(len(node) - 1):
            for k in g.near(i).tolist():
                if g.label[i] != g.label[k]:
                    both = len(np.intersect1d(held[i], held[k], assume_unique=True))
                    if o.denominator * both >= o.numerator * (len(held[i]) + len(held[k]) - both):
                        a.append(node[i])
                        b.append(node[k])
                        g.label[g.label == g.label[k]] = g.label[i]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return _placed(groups, sets, "hashes").groupBy("bucket", "of").applyInArrow(run, "a binary, b binary")


def labelled(left: DataFrame, links: list[DataFrame]) -> DataFrame:
    """``left`` (bucket, node, n) with the label of each node's component."""
    labels = components(reduce(DataFrame.unionByName, links))
    return staged(left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def set_links(members: DataFrame, sets: DataFrame, o: JoinOptions) -> DataFrame:
    """node, label: the components of all texts that are linked."""
    names = members.filter(F.col("t") == F.col("centre")).select("centre", F.col("node").alias("a")).distinct()
    stars = staged(members.filter(F.col("t") != F.col("centre")).select("centre", F.col("node").alias("b")).distinct(), "stars")
    links = [linked(by_key(stars, names, "centre").select("a", "b"), sets, o)]
    # A centre has met all of its block; a block of two is done.
    left = members.filter((F.col("size") > 2) & (F.col("t") != F.col("centre"))).select("bucket", "node", "n")
    for turn in range(1, o.turns + 1):
        own = labelled(left, links)
        # A label is drawn before a node, so that components of few members have their turn.
        first = F.min(F.struct(F.xxhash64("label", F.lit(turn)).alias("l"), F.xxhash64("node", F.lit(turn)).alias("p"), "node", "label")).alias("c")
        blocks_ = staged(own.groupBy("bucket").agg(first, F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("bucket", F.col("c.node").alias("a"), F.col("c.label").alias("of")), "open-blocks")
        if blocks_.isEmpty():
            return components(reduce(DataFrame.unionByName, links))
        met = staged(by_key(own, blocks_, "bucket"), "met")
        links.append(linked(met.filter(F.col("label") != F.col("of")).select("a", F.col("node").alias("b")), sets, o))
        left = met.filter(F.col("node") != F.col("a")).select("bucket", "node", "n")
    own = labelled(left, links)
    counts = own.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum(8 * F.col("n")).alias("b"))
    most = F.struct("k", "label")
    sums = counts.groupBy("bucket").agg(F.max_by("label", most).alias("main"), F.max("k").alias("n_main"), F.sum("k").alias("m"), F.max_by("b", most).alias("b_main"), F.sum("b").alias("bytes")).filter("m > n_main")
    sums = staged(sums.withColumns({"n_other": F.col("m") - F.col("n_main"), "b_other": F.col("bytes") - F.col("b_main")}), "open-blocks")
    if not sums.isEmpty():
        rows = by_key(own, sums, "bucket").withColumn("at", F.col("bucket").bitwiseAND(F.lit(1)).cast("int"))
        small = (F.col("m") <= o.group) & (F.col("bytes") <= o.group_bytes)
        cols = ["bucket", "at", "node", "label"]
        groups = rows.filter(small).select(*cols).unionByName(blocks(rows.filter(~small), o).select(*cols))
        left = staged(possible(groups, _sets_of(rows, sets, o, "node"), o), "possible")
        links.append(staged(settled(left, _sets_of(left, sets, o, "node"), o), "settled"))
    return components(reduce(DataFrame.unionByName, links))


def set_components(docs: DataFrame, options: JoinOptions | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    o = options or JoinOptions()
    rows = staged(sketched(docs, frequencies(docs, o), o), "sketched")
    members = members_of(rows, o)
    labels = set_links(members, active_sets(docs, rows, members, o), o)
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    named = staged(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = by_key(named.select("node", "label"), names, "label").select("node", "component_id")
    own = by_key(rows.select("doc_id", "node", "n").filter(F.col("node").isNotNull()), found, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter(F.col("node").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionByName(alone)

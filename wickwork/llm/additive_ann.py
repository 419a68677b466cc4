"""Nearest neighbours by additive quantisation, for the largest inner product.

Codebooks of full dimension are fitted one on the residuals of the others, on a bounded sample drawn by a hash of the
id. Equal vectors become one row, with the ``k + 1`` smallest of their ids: no others can be among the nearest ``k``. Every
vector is encoded by a beam search over sums of codewords, and stores its codes, the ratio of its norm to its
reconstruction's and the length of what the reconstruction misses. A query scores codes by look-up tables of its inner
products with the codewords. What a score may be off by is at most that length times the query's norm, so a vector whose
score with this margin stays below the ``k`` best known can be left out for sure; the others are scored exactly in the same
task, so no row distribution costs recall. The few best of each task meet in a window and are joined with their vectors.
Queries go out in blocks of fixed size, each against all codes.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite parts
take no part; a query has fewer than ``k`` results if there are fewer candidates; ties go to the smaller id; rows that
repeat a query's id count as the query itself (with two vectors it asks with the smaller), repeats of another id as one; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import hash_share, share_for, staged, worker_state

if TYPE_CHECKING:
    import numpy as np


@dataclass(frozen=True)
class AdditiveOptions:
    k: int = 20
    codebooks: int = 16
    codewords: int = 256
    beam: int = 4
    #: Rows that the codebooks are fitted on, about.
    sample: int = 16_000
    rounds: int = 8
    #: Vectors of the first batch of a task that are scored exactly for each query, to have a bound for the others.
    shortlist: int = 400
    #: Queries a block.
    block: int = 4096
    seed: int = 5


class AdditiveQuantiser:
    """``books``: (codebooks, codewords, dimension)."""

    def __init__(self, books, options: AdditiveOptions):
        import numpy as np

        self.books, self.o = books, options
        self.norms = (books.astype("f8") ** 2).sum(2).astype("f4")
        flat = np.asarray(books, "f4").reshape(-1, books.shape[2])
        self.cross = (flat @ flat.T).reshape(books.shape[:2] * 2).transpose(0, 2, 1, 3)

    @classmethod
    def fit(cls, x, o: AdditiveOptions) -> AdditiveQuantiser:
        """Residual k-means for a start, then codewords by least squares for the beam's codes."""
        import numpy as np

        rng, x = np.random.default_rng(o.seed), np.asarray(x, "f4")
        rest, books = x.copy(), []
        for _ in range(o.codebooks):
            c = rest[rng.integers(0, len(rest), o.codewords)] + rng.normal(0, 1e-4, (o.codewords, x.shape[1])).astype("f4")
            for _ in range(o.rounds):
                near = (rest @ c.T * 2 - (c**2).sum(1)).argmax(1)
                n = np.bincount(near, minlength=o.codewords)
                sums = np.zeros_like(c)
                np.add.at(sums, near, rest)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            rest -= c[(rest @ c.T * 2 - (c**2).sum(1)).argmax(1)]
            books.append(c)
        start = np.stack(books)
        codes = cls(start, o).encode(x)
        m, k = o.codebooks, o.codewords
        gram, right = np.zeros((m * k, m * k)), np.zeros((m * k, x.shape[1]))
        np.fill_diagonal(gram, 0.05)
        at = codes.astype("i8") + np.arange(m) * k
        for i in range(m):
            np.add.at(right, at[:, i], x)
            for j in range(m):
                np.add.at(gram, (at[:, i], at[:, j]), 1.0)
        right += 0.05 * start.reshape(m * k, -1)
        return cls(np.linalg.solve(gram, right).reshape(m, k, -1).astype("f4"), o)

    def encode(self, x):
        """Codes (rows, codebooks) by beam search on the squared error of the sum."""
        import numpy as np

        o, out = self.o, []
        for s in range(0, len(x), 2048):
            part = np.asarray(x[s : s + 2048], "f4")
            dots = np.einsum("nd,mkd->nmk", part, self.books, optimize=True)
            codes, cost = np.zeros((len(part), 1, 0), "i4"), np.zeros((len(part), 1), "f4")
            for m in range(o.codebooks):
                step = self.norms[m] - 2 * dots[:, m]
                grown = cost[:, :, None] + step[:, None, :]
                for j in range(m):
                    grown += 2 * self.cross[j, m][codes[:, :, j]]
                flat = grown.reshape(len(part), -1)
                width = min(o.beam, flat.shape[1])
                best = np.argpartition(flat, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(flat, best, 1)
                beam, word = best // o.codewords, best % o.codewords
                codes = np.concatenate((np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None].astype("i4")), 2)
            out.append(np.take_along_axis(codes, cost.argmin(1)[:, None, None], 1)[:, 0])
        return np.concatenate(out).astype("u1" if o.codewords <= 256 else "u2")

    def decode(self, codes):
        return sum(self.books[m][codes[:, m]] for m in range(self.o.codebooks))


def usable(col: str, size: int | None = None) -> Column:
    """Whether a vector takes part."""
    c = F.col(col)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda v: v != 0)
    return F.coalesce(ok & (F.size(c) == size) if size else ok, F.lit(False))


def build_index(vectors: DataFrame, options: AdditiveOptions | None = None, vec: str = "embedding", id_: str = "vec_id") -> tuple[DataFrame, np.ndarray] | None:
    """(first, hash, ids, x, codes, ratio, miss) of every distinct usable vector, written in the shared folder, and the codebooks.

    ``first`` is the smallest of ``ids``; with the hash of the vector it names the row.
    """
    import numpy as np

    o = options or AdditiveOptions()
    rows = vectors.filter(F.col(id_).isNotNull() & usable(vec)).select(F.col(id_).cast("long").alias("vec_id"), F.transform(vec, lambda v: v.cast("double")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]["d"], sizes[0]["n"]
    rows = rows.filter(F.size("x") == d)
    drawn = rows.filter(hash_share(F.col("vec_id")) < share_for(o.sample, n)).limit(2 * o.sample)
    if drawn.isEmpty():
        drawn = rows.limit(o.sample)

    def fit(batches):
        drawn = pa.Table.from_batches([b for b in batches if b.num_rows])
        order = np.argsort(drawn.column("vec_id").to_numpy(), kind="stable")
        x = np.array(drawn.column("x").combine_chunks().flatten().to_numpy()).reshape(-1, d)[order]
        books = AdditiveQuantiser.fit(np.unique(x, axis=0), o).books
        yield pa.RecordBatch.from_arrays([pa.array([books.tobytes()], pa.binary())], names=["books"])

    # Fitted in one task over the bounded sample: its matrices would take most of the driver's memory.
    books = np.frombuffer(drawn.coalesce(1).mapInArrow(fit, "books binary").collect()[0]["books"], "f4").reshape(o.codebooks, o.codewords, d)
    held, key = vectors.sparkSession.sparkContext.broadcast(books), f"additive-{uuid.uuid4().hex}"
    # The rank's limit is applied in each task before the shuffle, so a vector that very many rows share costs little.
    least = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("r") <= o.k + 1)
    unique = least.groupBy("x").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("first"), F.xxhash64("x").alias("hash"), "ids", "x")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q = worker_state(key, lambda: AdditiveQuantiser(held.value, o))
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                codes = q.encode(x)
                made = q.decode(codes).astype("f8")
                near, norm = _norms(made), _norms(x)
                ratio = np.where(near > 1e-30, norm / np.maximum(near, 1e-30), 1.0)
                # Beyond the range of float32 nothing is known of a score: the margin is without end then.
                with np.errstate(all="ignore"):
                    miss = _norms(x - made * ratio[:, None]) * (1 + 1e-6) + 1e-4 * (norm + near * ratio)
                miss = np.where(np.isfinite(miss) & (norm < 1e15) & (near < 1e15) & (ratio < 1e15), miss, np.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ratio, pa.float64()), pa.array(miss, pa.float64())], names=["first", "hash", "ids", "x", "codes", "ratio", "miss"])

    return staged(unique.mapInArrow(run, "first long, hash long, ids array<long>, x array<double>, codes binary, ratio double, miss double"), "codes"), books


def _norms(x):
    """Euclidean lengths of rows, without overflow or loss of small ones."""
    import numpy as np

    scale = np.abs(x).max(1)
    scale = np.where((scale > 0) & np.isfinite(scale), scale, 1.0)
    return scale * np.sqrt(((x / scale[:, None]) ** 2).sum(1))


def candidates(index: DataFrame, books: np.ndarray, ids, q, o: AdditiveOptions) -> DataFrame:
    """query_id, first, hash, near: the ``2 k`` best rows of each task, for a block of queries.

    Codes are scored by look-up tables; rows that their margin of error cannot rule out are scored exactly.
    """
    import numpy as np

    held, keep = index.sparkSession.sparkContext.broadcast((ids, q, books)), 2 * o.k
    group = 64  # queries at once

    def run(batches):
        ids, q, books = held.value
        length = _norms(q)
        with np.errstate(all="ignore"):
            tables = np.ascontiguousarray(np.einsum("qd,mkd->qmk", q.astype("f4"), books, optimize=True))
        safe = np.isfinite(tables).all((1, 2)) & (length > 1e-15) & (length < 1e15)
        best = [(np.zeros(0), np.zeros((0, 2), "i8"))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column("first").to_numpy(), batch.column("hash").to_numpy()], 1)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "u1" if o.codewords <= 256 else "u2").reshape(len(names), -1)
            columns, ratio, miss = [codes[:, m].astype("i8") for m in range(codes.shape[1])], batch.column("ratio").to_numpy(), batch.column("miss").to_numpy()
            for s in range(0, len(ids), group):
                part = range(s, min(s + group, len(ids)))
                asked = []
                for k in part:
                    score, row = best[k]
                    if not safe[k]:
                        asked.append(np.arange(len(names)))
                        continue
                    approx = tables[k, 0].take(columns[0])
                    for m in range(1, len(columns)):
                        approx += tables[k, m].take(columns[m])
                    with np.errstate(all="ignore"):
                        bound = approx * ratio + miss * length[k]
                    bound[np.isnan(bound)] = np.inf
                    least = score.min() if len(score) == keep else -np.inf
                    if least == -np.inf and len(names) > o.shortlist:
                        top = np.argpartition(-bound, o.shortlist - 1)[: o.shortlist]
                        first = x[top] @ q[k]
                        if len(first) > keep:
                            least = np.partition(first, len(first) - keep)[len(first) - keep]
                    # What the exact scores' own rounding may hide stays in.
                    asked.append(np.flatnonzero(~(bound < least - 1e-9 * abs(least))))
                # Where most rows remain, one product of matrices costs less than rows picked query by query.
                many = sum(map(len, asked)) > 0.05 * len(names) * len(asked)
                whole = q[s : s + len(asked)] @ x.T if many else None
                for i, (k, at) in enumerate(zip(part, asked, strict=True)):
                    exact = whole[i, at] if many else x[at] @ q[k]
                    exact = np.where(np.isnan(exact), -np.inf, exact)
                    score, row = best[k]
                    score, row = np.concatenate((score, exact)), np.concatenate((row, names[at]))
                    if len(score) > keep:
                        # Ties go to the smaller id, so all that tie with the last one kept are put in order.
                        edge = np.partition(score, len(score) - keep)[len(score) - keep]
                        at = np.flatnonzero(score >= edge)
                        at = at[np.lexsort((row[at, 1], row[at, 0], -score[at]))[:keep]]
                        score, row = score[at], row[at]
                    best[k] = (score, row)
        for s in range(0, len(ids), 256):
            part = best[s : s + 256]
            row = np.concatenate([r for _, r in part])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[s : s + 256], [len(x) for x, _ in part])), pa.array(row[:, 0]), pa.array(row[:, 1]), pa.array(np.concatenate([x for x, _ in part]), pa.float64())], names=["query_id", "first", "hash", "near"])

    return index.select("first", "hash", "x", "codes", "ratio", "miss").mapInArrow(run, "query_id long, first long, hash long, near double")


def search(index: DataFrame, books: np.ndarray, queries: DataFrame, options: AdditiveOptions | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each of ``queries`` (query_id, x).

    Of a query id with several vectors the least vector is taken.
    """
    import numpy as np

    o = options or AdditiveOptions()
    spark, d = index.sparkSession, books.shape[2]
    queries = staged(queries.groupBy("query_id").agg(F.array_min(F.collect_set("x")).alias("x")), "queries")
    total = queries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = -(-total // o.block)
    found = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = block.toArrow()  # about ``block`` rows
        if not got.num_rows:
            continue
        x = np.array(got.column("x").combine_chunks().flatten().to_numpy()).reshape(-1, d)
        near = candidates(index, books, got.column("query_id").to_numpy(), x, o)
        w = Window.partitionBy("query_id").orderBy(F.desc("near"), "first", "hash")
        short = staged(near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * o.k).select("query_id", "first", "hash"), "shortlist")
        asked = F.broadcast(block.withColumnRenamed("x", "q"))  # about ``block`` rows
        exact = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        scored = short.join(index.select("first", "hash", "ids", "x"), ["first", "hash"]).join(asked, "query_id").select("query_id", "ids", exact.alias("score"))
        rows = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").filter(F.col("vec_id") != F.col("query_id"))
        part = staged(_nearest_of(rows, o.k), "found")
        found = part if found is None else found.unionByName(part)
    return found


def _nearest_of(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows (query_id, vec_id, score) of each query; an id counts once."""
    one = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, options: AdditiveOptions | None = None, every: int = 20) -> DataFrame:
    """The nearest rows of each row whose id is divisible by ``every``."""
    built = build_index(vectors, options)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, books = built
    usable_rows = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding", books.shape[2]) & (F.pmod("vec_id", F.lit(every)) == 0))
    queries = usable_rows.select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return search(index, books, queries, options)

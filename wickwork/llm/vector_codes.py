"""Vector codes: product codebooks of integers, refined by Lloyd rounds that skip scans by Hamerly's bounds.

A vector is cut into equal consecutive parts; each part has a codebook of its own. Every part of every vector keeps one
upper bound of its distance to its entry and one lower bound of the distance to the second nearest, both rounded outwards.
When entries move, the bounds are widened by how far they moved. A part is scanned against the whole codebook, in integers,
only where its upper bound, made exact first, is not strictly below both the lower bound and half the way from its entry to
the nearest other one: a strict bound leaves no tie, and the scan gives ties to the lower index.

A round is one pass over the table of the round before: it writes the new codes and bounds, and each task adds one row an
entry with the sums of its parts. What meets on the driver are codebooks, of fixed size.

Defined results: vectors that are null, empty, or hold null or non-finite components are dropped; so are vectors of another
length than most (ties: the longest) and those with a component so large that an error would leave 64 bits (131,072 and
more in 64 dimensions). A length that is no multiple of the parts gives the first parts one component more. Rows that
repeat an id are rows of their own, ordered by id, then vector; a null id comes last. Fewer than ``entries`` rows give as
many entries; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.functions.staging import discard
from wickwork.llm.common import sliced, staged


@dataclass(frozen=True)
class CodeOptions:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def integer_vectors(embeddings: DataFrame, o: CodeOptions) -> tuple[DataFrame, int]:
    """(vec_id, label, x of the rows that take part, their length)."""
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", "label", "embedding").filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    lengths = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    if not lengths:
        return rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("x")), 0
    d = lengths[0]["d"]
    limit = isqrt((1 << 61) // d) // o.scale
    rows = rows.filter((F.size(v) == d) & F.forall(v, lambda c: F.abs(c.cast("double")) < limit))
    return rows.select("vec_id", "label", F.transform(v, lambda c: F.floor(c.cast("double") * o.scale).cast("int")).alias("x")), d


def cuts(d: int, parts: int) -> list[tuple[int, int]]:
    """First and last (exclusive) component of each part."""
    sizes = [d // parts + (k < d % parts) for k in range(parts)]
    return [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(parts)]


def squared_distances(x, entries):
    """Exact integer squared distances of rows and entries."""
    import numpy as np

    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = "f8" if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else "i8"  # sums of whole numbers below 2^53 are exact
    x, entries = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)).astype("i8")


def _up(v):
    import numpy as np

    return np.nextafter((v * (1 + 1e-12)).astype("f4"), np.float32(np.inf))


def _down(v):
    import numpy as np

    return np.nextafter((v - np.abs(v) * 1e-12).astype("f4"), np.float32(-np.inf))


class Codebook:
    """The entries of one part, how far they moved from those before, and half the way to their nearest neighbours."""

    def __init__(self, entries, before=None):
        import numpy as np

        self.entries = np.asarray(entries, "i8")
        k = len(self.entries)
        between = np.sqrt(squared_distances(self.entries, self.entries).astype("f8"))
        np.fill_diagonal(between, np.inf)
        self.half = between.min(1) * (0.5 * (1 - 1e-12)) if k > 1 else np.full(k, np.inf)
        self.moved = None
        if before is not None:
            self.moved = np.sqrt(((self.entries - before.entries) ** 2).sum(1).astype("f8")) * (1 + 1e-12)
            order = np.argsort(-self.moved)
            self.furthest = order[0]
            self.most, self.second = self.moved[order[0]], self.moved[order[1]] if k > 1 else 0.0

    def scan(self, x):
        """(index, upper, lower) by all distances."""
        import numpy as np

        d = squared_distances(x, self.entries)
        at, row = d.argmin(1), np.arange(len(x))
        best = d[row, at]
        d[row, at] = np.iinfo("i8").max
        second = np.sqrt(d.min(1).astype("f8")) if len(self.entries) > 1 else np.full(len(x), np.inf)
        return at, _up(np.sqrt(best.astype("f8"))), _down(second)

    def errors(self, x, at):
        return ((x - self.entries[at]) ** 2).sum(1)

    def assign(self, x, at, upper, lower):
        """The new (index, upper, lower), and how many rows were scanned."""
        import numpy as np

        upper = _up(upper.astype("f8") + self.moved[at])
        lower = _down(lower.astype("f8") - np.where(at == self.furthest, self.second, self.most))
        bound = np.maximum(lower, self.half[at])
        open_ = np.flatnonzero(~(upper < bound))
        upper[open_] = _up(np.sqrt(self.errors(x[open_], at[open_]).astype("f8")))
        open_ = open_[~(upper[open_] < bound[open_])]
        if len(open_):
            at = at.copy()
            at[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return at, upper, lower, len(open_)


_STATE = "x array<int>, code array<int>, upper array<float>, lower array<float>, part int, entry int, n long, sums array<long>, scanned long"


def _lists(values, kind):
    import numpy as np

    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _matrix(column, width):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ids(df: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return f"vec_id {kinds['vec_id']}, label {kinds['label']}"


def lloyd_round(state: DataFrame, books: list[Codebook], d: int, o: CodeOptions) -> DataFrame:
    """One row a vector with its codes and bounds (part null), and of every task one row an entry with its count and sums."""
    held, first, spans = state.sparkSession.sparkContext.broadcast(books), "code" not in state.columns, cuts(d, o.parts)
    names = [x.split()[0] for x in f"{_ids(state)}, {_STATE}".split(", ")]

    def run(batches):
        import numpy as np

        books = held.value
        sums = [np.zeros((len(b.entries), e - s), "i8") for b, (s, e) in zip(books, spans, strict=True)]
        counts = [np.zeros(len(b.entries), "i8") for b in books]
        schema, scanned = None, 0
        for batch in sliced(batches, 4096):
            x = _matrix(batch.column("x"), d).astype("i8")
            n = len(x)
            code, upper, lower = np.zeros((n, o.parts), "i4"), np.zeros((n, o.parts), "f4"), np.zeros((n, o.parts), "f4")
            old = None if first else (_matrix(batch.column("code"), o.parts), _matrix(batch.column("upper"), o.parts), _matrix(batch.column("lower"), o.parts))
            for p, (book, (s, e)) in enumerate(zip(books, spans, strict=True)):
                part = x[:, s:e]
                if old is None:
                    at, up, down, seen = *book.scan(part), n
                else:
                    at, up, down, seen = book.assign(part, old[0][:, p].astype("i8"), old[1][:, p].copy(), old[2][:, p].copy())
                code[:, p], upper[:, p], lower[:, p] = at, up, down
                scanned += seen
                counts[p] += np.bincount(at, minlength=len(book.entries))
                np.add.at(sums[p], at, part)
            none = lambda kind, n=n: pa.nulls(n, kind)
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("x"), _lists(code, pa.int32()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.int64())]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            schema = out.schema
            yield out
        if schema is not None:
            rows = [{"part": p, "entry": e, "n": int(counts[p][e]), "sums": sums[p][e].tolist(), "scanned": 0} for p in range(o.parts) for e in np.flatnonzero(counts[p]).tolist()]
            rows[0]["scanned"] = scanned
            yield pa.RecordBatch.from_pylist(rows, schema)

    return state.mapInArrow(run, f"{_ids(state)}, {_STATE}")


def moved_books(state: DataFrame, books: list[Codebook], d: int, o: CodeOptions) -> list[Codebook]:
    """The codebooks of floored means; an entry without parts stays."""
    import numpy as np

    rows = state.filter(F.col("part").isNotNull()).select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    got = rows.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()  # entries times components
    part, entry, at, n, s = (got.column(c).to_numpy() for c in ("part", "entry", "at", "n", "s"))
    out = []
    for p in range(len(books)):
        entries, own = books[p].entries.copy(), part == p
        entries[entry[own], at[own]] = np.floor_divide(s[own], n[own])
        out.append(Codebook(entries, books[p]))
    return out


def train_codes(embeddings: DataFrame, options: CodeOptions | None = None) -> tuple[DataFrame, list]:
    """(vec_id, label, code binary, error of every row that takes part, the final codebooks as integer arrays)."""
    import numpy as np

    o = options or CodeOptions()
    vectors, d = integer_vectors(embeddings, o)
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(o.entries).toArrow() if d else None
    if start is None or not start.num_rows:
        return embeddings.sparkSession.createDataFrame([], f"{_ids(vectors)}, code binary, error long"), []
    x = np.array(start.column("x").to_pylist(), "i8")
    books, state = [Codebook(x[:, s:e]) for s, e in cuts(d, o.parts)], vectors
    for k in range(o.rounds):
        new = staged(lloyd_round(state, books, d, o), "codes")
        books = moved_books(new, books, d, o)
        if k:
            discard(state)
        state = new.filter(F.col("part").isNull()).select("vec_id", "label", "x", "code", "upper", "lower")
        state.staged_at = new.staged_at
    return final_codes(state, books, d, o), [b.entries for b in books]


def final_codes(state: DataFrame, books: list[Codebook], d: int, o: CodeOptions) -> DataFrame:
    """vec_id, label, code, error: every part assigned to the final codebooks."""
    held, spans, first = state.sparkSession.sparkContext.broadcast(books), cuts(d, o.parts), "code" not in state.columns

    def run(batches):
        import numpy as np

        for batch in sliced(batches, 4096):
            x = _matrix(batch.column("x"), d).astype("i8")
            code, error = np.zeros((len(x), o.parts), "u1"), np.zeros(len(x), "i8")
            for p, (book, (s, e)) in enumerate(zip(held.value, spans, strict=True)):
                part = x[:, s:e]
                if first:
                    at = book.scan(part)[0]
                else:
                    old = [_matrix(batch.column(c), o.parts)[:, p] for c in ("code", "upper", "lower")]
                    at = book.assign(part, old[0].astype("i8"), old[1].copy(), old[2].copy())[0]
                code[:, p] = at
                error += book.errors(part, at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, f"{_ids(state)}, code binary, error long")


def codebooks_digest(books: list) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, options: CodeOptions | None = None) -> DataFrame:
    """vec_id, code (hexadecimal), error, label_error and codebooks_sha256 of every row that takes part."""
    from wickwork.llm.minhash_dedup import by_key

    coded, books = train_codes(embeddings, options)
    named = F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("null")).alias("label")
    rows = staged(coded.select("vec_id", named, "code", "error"), "errors")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = by_key(rows, sums, "label")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))

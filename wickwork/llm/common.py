"""Shared helpers: table access, batches in slices, state of worker processes, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.functions.staging import shared_dir, staged

__all__ = ["hash_share", "id_crc", "map_texts", "share_for", "shared_dir", "sliced", "staged", "table", "text_of", "worker_state"]

#: Rows of a batch that are worked on at once: bounds what a Python worker holds beside the batch.
SLICE = 256
_state: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as decimal text; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def hash_share(col: Column) -> Column:
    """A number in [0, 1) fixed by the value of ``col``: the basis of repeatable bounded samples."""
    return (F.xxhash64(col, F.lit(20240229)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def worker_state(key: str, make: Callable):
    """``make()``, kept for the next tasks of this worker process.

    One key at a time: workers are reused from stage to stage, and what an earlier operator held must not add up.
    """
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def sliced(batches, rows: int = SLICE) -> Iterator:
    """The batches in slices of at most ``rows`` rows; freed Arrow memory goes back when they end."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def map_texts(docs: DataFrame, make, fields: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of ``docs`` and new ``fields`` computed from whole texts (null: empty).

    ``make()`` is called once a task and gives a function from a list of texts to the columns of ``fields``.
    """
    import pyarrow as pa

    need = list(dict.fromkeys((*carry, "text")))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [x.strip().split(" ", 1)[0] for x in _fields(fields)]

    def run(batches):
        work = make()
        for batch in sliced(batches):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            made = work(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)], names=[*carry, *names])

    return docs.select(*need).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), fields]))


def _fields(fields: str) -> list[str]:
    """The fields of a DDL string, split at commas outside angle brackets."""
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def share_for(wanted: int, total: int) -> float:
    """The hash share that keeps about ``wanted`` of ``total`` rows."""
    return 1.0 if total <= wanted else wanted / total

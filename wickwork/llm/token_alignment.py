"""Cross-tokenizer alignment by a dangling-suffix transducer, with corpus-wide counts of linked ids.

Two token streams spell the same bytes. The transducer's state is which side leads and the bytes of its last token that the
other side has not matched yet; the next token always comes from the side that lags. A shorter token eats into the
residual, a longer one takes the lead with what it has over, and an empty residual closes a group. Each step links the
lagging token with the leader's last one. Steps are memoised by (state, token): residuals are suffixes of vocabulary entries.

No token of either side goes on past a single space between two other characters that are no white space, and no merge
crosses it, so texts are aligned chunk by chunk between such spaces, and a bounded cache keeps the chunks seen.

Counts: how many documents hold an id pair is added up within tasks and then over all; pairs seen most often, of a bounded
number, are broadcast, and the rest are joined document by document. The highest count of a left id is a table of the
vocabulary's size.

Defined results: null and empty texts, and texts whose tokens do not spell space + text (a word mark in the text), have no
tokens: zeros, and an empty digest. Repeated rows are documents of their own; a null doc_id stays; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import sliced, staged, worker_state

MARK = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class AlignmentOptions:
    #: Pairs (12 to 16 bytes each) that are broadcast at most.
    held_pairs: int = 1 << 20
    #: Pairs that a task holds before it hands counts on.
    buffer: int = 4_000_000
    #: Chunks of a cache generation, and characters of a chunk that is kept.
    cache: int = 400_000
    cache_chars: int = 64


def byte_level() -> dict[str, int]:
    """The byte of every character of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Aligns two id sequences by the bytes of their tokens."""

    LIMIT = 2_000_000

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.bytes = (left, right)
        self.number: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.leads: list[int] = [0]
        self.steps: dict[tuple[int, int], int] = {}
        self.first = [self._state(0, b) for b in left]

    def _state(self, side: int, rest: bytes) -> int:
        """0 for an empty residual; else the number of (leading side, residual)."""
        if not rest:
            return 0
        found = self.number.get((side, rest))
        if found is None:
            found = self.number[side, rest] = len(self.states)
            self.states.append((side, rest))
            self.leads.append(side)
        return found

    def _step(self, state: int, token: int) -> int:
        """The state after the lagging side's ``token``; -1 where the bytes differ."""
        side, rest = self.states[state]
        new = self.bytes[1 - side][token]
        if rest.startswith(new):
            out = self._state(side, rest[len(new) :])
        elif new.startswith(rest):
            out = self._state(1 - side, new[len(rest) :])
        else:
            out = -1
        if len(self.steps) >= self.LIMIT:
            self.steps.clear()
        self.steps[state, token] = out
        return out

    def walk(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """(where each group ends in ``a``, and in ``b``, the links' left ids, their right ids), None where the bytes differ."""
        ends_a, ends_b, lefts, rights, state, i, j, x, y, m, n = [], [], [], [], 0, 0, 0, 0, 0, len(a), len(b)
        known, leads, first = self.steps.get, self.leads, self.first
        while True:
            if state == 0:
                if i == m:
                    return (ends_a, ends_b, lefts, rights) if j == n else None
                x = a[i]
                i += 1
                state = first[x]
            if leads[state] == 0:
                if j == n:
                    return None
                token = y = b[j]
                j += 1
            else:
                if i == m:
                    return None
                token = x = a[i]
                i += 1
            new = known((state, token))
            state = self._step(state, token) if new is None else new
            if state <= 0:
                if state < 0:
                    return None
                ends_a.append(i)
                ends_b.append(j)
            lefts.append(x)
            rights.append(y)

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]] | None:
        """(groups, links) of two sequences, None where they spell different bytes."""
        found = self.walk(a, b)
        if found is None:
            return None
        ends_a, ends_b, lefts, rights = found
        return [(a[i:k], b[j:e]) for i, k, j, e in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b)], list(zip(lefts, rights, strict=True))


class Aligner:
    """Encodes texts with a byte-level file (left) and a piece model (right), and aligns them chunk by chunk."""

    def __init__(self, left_file: str, right_file: str, options: AlignmentOptions | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.o = options or AlignmentOptions()
        self.left = Tokenizer.from_file(left_file)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=right_file)
        table = byte_level()
        spelt = {i: bytes(table[c] for c in s) for s, i in self.left.get_vocab(with_added_tokens=False).items() if all(c in table for c in s)}
        left = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        m = self.right
        right = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
        self.transducer = Transducer(left, right)
        self.shift, self.kind = key_layout(len(left), len(right))
        self.names = [f"{i}|" for i in range(len(left))], [str(i) for i in range(len(right))]
        self.cache: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Pieces of space + text, each without its first space, that both sides encode by themselves."""
        words = text.split(" ")
        if words == text.split():
            return words
        words = CUT.split(" " + text)
        words[0] = words[0][1:]
        return words

    def _align_all(self, chunks: list[str]) -> list[tuple | None]:
        """(left tokens, right tokens, groups, text of the groups, keys of the links) of each chunk."""
        encoded = [e.ids for e in self.left.encode_batch([" " + c for c in chunks], add_special_tokens=False)]
        out, shift, code, walk = [], self.shift, "I" if self.kind == "u4" else "Q", self.transducer.walk
        left, right = self.names
        for a, b in zip(encoded, self.right.encode(chunks), strict=True):
            found = walk(a, b)
            if found is None:
                out.append(None)
                continue
            ends_a, ends_b, xs, ys = found
            if len(ends_a) == len(a) == len(b):  # token by token
                text = ";".join([left[x] + right[y] for x, y in zip(a, b)])
            else:
                text, i, j = [], 0, 0
                for k, e in zip(ends_a, ends_b):
                    text.append(left[a[i]] + right[b[j]] if k - i == e - j == 1 else f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:e]))}")
                    i, j = k, e
                text = ";".join(text)
            out.append((len(a), len(b), len(ends_a), text, array(code, [x << shift | y for x, y in zip(xs, ys)]).tobytes()))
        return out

    def aligned(self, texts: list[str]) -> list[tuple]:
        """(left tokens, right tokens, groups, text of the groups, sorted link keys, how often each occurs) of each text."""
        import numpy as np

        split = [self.chunks(t) if t else [] for t in texts]
        known: dict[str, tuple | None] = {}
        new: list[str] = []
        cache, old = self.cache, self.old
        for c in set().union(*split):
            if c in cache:
                known[c] = cache[c]
            elif c in old:
                known[c] = self._keep(c, old[c])
            else:
                new.append(c)
        at = 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (to == at or size + len(new[to]) <= 200_000):  # bounds what the libraries hold at once
                size += len(new[to])
                to += 1
            for c, found in zip(new[at:to], self._align_all(new[at:to]), strict=True):
                known[c] = self._keep(c, found)
            at = to
        out = []
        for s in split:
            rows = list(map(known.__getitem__, s))
            if not rows or None in rows:
                out.append((0, 0, 0, None, np.zeros(0, self.kind), np.zeros(0, "i8")))
                continue
            a, b, g, text, keys = zip(*rows, strict=True)
            k, n = np.unique(np.frombuffer(b"".join(keys), self.kind), return_counts=True)
            out.append((sum(a), sum(b), sum(g), ";".join(text), k, n))
        return out

    def _keep(self, chunk: str, found: tuple | None) -> tuple | None:
        if len(chunk) <= self.o.cache_chars:
            if len(self.cache) >= self.o.cache:
                self.old, self.cache = self.cache, {}
            self.cache[chunk] = found
        return found


def key_layout(left: int, right: int) -> tuple[int, str]:
    """Bits of a right id in a link key, and the key's type."""
    return (16, "u4") if max(left, right) <= 1 << 16 else (32, "u8")


def aligned_documents(docs: DataFrame, left_file: str, right_file: str, digests: bool = False, options: AlignmentOptions | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`; with ``digests`` its SHA-256, groups_sha256) and, for
    ``with_counts``, uid, keys (sorted link keys) and times (how often each occurs) of every row."""
    o = options or AlignmentOptions()
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = "groups_sha256" if digests else "groups"

    def run(batches):
        import numpy as np

        made = worker_state(f"aligner {left_file} {right_file}", lambda: Aligner(left_file, right_file, o))
        made.o = o
        task, row = os.urandom(12).hex(), 0
        for batch in sliced(batches, 64):
            rows = made.aligned(["" if t is None else t for t in batch.column("text").to_pylist()])
            texts = ["" if r[3] is None else hashlib.sha256(r[3].encode()).hexdigest() if digests else r[3] for r in rows]
            uids = [f"{task}-{row + k}" for k in range(len(rows))]
            row += len(rows)
            ints = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            links = pa.array([int(r[5].sum()) for r in rows], pa.int64())
            times = [r[5].astype("u4").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *ints, links, pa.array(texts, pa.string()), pa.array(uids), pa.array([np.ascontiguousarray(r[4]).tobytes() for r in rows], pa.binary()), pa.array(times, pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", name, "uid", "keys", "times"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, {name} string, uid string, keys binary, times binary")


def pair_counts(aligned: DataFrame, kind: str, o: AlignmentOptions) -> DataFrame:
    """key, n: how many rows hold each linked id pair. Tasks add up what they have before it is shuffled."""

    def run(batches):
        import numpy as np

        held, size = [], 0

        def counted():
            k, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k.astype("i8")), pa.array(n.astype("i8"))], names=["key", "n"])

        for batch in sliced(batches, 1024):
            for x in batch.column("keys").to_pylist():
                held.append(np.frombuffer(x, kind))
                size += len(held[-1])
            if size >= o.buffer:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return aligned.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, vocabularies: tuple[int, int], options: AlignmentOptions | None = None) -> DataFrame:
    """``aligned`` (a staged table) with n_best (links whose count is their left id's highest) and count_sum."""
    o = options or AlignmentOptions()
    shift, kind = key_layout(*vocabularies)
    spark = aligned.sparkSession
    counts = staged(pair_counts(aligned, kind, o), "pair-counts")
    best = counts.groupBy(F.shiftright("key", shift).alias("a")).agg(F.max("n").alias("best"))  # at most the left vocabulary
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().orderBy(F.desc("e")).collect()  # 64 rows at most
    least, total = 64, 0
    for r in sizes:
        total += r["count"]
        if total > o.held_pairs:
            break
        least = r["e"]
    hot = counts.filter(F.floor(F.log2("n")) >= least).toArrow().sort_by("key")
    tops = best.toArrow()
    held = spark.sparkContext.broadcast(tuple(t.column(c).to_numpy() for t, c in ((hot, "key"), (hot, "n"), (tops, "a"), (tops, "best"))))
    names = [c for c in aligned.columns if c not in ("keys", "times")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name in names)

    def run(batches):
        import numpy as np

        key, n, a, b = held.value
        highest = np.zeros(int(a.max(initial=0)) + 1, "i8")
        highest[a] = b
        for batch in sliced(batches, 1024):
            n_best, count_sum, rest, rest_times = [], [], [], []
            for x, t in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist(), strict=True):
                k, times = np.frombuffer(x, kind).astype("i8"), np.frombuffer(t, "u4").astype("i8")
                at = np.minimum(np.searchsorted(key, k), max(0, len(key) - 1))
                known = key[at] == k if len(key) else np.zeros(len(k), bool)
                count = n[at[known]]
                count_sum.append(int((count * times[known]).sum()))
                n_best.append(int(times[known][count == highest[k[known] >> shift]].sum()))
                rest.append(k[~known])
                rest_times.append(times[~known])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.array(rest, pa.list_(pa.int64())), pa.array(rest_times, pa.list_(pa.int64()))], names=[*names, "n_best", "count_sum", "rest", "rest_times"])

    out = aligned.mapInArrow(run, f"{fields}, n_best long, count_sum long, rest array<long>, rest_times array<long>")
    if least == 0 or not sizes or total <= o.held_pairs:
        return out.drop("rest", "rest_times", "uid")
    # The other pairs are rarer than each of held_pairs / 2 or more pairs, or than twice the most frequent: no key is hot.
    out = staged(out, "partly-counted")
    tail = counts.filter(F.floor(F.log2("n")) < least).withColumn("a", F.shiftright("key", shift)).join(F.broadcast(best), "a")
    open_ = out.select("uid", F.inline(F.arrays_zip(F.col("rest").alias("key"), F.col("rest_times").alias("times"))))
    more = open_.join(tail, "key").groupBy("uid").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    out = out.join(more, "uid", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.drop("rest", "rest_times", "uid", "more_best", "more_sum")


def align_tokenizers(docs: DataFrame, left_file: str, right_file: str, digests: bool = False, options: AlignmentOptions | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (with ``digests`` groups_sha256), n_best, count_sum of every row."""
    import sentencepiece
    from tokenizers import Tokenizer

    sizes = Tokenizer.from_file(left_file).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=right_file).get_piece_size()
    rows = staged(aligned_documents(docs, left_file, right_file, digests, options), "aligned")
    return with_counts(rows, sizes, options)

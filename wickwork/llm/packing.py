"""Packing: sum-of-squares online placement of token pieces into windows of fixed length.

A document is its ids followed by the end id, cut every ``window`` ids. Each packer keeps a level array: how many
open windows are filled to each level. A piece goes to the level that makes the sum of squared counts smallest (the
fuller on ties), or opens a window. Packers work on hash shares of about ``per_packer`` pieces, in a fixed order, and
place each piece as it comes, so memory is bounded by the open windows.

Defined results: a null text is empty and gives the end id alone; very long texts become full windows and a rest;
repeated rows are packed as often as they occur; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import os
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import sliced, staged, worker_state

#: Words of one generation of the cache, and characters of a word that is kept: some 250 MB a worker in two generations.
CACHE_WORDS = 800_000
CACHE_CHARS = 64
#: ASCII marks that are words of their own beside letters; not the apostrophe, which starts contractions, nor the delimiter's first.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class WordTokenizer:
    """A tokenizers file, applied per blank-separated word with a bounded cache.

    Only for files whose pre-tokenizer drops white space, so that no token spans a blank.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        if self.inner.encode("a b", add_special_tokens=False).ids != self.inner.encode("a", add_special_tokens=False).ids + self.inner.encode("b", add_special_tokens=False).ids:
            raise ValueError("blanks are part of this file's tokens")
        added = self.inner.get_added_tokens_decoder()
        self.delimiter_id = min(added)
        self.delimiter = added[self.delimiter_id].content
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        marks = f"([{re.escape(MARKS)}]*)"
        self.plain = re.compile(f"{marks}([A-Za-zÀ-ÖØ-öø-ÿ]+){marks}").fullmatch
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _alone(self, word: str) -> bytes:
        import numpy as np

        return np.array(self.inner.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _delimited(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, many in one call: joined by the delimiter's token, and cut at its id."""
        import numpy as np

        plain = [w for w in words if "<" not in w]
        ids = np.array(self.inner.encode(self.delimiter.join(plain), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(ids == self.delimiter_id)
        if len(cuts) != max(0, len(plain) - 1):  # the delimiter's token came out of a word
            return {w: self._alone(w) for w in words}
        starts, ends, data = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)], ids.tobytes()
        found = {w: data[a:b] for w, a, b in zip(plain, starts, ends, strict=False)}
        for w in words:
            if w not in found:
                found[w] = self._alone(w)
        return found

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of plain letters, each one word to the tokenizer: blank-separated, and cut at word ends."""
        import numpy as np

        ids = np.array(self.inner.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):  # a word of letters came out as more than one word
            return {w: self._alone(w) for w in words}
        data, ends = ids.tobytes(), ends.tolist()
        return {w: data[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}

    def _fresh(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not in the cache. Marks before and after letters are words of their own to the tokenizer."""
        get, old, out, parts, cores, other = self.cache.get, self.old, {}, [], {}, []
        for w in words:
            if (found := old.get(w)) is not None:
                out[w] = found
                continue
            core = w.strip(MARKS)
            if core.isascii() and core.isalpha():
                at = w.index(core)
                before, after = w[:at], w[at + len(core) :]
            elif m := self.plain(w):
                before, core, after = m.groups()
            else:
                other.append(w)
                continue
            core = core.lower()
            parts.append((w, before, core, after))
            cores[core] = None
        new = []
        for c in cores:
            if (found := get(c)) is None:
                new.append(c)
            else:
                cores[c] = found
        for k in range(0, len(new), 20_000):
            cores |= self._letters(new[k : k + 20_000])
        marks = {"": b""}
        new = {x for _, a, _, b in parts for x in (a, b)} - {""}
        if new:
            marks |= self._delimited(list(new))
        for w, a, core, b in parts:
            out[w] = marks[a] + cores[core] + marks[b]
        for k in range(0, len(other), 2_000):
            out |= self._delimited(other[k : k + 2_000])
        return out

    def coded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers.

        Each text is split, looked up and joined while its words are in the processor's cache; only the places of
        words that the cache lacks wait for the call that encodes those of all texts.
        """
        get, out, waiting, lacking = self.cache.get, [], [], set()
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            ids = list(map(get, words))
            if None in ids:
                places = [k for k, x in enumerate(ids) if x is None]
                missed = [words[k] for k in places]
                lacking.update(missed)
                waiting.append((len(out), places, missed))
                out.append(ids)
            else:
                out.append(b"".join(ids))
        if waiting:
            fresh = self._fresh(lacking)
            for n, places, missed in waiting:
                ids = out[n]
                for k, w in zip(places, missed, strict=True):
                    ids[k] = fresh[w]
                out[n] = b"".join(ids)
            if len(self.cache) + len(fresh) > CACHE_WORDS:
                self.old, self.cache = self.cache, {}
            self.cache.update((w, x) for w, x in fresh.items() if len(w) <= CACHE_CHARS)
        return out


def tokenizer(path: str) -> WordTokenizer:
    """One a worker process and file."""
    return worker_state(f"words {path}", lambda: WordTokenizer(path))


def document_pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, as 32-bit little-endian bytes) of every piece."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np

        t, end = tokenizer(path), int(end_id).to_bytes(4, "little")
        for batch in sliced(batches, 1024):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            row, start, size, crc, total, ids, at = [], [], [], [], [], [], 0
            while at < len(texts):
                upto, chars = at + 1, len(texts[at])
                while upto < len(texts) and chars + len(texts[upto]) < 1_000_000:  # bounds what is split at once
                    chars, upto = chars + len(texts[upto]), upto + 1
                for k, data in enumerate(t.coded(texts[at:upto])):
                    data += end
                    for s in range(0, len(data), 4 * window):
                        piece = data[s : s + 4 * window]
                        row.append(at + k)
                        start.append(s // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(data) // 4)
                        if with_ids:
                            ids.append(piece)
                at = upto
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(np.array(x, "i8"), pa.int64()) for x in (start, size, crc, total))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}" + ", ids binary" * with_ids)


class LevelPacker:
    """Windows opened so far, by fill level."""

    def __init__(self, window: int):
        import numpy as np

        self.np, self.window, self.count, self.next = np, window, np.zeros(window + 1, "i8"), 0
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> tuple[int, int]:
        """(number of the window, offset in it) for a piece of ``size``."""
        np, n, w = self.np, self.count, self.window
        level = 0
        if size < w:
            # Moving one window from level h to h + size changes the sum of squares by 2 (n[h + size] - n[h]) + 2.
            rise = 2 * (n[size + 1 : w + 1] - n[1 : w + 1 - size]) + 2
            rise[-1] -= 1 + 2 * n[w]  # a window that becomes full leaves the sum
            rise = np.where(n[1 : w + 1 - size] > 0, rise, np.iinfo("i8").max)
            k = len(rise) - 1 - int(np.argmin(rise[::-1])) if len(rise) else -1
            if k >= 0 and rise[k] <= 2 * n[size] + 1:
                level = k + 1
        if level:
            number = self.open[level].pop()
            n[level] -= 1
        else:
            number, self.next = self.next, self.next + 1
        if level + size < w:
            self.open.setdefault(level + size, []).append(number)
            n[level + size] += 1
        return number, level


def pack(pieces: DataFrame, window: int = 2048, per_packer: int = 100_000) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...; a table on disk) with sequence_id and offset."""
    import pyarrow as pa
    from pyspark import TaskContext

    packers = max(1, -(-pieces.count() // per_packer))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(batches):
        packer, base = LevelPacker(window), TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [packer.place(s) for s in batch.column("length").to_pylist()]
            more = [pa.array([base + g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], names=[*names, "sequence_id", "offset"])

    dealt = pieces.withColumn("_order", F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()))
    return dealt.repartition(packers, "_order").sortWithinPartitions("_order").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(staged(document_pieces(docs, path, window, end_id), "pieces"), window)

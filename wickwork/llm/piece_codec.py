"""SentencePiece encoding and decoding by a merge-type prefix table.

Every prefix of a text has one last token under byte-pair merging. The table holds it for each prefix: of the
vocabulary pieces that end there (automaton matches), it is the one compatible with the last token of the prefix
before it. Ids are then read backwards from the table. Two tokens are compatible if merging their joined text gives
those two again. No piece holds a word mark after another character, and line breaks are no pieces, so the table is
built per word; a bounded cache keeps the words seen.

Defined results: a null text counts as empty and has no ids; characters outside the vocabulary become byte pieces;
repeated rows and ties need no special case; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from wickwork.llm.common import sliced, worker_state

MARK = "▁"
WORD = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
CACHE_WORDS = 500_000
CACHE_CHARS = 64


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a merge-type SentencePiece model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id_of = {self.pieces[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("pieces may not hold a word mark after other characters, nor line breaks")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self._merged(p) == [p]:  # a piece that merging never yields is no match
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def _merged(self, text: str) -> list[str]:
        """Best-scored neighbouring pair first, leftmost on ties, until no pair is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            x, y = self.pieces[a], self.pieces[b]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merged(x + y) == [x, y]
        return found

    def _known(self, text: str) -> list[int]:
        """Ids of a text whose every character is a piece."""
        last, compatible = [-1] * (len(text) + 1), self.pairs.get
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - size
                if start == 0:
                    last[end] = token
                elif last[start] >= 0:
                    ok = compatible((last[start], token))
                    if ok or ok is None and self._compatible(last[start], token):
                        last[end] = token
        ids, at = [], len(text)
        while at:
            if last[at] < 0:
                raise ValueError(f"no piece ends at {at} of {text[:80]!r}")
            ids.append(last[at])
            at -= len(self.pieces[last[at]])
        return ids[::-1]

    def _word(self, word: str) -> list[int]:
        if self.chars.issuperset(word):
            return self._known(word)
        ids, run = [], ""
        for c in word:
            if c in self.chars:
                run += c
                continue
            ids += self._known(run) if run else []
            ids += [self.byte_id[b] for b in c.encode("utf-8", "replace")]
            run = ""
        return ids + (self._known(run) if run else [])

    def words(self, text: str) -> list[str]:
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self._word(w)]

    def _joined(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, without the space that encoding puts before a text."""
        return self._joined(ids).removeprefix(" ")

    def _seen(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal, decoded text) of a word, kept in two generations of bounded size."""
        found = self.old.get(word)
        if found is None:
            ids = self._word(word)
            found = (len(ids), ",".join(map(str, ids)), self._joined(ids))
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.old, self.cache = self.cache, {}
            self.cache[word] = found
        return found

    def coded(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal joined by commas, decoded text)."""
        if not text:
            return 0, "", ""
        get, seen = self.cache.get, self._seen
        n, ids, out = zip(*[get(w) or seen(w) for w in self.words(text)], strict=True)
        return sum(n), ",".join(ids), "".join(out).removeprefix(" ")


def codec(model_file: str) -> PieceCodec:
    """One codec a worker process and file."""
    return worker_state(f"pieces {model_file}", lambda: PieceCodec(model_file))


def encode_documents(docs: DataFrame, model_file: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded; with ``digests``, the SHA-256 of ids and text in their place."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches):
        c = codec(model_file)
        for batch in sliced(batches):
            rows = [c.coded(t or "") for t in batch.column("text").to_pylist()]
            n = pa.array([r[0] for r in rows], pa.int64())
            if digests:
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                rest = [pa.array([sha(r[k]) for r in rows], pa.string()) for k in (1, 2)]
            else:
                rest = [pa.array([[int(i) for i in r[1].split(",") if i] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *rest], names=["doc_id", "n_tokens", *(x.split()[0] for x in tail.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, {tail}")

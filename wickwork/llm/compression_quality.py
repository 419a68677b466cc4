"""Quality classifier: zstandard dictionaries of good and bad labelled text.

Every text is compressed in short chunks with either dictionary. The difference of the two sizes over their sum goes
through a logistic curve (of the difference and its square) fitted on labelled texts that the dictionaries were not built
from. Labelled rows are drawn by a hash of the id, about ``per_class`` a class, so the driver holds a bounded number of
whole texts at any input size; every row is scored over its whole text.

Defined results: a null or empty text is one empty chunk; a null doc_id is not held out and not learned from; with
one class or none labelled the score is the smoothed share of good labels; repeated labels count as often as they
occur; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import hash_share, id_crc, map_texts, share_for


@dataclass(frozen=True)
class CompressionOptions:
    chunk: int = 128
    dictionary: int = 112_640
    level: int = 3
    #: Labelled documents a class: half go into its dictionary, half into the curve.
    per_class: int = 1500
    threshold: float = 0.3


def chunks(text: str, size: int) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


class CompressionModel:
    """Two dictionaries and a calibrated curve; plain data, so it is sent to tasks as it is."""

    def __init__(self, good: bytes, bad: bytes, options: CompressionOptions):
        self.good, self.bad, self.o = good, bad, options
        self.mean, self.scale, self.weights = [0.0] * 2, [1.0] * 2, [0.0] * 3

    def compressors(self):
        import zstandard

        params = zstandard.ZstdCompressionParameters.from_level(self.o.level, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for data in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=self.o.level)
            out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))
        return out

    def features(self, text: str, pair) -> list[float]:
        good = bad = 0
        for c in chunks(text, self.o.chunk):
            good, bad = good + len(pair[0].compress(c)), bad + len(pair[1].compress(c))
        d = (bad - good) / (bad + good)
        return [d, d * d]

    def fit(self, rows: list[list[float]], labels: list[int]) -> None:
        """Logistic regression on standardised features, by Newton steps with a small ridge."""
        import numpy as np

        x, y = np.array(rows), np.array(labels, float)
        mean, scale = x.mean(0), x.std(0) + 1e-9
        a = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
        w = np.zeros(a.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a.T * (p * (1 - p))) @ a + 0.1 * np.eye(len(w))
            w += np.clip(np.linalg.solve(h, a.T @ (y - p) - 0.1 * w), -3, 3)
        self.mean, self.scale, self.weights = mean.tolist(), scale.tolist(), w.tolist()

    def score(self, text: str, pair) -> float:
        z = self.weights[-1]
        for v, m, s, w in zip(self.features(text, pair), self.mean, self.scale, self.weights, strict=False):
            z += w * max(-8.0, min(8.0, (v - m) / s))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, options: CompressionOptions) -> CompressionModel | float:
    """A model, or the smoothed share of good labels where a class is missing."""
    import zstandard

    o = options
    usable = labels.filter((F.pmod(id_crc(), F.lit(5)) != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    totals = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    share = {q: share_for(o.per_class, totals.get(q, 0)) for q in (0, 1)}
    if len(totals) < 2:
        return (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    limit = F.when(F.col("quality") == 0, F.lit(share[0])).otherwise(F.lit(share[1]))
    drawn = usable.filter(hash_share(F.col("doc_id")) < limit).limit(8 * o.per_class)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text").limit(16 * o.per_class).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows[::2]:
        parts[r["quality"]] += chunks(r["text"], o.chunk)

    def dictionary(samples: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(o.dictionary, samples, level=o.level).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            return b"".join(samples)[-o.dictionary :]

    model = CompressionModel(dictionary(parts[1]), dictionary(parts[0]), o)
    pair = model.compressors()
    fit_on = rows[1::2] if len({r["quality"] for r in rows[1::2]}) == 2 else rows
    if len({r["quality"] for r in fit_on}) < 2:
        return (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    model.fit([model.features(r["text"], pair) for r in fit_on], [r["quality"] for r in fit_on])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, options: CompressionOptions | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    o = options or CompressionOptions()
    model = train(docs, labels, o)

    def make():
        if isinstance(model, float):
            return lambda texts: [pa.array([model] * len(texts), pa.float64())]
        pair = model.compressors()
        return lambda texts: [pa.array([model.score(t, pair) for t in texts], pa.float64())]

    scored = map_texts(docs, make, "score double")
    held = F.coalesce(F.pmod(id_crc(), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= o.threshold).cast("int").alias("predicted"))

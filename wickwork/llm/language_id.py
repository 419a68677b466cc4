"""Language ID: a byte convolutional network trained and applied in numpy.

A text is lower-cased and cut into fixed windows of UTF-8 bytes. Filters of several widths run over each window, the
largest response of each filter is kept, and a softmax layer gives a share per language; a text's shares are the mean
over all of its windows. Training rows are drawn by a hash of the id, about ``per_lang`` a language; each epoch learns from
windows drawn anew from anywhere in their whole texts.

Defined results: ``und`` with score 0 for null texts and texts without a letter; a null doc_id is not held out and not
learned from; every other lang value is learned; with no labelled row every text is
``und``; repeated rows give repeated results; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import hash_share, id_crc, map_texts, share_for, worker_state


@dataclass(frozen=True)
class ByteCnnOptions:
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    window: int = 256
    per_lang: int = 600
    #: Windows drawn from each training text in an epoch.
    draws: int = 4
    epochs: int = 10
    batch: int = 64
    rate: float = 0.02
    seed: int = 7


class ByteCnn:
    """Filter tables, one row of responses a byte value and place, and the output layer."""

    def __init__(self, langs: list[str], options: ByteCnnOptions):
        import numpy as np

        rng, self.o, self.langs, o = np.random.default_rng(options.seed), options, langs, options
        self.tables = [rng.normal(0, 0.3, (w, 256, o.filters)).astype("f4") for w in o.widths]
        for t in self.tables:
            t[:, 0] = 0  # padding says nothing
        self.bias = np.zeros(len(o.widths) * o.filters, "f4")
        self.out = rng.normal(0, 0.3, (len(self.bias), len(langs))).astype("f4")
        self.base = np.zeros(len(langs), "f4")

    def windows(self, text: str):
        """Bytes as (windows, window), padded with zeros at the end."""
        import numpy as np

        data = np.frombuffer(text.lower().encode("utf-8", "replace"), "u1")
        n = max(1, -(-len(data) // self.o.window))
        out = np.zeros(n * self.o.window, "u1")
        out[: len(data)] = data
        return out.reshape(n, self.o.window)

    def responses(self, x):
        """Largest response of each filter and its place: two arrays (windows, filters)."""
        import numpy as np

        tops, places = [], []
        for t in self.tables:
            w = len(t)
            r = t[0][x[:, : x.shape[1] - w + 1]]
            for j in range(1, w):
                r += t[j][x[:, j : x.shape[1] - w + 1 + j]]
            at = r.argmax(1)
            tops.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            places.append(at)
        return np.maximum(np.concatenate(tops, 1) + self.bias, 0), np.concatenate(places, 1)

    def pooled(self):
        """A faster form of the largest responses, for scoring: tables over byte pairs."""
        import numpy as np

        f, widths = self.o.filters, self.o.widths
        reach = max(widths)
        firsts = [np.zeros((256, 256, f * sum(w > 2 * p for w in widths)), "f4") for p in range(-(-reach // 2))]
        order = sorted(range(len(widths)), key=lambda k: -widths[k])
        for p, table in enumerate(firsts):
            for c, k in enumerate(k for k in order if widths[k] > 2 * p):
                t = self.tables[k]
                part = table[:, :, c * f : (c + 1) * f]
                part += t[2 * p][:, None]
                if widths[k] > 2 * p + 1:
                    part += t[2 * p + 1][None]
        firsts = [t.reshape(65536, -1) for t in firsts]
        columns = np.concatenate([np.arange(k * f, (k + 1) * f) for k in order])
        bias, out = self.bias[columns], self.out[columns]

        def shares(x):
            got = []
            for s in range(0, len(x), 64):
                part = np.pad(x[s : s + 64], ((0, 0), (0, reach)))
                pairs = part[:, :-1].astype("u2") * 256 + part[:, 1:]
                n = x.shape[1] - reach + 1
                r = firsts[0].take(pairs[:, :n], 0)
                for p in range(1, len(firsts)):
                    more = firsts[p].take(pairs[:, 2 * p : 2 * p + n], 0)
                    r[:, :, : more.shape[2]] += more
                z = np.maximum(r.max(1) + bias, 0) @ out + self.base
                e = np.exp(z - z.max(1, keepdims=True))
                got.append(e / e.sum(1, keepdims=True))
            return np.concatenate(got)

        return shares

    def fit(self, texts: list, labels: list[int]) -> None:
        """Adam on the cross entropy of windows drawn from ``texts`` (arrays of windows).

        A filter learns at the place of its largest response alone.
        """
        import numpy as np

        o, rng = self.o, np.random.default_rng(self.o.seed)
        params = [*self.tables, self.bias, self.out, self.base]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, x, count = 0, np.concatenate(texts), np.array([len(t) for t in texts])
        first_of, y = np.cumsum(count) - count, np.repeat(np.array(labels), o.draws)
        for _ in range(o.epochs):
            drawn = (first_of[:, None] + rng.integers(0, count[:, None], (len(count), o.draws))).ravel()
            order = rng.permutation(len(drawn))
            for s in range(0, len(drawn), o.batch):
                xb, yb = x[drawn[order[s : s + o.batch]]], y[order[s : s + o.batch]]
                h, at = self.responses(xb)
                z = h @ self.out + self.base
                e = np.exp(z - z.max(1, keepdims=True))
                g = e / e.sum(1, keepdims=True)
                g[np.arange(len(yb)), yb] -= 1
                g /= len(yb)
                gh = (g @ self.out.T) * (h > 0)
                grads = []
                for k, t in enumerate(self.tables):
                    cols = slice(k * o.filters, (k + 1) * o.filters)
                    gt, places, part = np.zeros_like(t), at[:, cols], gh[:, cols]
                    for j in range(len(t)):
                        np.add.at(gt[j], (np.take_along_axis(xb, places + j, 1), np.arange(o.filters)[None]), part)
                    gt[:, 0] = 0
                    grads.append(gt)
                grads += [gh.sum(0), h.T @ g, g.sum(0)]
                step += 1
                for p, gr, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (gr - m)
                    v += 0.01 * (gr * gr - v)
                    p -= o.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def train(docs: DataFrame, options: ByteCnnOptions | None = None) -> ByteCnn | None:
    """A network, or None where no row can be learned from."""
    o = options or ByteCnnOptions()
    usable = docs.filter(F.col("lang").isNotNull() & (F.pmod(id_crc(), F.lit(4)) != 2)).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not counts:
        return None
    limit = F.lit(0.0)
    for r in counts:
        limit = F.when(F.col("lang") == r["lang"], F.lit(share_for(o.per_lang, r["n"]))).otherwise(limit)
    drawn = usable.filter(hash_share(F.col("doc_id")) < limit).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    rows = drawn.limit(3 * o.per_lang * len(counts)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    net = ByteCnn(sorted(r["lang"] for r in counts), o)
    parts = [(net.windows(r["text"]), net.langs.index(r["lang"])) for r in rows if any(c.isalpha() for c in r["text"])]
    if not parts:
        return None
    net.fit([p[0] for p in parts], [p[1] for p in parts])
    return net


def identify(docs: DataFrame, net: ByteCnn | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, lang_pred and score of every row of ``docs``."""
    key = uuid.uuid4().hex

    def make():
        import numpy as np

        shares = worker_state(key, net.pooled) if net else None

        def work(texts):
            found, score = ["und"] * len(texts), [0.0] * len(texts)
            rows = [k for k, t in enumerate(texts) if net and any(map(str.isalpha, t))]
            at = 0
            while at < len(rows):
                upto, parts = at, []
                while upto < len(rows) and (not parts or sum(map(len, parts)) < 512):
                    parts.append(net.windows(texts[rows[upto]]))
                    upto += 1
                got = shares(np.concatenate(parts))
                starts = np.cumsum([0, *map(len, parts)])
                for k in range(upto - at):
                    mean = got[starts[k] : starts[k + 1]].mean(0)
                    best = int(mean.argmax())
                    found[rows[at + k]], score[rows[at + k]] = net.langs[best], float(min(1.0, mean[best]))
                at = upto
            return pa.array(found, pa.string()), pa.array(score, pa.float64())

        return work

    return map_texts(docs, make, "lang_pred string, score double", carry)


def predict_language(docs: DataFrame, options: ByteCnnOptions | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    held = F.coalesce(F.pmod(id_crc(), F.lit(4)) == 2, F.lit(False))
    return identify(docs, train(docs, options)).select("doc_id", held.alias("held_out"), "lang_pred", "score")

"""Secret scans: exact key patterns plus sliding-window Shannon entropy per character class.

Candidates are runs of key characters. A window moves over each; counts of characters are kept as it moves, and with
them the sum of c log c, so a step costs two table look-ups. Windows above the threshold of the candidate's class
(hexadecimal, alphanumeric, base64) are joined to spans. Candidates that fit the allow-list, and windows that lack
digits (with ``+`` and ``/`` in base64) or letters, are left alone.

Defined results: a null text counts as empty and has no spans; whole texts are scanned at any length; repeated rows
give repeated results; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from wickwork.llm.common import map_texts, worker_state
from wickwork.llm.spans import Span, joined, replaced, secrets, sha256

KINDS = ("assign", "access", "hex", "entropy")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}+")
_HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
_ALNUM = re.compile(r"[0-9A-Za-z]+")
_BASE64 = re.compile(r"[0-9A-Za-z+/]+={0,2}")
#: Words in one case, capitalised or in camel case, with numbers between and a short one at the end; or a number.
_WORD = r"(?:[A-Z]+|[A-Z]?[a-z]+|[a-z]*(?:[A-Z][a-z]{2,})+)"
_PART = rf"(?=[^/]{{1,19}}(?:/|\Z))(?:[0-9._-]+|{_WORD}(?:[._-]+(?:{_WORD}|[0-9]+))*[._-]*[0-9]{{0,4}})"


@dataclass(frozen=True)
class EntropyOptions:
    window: int = 20
    #: Bits a character, of at most log2(window) = 4.32.
    thresholds: dict[str, float] = field(default_factory=lambda: {"hex": 3.1, "alnum": 3.7, "base64": 3.8})
    min_digits: int = 2
    min_letters: int = 4
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
        r"[0-9.+/_=-]+",  # numbers, dates and rules
        r"[A-Za-z]+([._/=+-]+[A-Za-z]+)*[._/=+-]*[0-9]{0,4}",  # words, with a short number at the end
        r"(.)\1*",  # one character
        rf"/?({_PART}/)+({_PART})?",  # paths of short parts that are words or numbers
        r"([A-Za-z0-9_-]{1,19}\.)+[A-Za-z]{2,10}(/[A-Za-z0-9_./=-]{0,19})?",  # host names
    )


class EntropyScanner:
    def __init__(self, options: EntropyOptions):
        self.o = options
        self.allow = re.compile("|".join(f"(?:{p})" for p in options.allow).replace(r"\1", r"(?P=one)").replace("(.)", "(?P<one>.)"))
        self.clog = [c * math.log2(c) if c else 0.0 for c in range(options.window + 1)]

    def kind(self, text: str) -> str:
        return "hex" if _HEXADECIMAL.fullmatch(text) else "alnum" if _ALNUM.fullmatch(text) else "base64"

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Joined windows of ``text`` above the threshold of its class."""
        o, w, clog = self.o, self.o.window, self.clog
        most = (math.log2(w) - o.thresholds[self.kind(text)]) * w  # entropy = log2(w) - sum(c log2 c) / w
        # In base64 two of its 64 characters are neither digits nor letters: they count as digits.
        digit = frozenset("0123456789+/") if _BASE64.fullmatch(text) else None
        counts: dict[str, int] = {}
        held, digits, letters, out = 0.0, 0, 0, []
        for k, c in enumerate(text):
            n = counts.get(c, 0)
            counts[c] = n + 1
            held += clog[n + 1] - clog[n]
            digits += c in digit if digit else c.isdigit()
            letters += c.isalpha()
            if k >= w:
                gone = text[k - w]
                n = counts[gone]
                counts[gone] = n - 1
                held += clog[n - 1] - clog[n]
                digits -= gone in digit if digit else gone.isdigit()
                letters -= gone.isalpha()
            if k >= w - 1 and held <= most + 1e-9 and digits >= o.min_digits and letters >= o.min_letters:
                if out and out[-1][1] > k - w:
                    out[-1] = (out[-1][0], k + 1)
                else:
                    out.append((k - w + 1, k + 1))
        return out

    def spans(self, text: str) -> list[Span]:
        out = []
        for m in _CANDIDATE.finditer(text):
            word = m[0].rstrip(".=-")
            if len(word) >= self.o.window and any(c.isdigit() for c in word) and not self.allow.fullmatch(word):
                out += [("entropy", m.start() + a, m.start() + b) for a, b in self.windows(word)]
        return out


def find_secrets(docs: DataFrame, options: EntropyOptions | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans of every row."""
    o = options or EntropyOptions()

    def make():
        scanner = worker_state(f"entropy {o}", lambda: EntropyScanner(o))

        def work(texts):
            base = [secrets(t) for t in texts]
            every = [b + scanner.spans(t) for b, t in zip(base, texts, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in e) for e in every], pa.int64()) for k in KINDS]
            return [*counts, pa.array([sha256(joined(b, KINDS)) for b in base], pa.string()), pa.array([joined(e, KINDS) for e in every], pa.string())]

        return work

    return map_texts(docs, make, "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, options: EntropyOptions | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, n_secrets, and the text with every span replaced by its kind in brackets."""
    o = options or EntropyOptions()

    def make():
        scanner = worker_state(f"entropy {o}", lambda: EntropyScanner(o))

        def work(texts):
            every = [secrets(t) + scanner.spans(t) for t in texts]
            out = [replaced(t, [(a, b, f"[{k}]") for k, a, b in e]) if e else t for t, e in zip(texts, every, strict=True)]
            return pa.array([len(e) for e in every], pa.int64()), pa.array(out, pa.string())

        return work

    return map_texts(docs, make, "n_secrets long, redacted string", carry)

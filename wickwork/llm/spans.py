"""Exact span finders shared by the privacy and secret scans. Offsets are code points, ends exclusive."""

from __future__ import annotations

import hashlib
import re

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")


def emails(text: str) -> list[tuple[int, int]]:
    """Around each ``@``: a start inside a run of local characters fails where the start of the run fails."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text: str) -> list[Span]:
    """email, ip, card and phone spans, leftmost and non-overlapping per kind; failing matches are dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def secrets(text: str) -> list[Span]:
    """assign, access and hex spans, leftmost and non-overlapping per kind; failing matches are dropped."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the order of ``kinds``, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced; spans that overlap become one, with the mark of the first."""
    out, at = [], 0
    for a, b, mark in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])

"""Leftmost non-overlapping matches of the fixed patterns for personal data and secrets, and the shape of their digests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: kind and code points, end exclusive.
Span = tuple[int, int, str]

# Possessive forms of the fixed patterns: a run of digits is entered only at its start, so long runs stay linear.
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NAME_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

PERSONAL = ("email", "ip", "card", "phone")
SECRET = ("assign", "access", "hex")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if place % 2:
            x += x if x < 5 else x - 9
        total += x
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME_CHARACTERS:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    return out


def personal(text: str) -> list[Span]:
    """Base spans of personal data."""
    out = emails(text) if "@" in text else []
    if text.count(".") >= 3:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def secrets(text: str) -> list[Span]:
    """Base spans of secrets."""
    out = []
    if _ASSIGN_WORDS.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def listed(found: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the order of kinds (others after them, by name), comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda s: (s[0], rank.get(s[2], len(rank)), s[2], s[1])))


def count_of(column: str, kind: str) -> Column:
    """How many spans of a kind a listed column has."""
    return F.size(F.filter(F.split(column, ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")


def digest_of(column: str) -> Column:
    return F.sha2(F.encode(column, "UTF-8"), 256).alias("base_sha256")

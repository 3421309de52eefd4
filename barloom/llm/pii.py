"""Personal data: fixed patterns, and a semi-Markov conditional random field that scores whole spans.

The field segments the tokens around digits and at-signs into entities of at most MAX_TOKENS tokens (and LONGEST characters, on
one line) and single other tokens. What holds neither a digit nor an at-sign, written as such or in brackets, is no entity. A segment's score is a weighted sum of features of the whole span (shape, digits, separators, check digit, the words
before it) for its type; dynamic programming over segment ends finds the best segmentation, and its log-sum form gives the
likelihood gradient that the weights are trained with, on generated sentences with known segments.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import spans as S
from barloom.llm.common import small

#: Bounds of an entity: "+33 6 12 34 56 78" and "ann dot lee (at) mail dot org" have up to seven tokens; an address has at most 320
#: characters (64 before the at-sign, 255 after it).
MAX_TOKENS, LONGEST = 7, 320
#: Characters on each side of a trigger that are segmented with it, up to the next white space.
CONTEXT = 60
#: A span counts only if it beats reading its tokens as ordinary words by this log-odds.
MARGIN = 1.0

_TOKEN = re.compile(r"[^\s,;:!?\"<>|]+")
_TRIGGER = re.compile(r"[0-9@]|(?<=[(\[{])at[)\]}]")
_SPACE = re.compile(r"\s")
_DIALLED = re.compile(r"[+(]*[0-9][0-9 ()/.-]*[0-9]")

#: Fixed words that point at a kind.
CUES = {
    "email": frozenset("email e-mail mail contact write mailto".split()),
    "ip": frozenset("ip host address server addr ping".split()),
    "card": frozenset("card visa mastercard credit payment cc".split()),
    "phone": frozenset("phone call tel telephone mobile fax cell dial".split()),
}
_OBFUSCATED = re.compile(r"[\w.%+-]+(?: dot [\w%+-]+)*\s*[(\[{]at[)\]}]\s*[\w-]+(?:\s*(?:\.|[(\[{]dot[)\]}]|\bdot\b)\s*[\w-]+)+", re.ASCII)
_QUAD = re.compile(r"([0-9]{1,3})(?:\.|\[\.\]|\(\.\))([0-9]{1,3})(?:\.|\[\.\]|\(\.\))([0-9]{1,3})(?:\.|\[\.\]|\(\.\))([0-9]{1,3})")


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int, cues: list[str]) -> list[str]:
    """Of the span of tokens i..j-1, and of the words before it."""
    start, end = tokens[i][0], tokens[j - 1][1]
    body = text[start:end]
    digits = [c for c in body if "0" <= c <= "9"]
    n, letters = len(digits), sum(c.isalpha() for c in body)
    shape = re.sub(r"d+", "d", re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "d", body)))[:12]
    dense = n >= 0.6 * len(body)
    before = {text[a:b].lower().strip(".()") for a, b in tokens[max(0, i - 2) : i]}
    pointed = [k for k in cues if before & CUES[k]]
    out = [
        f"digits={n if n < 20 else 20}",
        f"shape={shape}" if len(shape) <= 6 else "shape=long",
        f"letters={min(letters, 3)}",
        f"tokens={j - i}",
        f"dense={dense}",
        *[f"cue={k}" for k in pointed],
    ]
    if body[0] == "(" and n >= 10:
        out.append("opens")
    if body[0] == "+":
        out.append(f"plus={10 <= n <= 15}")
    if not letters and 9 <= n <= 15 and _DIALLED.fullmatch(body):
        groups = re.findall(r"[0-9]+", body)
        lengths = ",".join(str(len(g)) for g in groups)
        home = body.lstrip("(")[0] == "0"
        out += [f"dialled={home}", f"groups={lengths}", f"home={home},{min(n, 12)},{len(groups) > 1}", f"asked={'phone' in pointed},{home}"]
        if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", body):
            out.append("grouped")
    if (quad := _QUAD.fullmatch(body)) and all(int(p) < 256 for p in quad.groups()):
        out.append("quad")
    if not letters and 14 <= n <= 19:
        out.append(f"luhn={S.luhn(''.join(digits))}")
    if _OBFUSCATED.fullmatch(body) or (body.count("@") == 1 and "." in body.partition("@")[2] and body[0] != "@"):
        out.append("mailbox")
    if any(not ("0" <= text[a] <= "9" or text[a] in "+(") for a, _ in (tokens[i], tokens[j - 1])):
        out.append("worded")  # a word at an end
    if j < len(tokens) and not letters and text[tokens[j][0]].isdigit() and text[end : tokens[j][0]] in " -":
        out.append("goes on")
    if i and not letters and text[tokens[i - 1][1] - 1].isdigit() and text[tokens[i - 1][1] : start] in " -":
        out.append("came on")
    return out


class SemiMarkov:
    """Weights of (type, feature); the type None is an ordinary token, whose score is 0."""

    kinds = S.PERSONAL

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}

    def segments(self, text: str, tokens: list[tuple[int, int]]):
        """Candidate entities by end: (length, features). A span without a trigger is no candidate."""
        cues = list(self.kinds)
        hot = [bool(_TRIGGER.search(text, a, b)) for a, b in tokens]
        out: list[list[tuple[int, list[str]]]] = []
        for j in range(1, len(tokens) + 1):
            ends = []
            for size in range(1, min(MAX_TOKENS, j) + 1):
                if any(hot[j - size : j]) and tokens[j - 1][1] - tokens[j - size][0] <= LONGEST and "\n" not in text[tokens[j - size][0] : tokens[j - 1][1]]:
                    ends.append((size, features(text, tokens, j - size, j, cues)))
            out.append(ends)
        return out

    def score(self, kind: str, found: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in found) + w.get((kind, ""), 0.0)

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[S.Span]:
        """The segmentation of highest score."""
        segments = self.segments(text, tokens)
        best, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            top, how = best[j - 1], (1, None)
            for size, found in segments[j - 1]:
                for kind in self.kinds:
                    if (s := best[j - size] + self.score(kind, found) - MARGIN) > top:
                        top, how = s, (size, kind)
            best.append(top)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            size, kind = back[j]
            if kind:
                out.append((tokens[j - size][0], tokens[j - 1][1], kind))
            j -= size
        return out[::-1]

    def step(self, text: str, tokens: list[tuple[int, int]], gold: set[tuple[int, int, str]], rate: float) -> float:
        """One gradient step on the log-likelihood of a segmentation; returns the log-likelihood."""
        n, segments = len(tokens), self.segments(text, tokens)
        scores = [[(size, found, [self.score(k, found) for k in self.kinds]) for size, found in ends] for ends in segments]

        def total(xs: list[float]) -> float:
            m = max(xs)
            return m + math.log(sum(math.exp(x - m) for x in xs))

        ahead, behind = [0.0], [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead.append(total([ahead[j - 1], *(ahead[j - size] + s for size, _, all_s in scores[j - 1] for s in all_s)]))
        for i in range(n - 1, -1, -1):
            xs = [behind[i + 1]]
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                xs += [s + behind[j] for size, _, all_s in scores[j - 1] if size == j - i for s in all_s]
            behind[i] = total(xs)
        truth, w = 0.0, self.weights
        for j in range(1, n + 1):
            for size, found, all_s in scores[j - 1]:
                for kind, s in zip(self.kinds, all_s, strict=True):
                    real = (j - size, j, kind) in gold
                    truth += s if real else 0.0
                    move = rate * (real - math.exp(ahead[j - size] + s + behind[j] - ahead[n]))
                    if abs(move) > 1e-6:
                        for f in ("", *found):
                            w[kind, f] = w.get((kind, f), 0.0) * (1 - 0.001 * rate) + move
        return truth - ahead[n]


def generated(n: int, seed: int) -> list[tuple[str, list[S.Span]]]:
    """Sentences of invented words with entities in the usual written forms, and with numbers that are none."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        body = rng.choice("3456") + number(rng.choice([13, 14, 15, 15, 15, 17]))
        body += next(d for d in "0123456789" if S.luhn(body + d))
        gap = rng.choice(["", " ", "-", "."])
        if gap and len(body) == 15 and rng.random() < 0.5:
            return gap.join((body[:4], body[4:10], body[10:]))
        return gap.join(body[k : k + 4] for k in range(0, len(body), 4)) if gap else body

    def phone() -> str:
        a, b, c, pair = number(3), number(3), number(4), lambda: number(2)
        return rng.choice([
            f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}",
            f"0{c} {a}{b}", f"0{pair()} {c} {number(4)}", f"0{a} {b} {c}", f"(0{a}) {b} {c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}",
            f"0{number(1)} {pair()} {pair()} {pair()} {pair()}", f"+{rng.randint(30, 59)} {number(1)} {pair()} {pair()} {pair()} {pair()}",
            f"00{rng.randint(30, 59)} {pair()} {c} {number(4)}", f"00{rng.randint(30, 59)} {a} {b}{c}", f"0{c}{a}{b}",
        ])

    def email() -> str:
        host = word() + rng.choice(["", str(rng.randint(1, 9))])
        return rng.choice([
            f"{word()}.{number(2)}@{host}.example.com", f"{word()}@{host}.org", f"{word()}_{word()}@{host}.co.net", f"{word()} (at) {host}.com", f"{word()}[at]{host}[dot]net",
            f"{word()}.{word()} {{at}} {host}.org", f"{word()} dot {word()} (at) {host} dot org", f"{word()} [at] {host} dot com", f"{word()}(at){host}(dot)de",
        ])

    makers = {"card": card, "phone": phone, "email": email, "ip": lambda: rng.choice([".", ".", "[.]", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))}
    digits = lambda *sizes: " ".join(number(k) for k in sizes)
    plain = [
        lambda: str(rng.randint(0, 9999)),
        lambda: f"{rng.randint(1, 999)}.{rng.randint(0, 99):02d}",
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(0, 23)}.{rng.randint(0, 59):02d}",
        lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 999)}",
        lambda: number(rng.choice([5, 6, 7, 8, 12, 16, 20, 22, 24])),
        lambda: f"{number(4)} {number(4)} {number(4)} {number(4)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 16, 32, 40]))),
        lambda: f"{word()}{rng.randint(0, 99)}",
        lambda: f"{number(3)} {number(3)} {number(2)}",
        lambda: f"@{word()}",
        lambda: f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        lambda: f"978{number(10)}",
        lambda: f"{rng.randint(1, 12):02d} {rng.randint(1, 28):02d} {rng.randint(1900, 2030)}",
        lambda: f"{rng.randint(1900, 2030)} {rng.randint(1, 12):02d} {rng.randint(1, 28):02d}",
        lambda: digits(2, 2, 2, 2),
        lambda: digits(1, 1, 2, 3, 1),
        lambda: digits(4, 4),
        lambda: digits(5, 5),
        lambda: digits(6, 6),
        lambda: f"0.{number(rng.randint(6, 12))}",
        lambda: f"{number(4)}-{number(4)}-{number(4)}",
        lambda: f"{rng.choice(['no', 'order', 'id', 'item', 'ref', 'version'])} {number(rng.randint(4, 12))}",
        lambda: f"{rng.choice(['no', 'order', 'id', 'item', 'ref'])} {rng.choice('123456789')}{number(rng.randint(8, 11))}",
        lambda: f"{rng.randint(1, 99)} (at) {word()}",
        lambda: f"{word()} (at) {word()} {word()}",
        lambda: f"{rng.randint(1, 999)},{number(3)},{number(3)}",
    ]
    out = []
    for _ in range(n):
        text, found = word(), []
        for _ in range(rng.randint(1, 3)):
            text += " " + " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.5:
                kind = rng.choice(list(makers))
                if rng.random() < 0.4:
                    text += rng.choice(sorted(CUES[kind])) + rng.choice([" ", ": "])
                body = makers[kind]()
                found.append((len(text), len(text) + len(body), kind))
            else:
                body = rng.choice(plain)()
            text += body
        out.append((text + " " + word() + ".", found))
    return out


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Bounds of tokens, without dots at their ends."""
    out = []
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        a, b = m.span()
        while b > a and text[b - 1] in ".'":
            b -= 1
        if b > a:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def trained(sentences: int = 900, rounds: int = 3) -> SemiMarkov:
    """The field, trained here on generated sentences (bounded by the parameters); the same on every call."""
    model = SemiMarkov()
    data = generated(sentences, seed=5)
    for k in range(rounds):
        for text, found in data:
            tokens = tokens_of(text)
            starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            gold = {(starts[a], ends[b], kind) for a, b, kind in found if a in starts and b in ends}
            model.step(text, tokens, gold, 0.3 / (1 + k))
    return model


def added(text: str, model: SemiMarkov, base: list[S.Span]) -> list[S.Span]:
    """Spans that the field finds beside the base spans, in the whole text: triggers whose contexts touch are segmented together,
    in whole tokens, and each stretch of text once."""
    hits = [m.start() for m in _TRIGGER.finditer(text)]
    out, k, done = [], 0, 0
    while k < len(hits):
        start = end = hits[k]
        while k < len(hits) and hits[k] - end <= 2 * CONTEXT:
            end = hits[k]
            k += 1
        a, b = max(done, start - CONTEXT), end + CONTEXT
        while a > done and not text[a - 1].isspace():
            a -= 1
        found = _SPACE.search(text, b)
        done = b = found.start() if found else len(text)
        while k < len(hits) and hits[k] < b:
            k += 1
        out += model.best(text, tokens_of(text, a, b))
    if not out:
        return out
    held = sorted((a, b) for a, b, _ in base)
    return [s for s in out if not any(x < s[1] and s[0] < y for x, y in held)]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base, spans, redacted, and the columns in keep): listed base spans, all spans, and the text with each span replaced by its kind.

    Null and empty texts have no spans (and a null or empty redacted text). Overlapping spans of several kinds are all
    listed, and redacted as one. Repeated rows and null ids give a row each; columns
    beside those in keep are not read. Narrow.
    """
    weights = trained().weights

    def run(batches):
        model = SemiMarkov()
        model.weights = weights
        for batch in small(batches):
            base, every, clean = [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                found = S.personal(text) if text else []
                more = added(text, model, found) if text else []
                base.append(S.listed(found, S.PERSONAL))
                every.append(S.listed(found + more, S.PERSONAL))
                clean.append(redact(text, found + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(clean, pa.string()), *batch.columns[2:]],
                names=["doc_id", "base", "spans", "redacted", *keep],
            )

    kept = docs.select(*keep)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    found = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("base", "spans", "redacted")])
    return rows.mapInArrow(run, T.StructType(found.fields + kept.schema.fields))


def redact(text: str | None, found: list[S.Span]) -> str | None:
    if not found:
        return text
    merged: list[list] = []
    for a, b, kind in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    out, at = [], 0
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def contract(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    return found.select("doc_id", *[S.count_of("base", k) for k in S.PERSONAL], S.digest_of("base"), "spans")

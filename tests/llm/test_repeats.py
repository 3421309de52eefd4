import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import repeats


def brute(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)  # noqa: B905
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))  # noqa: B905
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **how):
    got = repeats.mark_repeats(docs, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("length", [3, 8, 20])
def test_windows_of_short_strings(length):
    rng = random.Random(length)
    for _ in range(150):
        base = bytes(rng.choice(b"ab\0\xff"[: rng.randint(1, 4)]) for _ in range(60))
        parts = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, 30)
            s = base[a : a + rng.randint(length, length + 25)] if rng.random() < 0.7 else bytes(rng.choice(b"abc") for _ in range(length + rng.randint(0, 20)))
            parts.append(s + b"x" * (length - len(s)))
        seen, want = set(), set()
        for k, s in enumerate(parts):
            for i in range(len(s) - length + 1):
                if s[i : i + length] in seen:
                    want.add((k, i))
                seen.add(s[i : i + length])
        runs = repeats.repeated_windows(parts, np.array([len(s) - length + 1 for s in parts]), length)
        assert {(int(k), i) for k, a, b in runs for i in range(a, b)} == want


def test_both_suffix_orders_agree():
    text = np.random.default_rng(0).integers(0, 3, 3000).astype(np.uint16)
    of = lambda order: [text[i : i + 100].tobytes() for i in order]
    assert of(repeats.suffix_order(text, 100)) == of(repeats._suffix_order_large(text, 100))


def test_documents_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    long = "é🙂 lorem " * 30
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a" * 5000), (10**6 + 3, "a" * 99), (10**6 + 4, "a" * 100), (None, long), (None, long), (None, "null " * 40), (10**6 + 5, "x" + long), (10**6 + 6, long), (10**6 + 6, long), (10**6 + 7, ("ab" * 50 + "c") * 40)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, block int, cell string")
    assert run(docs) == brute(rows)


def test_slices_and_hot_groups(spark, monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "psi"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passage, copy = make(40), make(60)
    rows = [(i, make(10) + passage + make(10)) for i in range(120)] + [(i, copy) for i in range(200, 400)] + [(i, copy[: rng.randint(150, 300)] + make(5)) for i in range(400, 480)]
    monkeypatch.setattr(repeats, "SLICE", 997)
    monkeypatch.setattr(repeats, "TEXT", 3000)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_one_phrase_in_many_contexts(spark, monkeypatch):
    """An anchor with many distinct segments: no transformed text is longer than the bound, and nothing is lost."""
    rng = random.Random(3)
    phrase, passage = "the seventy bytes of one phrase that all of the documents here share, x", "a passage of more than a hundred bytes, which stands in half of them; " * 2
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, make(60) + phrase + make(rng.choice([3, 60])) + (passage if i % 2 else "") + make(20)) for i in range(300)]
    rows += [(1000, rows[7][1]), (None, rows[9][1]), (1001, phrase + make(5) + phrase + make(40) + phrase)]
    bound, whole = 4000, repeats.repeated_windows

    def guarded(segments, counts, length):
        assert sum(len(s) + 1 for s in segments) <= bound
        return whole(segments, counts, length)

    monkeypatch.setattr(repeats, "TEXT", bound)
    monkeypatch.setattr(repeats, "repeated_windows", guarded)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)

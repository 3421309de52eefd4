"""Ranked search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import pytest

from barloom.llm import ranking

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    sets = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    some = [s for s in sets if s[2]]
    n_docs, total = len(some), sum(s[2] for s in some)
    df = Counter(t for _, c, _ in some for t in c)
    out = []
    for item, text in set(items):
        asked, found = Counter(terms(text)), []
        for d, c, n in some:
            m = 75 + (25 * n * n_docs) // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, d is not None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, parts=3, **how):
    a = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, terms string").repartition(parts)
    b = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in ranking.ranked(a, b, **how).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_scores_of_random_texts(spark, seed):
    rng = random.Random(seed)
    words = [*"abcdefghij", "Zé", "q-r", "日", "0x", "é"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "_", ". ", "\n", "\x7f"]) for _ in range(n))
    docs = [(rng.choice([k, k, None, 5]), rng.choice([make(rng.randint(0, 40)), None, "", "..."])) for k in range(60)]
    docs += docs[:7]
    items = [(k % 9, make(rng.randint(0, 6))) for k in range(12)] + [(3, None), (None, "a b b")]
    items += items[:2]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, top=2) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, None)], [(1, "")]) == run(spark, [(1, "a b")], [(1, "c")]) == []


def test_many_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ITEM_TERMS", 8)
    monkeypatch.setattr(ranking, "SENT", 1500)
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(9))) for k in range(50)]
    items = [(k, " ".join(rng.choice("abcdefghxyz") for _ in range(5))) for k in range(40)]
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_few_texts_and_ties_over_blocks(spark, monkeypatch):
    docs = [(k, "same words here") for k in range(100)] + [(200, "other words"), (201, "word " * 50)]
    got = run(spark, docs, [(1, "words here")], parts=20)
    assert got == brute(docs, [(1, "words here")]) and [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(20))


def test_a_long_text(spark):
    docs = [(1, "tree " * 300_000 + "leaf"), (2, "leaf"), (3, "bark")]
    assert run(spark, docs, [(1, "leaf tree")]) == brute(docs, [(1, "leaf tree")])

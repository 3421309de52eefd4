"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from barloom.llm import phrases


def brute(rows, least=3, max_words=4, top=5, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        candidates = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= share * a for b in inside):
                continue
            score, _, left, right = min((2000000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(k, t, lang, k) for k, (lang, t) in enumerate(rows)], "n long, text string, lang string, phrase long")
    return sorted(tuple(r) for r in phrases.collocations(docs, **({"least": 3, "top": 5} | how)).collect())


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_random_texts(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "ça", "x-y", "Ü", "d1", "日本"]
    rows = []
    for _ in range(40):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ","]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, ""]), rng.choice([text, text, text, None])))
    rows += rows[:10]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, max_words=3, least=2, top=50) == brute(rows, 2, 3, 50)


def test_empty_tables_and_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", None), ("en", ""), (None, " .\n"), ("en", "one two")]) == []


def test_overlapping_repeats_and_covered_phrases(spark):
    rows = [("en", "go go go go"), ("en", "New York City. New York City, NEW YORK city")]
    got = run(spark, rows, top=9)
    assert got == brute(rows, top=9)
    assert [r[2] for r in got] == ["new york city", "go go"]  # york is never without new and city


def test_parts_of_long_texts_hold_each_phrase_once(spark, monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["p", "q", "rr", "s."]) for _ in range(3000)) + "z" * 700 + " p q"
    for n in (1, 2, 3, 4):
        cut = phrases.parts(text.encode(), n, 100)
        assert len(cut) > 20
        counted = Counter()
        for part in cut:
            counted.update(phrases.grams([part], phrases.salts_of(["en"])[[0]], n, None)[1].to_pylist())
        assert counted == Counter(phrases.grams([text.encode()], phrases.salts_of(["en"])[[0]], n, None)[1].to_pylist())


def test_a_full_table_of_bits_changes_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(50))) for _ in range(30)]
    want = brute(rows)
    monkeypatch.setattr(phrases, "bits_set", lambda known, h: h == h)
    assert run(spark, rows) == want


def test_bits_find_every_frequent_phrase(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["lo", "rem", "ip", "sum", "é"]) for _ in range(3)), rng.choice(["en", "und"])) for _ in range(50)]
    table = phrases.bit_table(spark.createDataFrame(rows, "phrase string, lang string").repartition(5), 3)
    for p, lang in rows:
        _, phrase, h = phrases.grams([p.encode()], phrases.salts_of([lang])[[0]], 3, None)
        assert phrase.to_pylist() == [p.encode()] and phrases.bits_set(table, h).all()
    assert int(table.astype(bool).sum()) <= len(set(rows))

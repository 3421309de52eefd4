import math
import re

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


ODD = [None, "", " ", "a", "a b c d e a b c d e", "x " * 4000, "é b c d 🙂 # ## <>", "l\nl\n\nl \n", "a a a a a a", "\x0b\x0c\r\t one\x1ctwo"]


def test_counts_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(quality.statistics(docs), []).collect()}
    assert got == {d: brute(t) for d, t in rows}


def test_list_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = (F.col("doc_id") % 2) == 1
    rules = quality.learn(quality.labelled(docs.where(~odd), labels))
    assert rules
    held = quality.judge(quality.labelled(docs.where(odd), labels), rules).collect()
    clean, bad = [r for r in held if not r.bad], [r for r in held if r.bad]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert sum(not r.kept for r in bad) >= 0.7 * len(bad)


def values_of(text):
    """The features that rules are about, from the text alone."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n_words, chars, symbols, dup, repeat, _ = brute(text)
    n = max(n_words, 1)
    return {
        "n_words": float(n_words), "mean_word": chars / n, "symbols_per_word": symbols / n, "marks_per_word": sum(c in "!?" for c in text) / n, "repeat_share": repeat / n,
        "distinct_share": len(set(words)) / n, "dup_line_share": dup / max(len(lines), 1), "words_per_line": n_words / max(len(lines), 1),
    }


def covering(rows, max_rules=8, max_conditions=3, precision=0.98, support=5):
    """Sequential covering over single rows (held, bad, values): rules as lists of (feature, above, threshold)."""
    shares = sorted({k / quality.BINS for k in range(1, quality.BINS)} | {0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998})
    cuts = {f: sorted(set(np.percentile([v[f] for _, _, v in rows], [100 * s for s in shares]).tolist())) for f in quality.FEATURES}
    holds = lambda v, rule: all((v[f] > t) == above for f, above, t in rule)

    def count(some, held):
        return sum(b for h, b, _ in some if h == held), sum(1 - b for h, b, _ in some if h == held)

    rules, left = [], rows
    while len(rules) < max_rules:
        rule, some = [], left
        p, n = count(left, 0)
        if p < support:
            break
        while n and len(rule) < max_conditions:
            start, top, choice = (math.log2(p / (p + n)) if p else -30.0), 1e-9, None
            for f in quality.FEATURES:
                for t in cuts[f]:
                    for above in (False, True):
                        a, c = count([r for r in some if (r[2][f] > t) == above], 0)
                        if a >= support and (gain := a * (math.log2(a / (a + c)) - start)) > top + 1e-12:
                            top, choice = gain, (f, above, t)
            if choice is None:
                break
            rule.append(choice)
            some = [r for r in some if holds(r[2], [choice])]
            p, n = count(some, 0)
        if not rule:
            break
        tried = []
        for k in range(1, len(rule) + 1):
            hit = [r for r in left if holds(r[2], rule[:k])]
            hp, hn = count(hit, 1)
            good = sum(b for _, b, _ in hit)
            tried.append(((hp - hn) / max(hp + hn, 1), -k, good / max(len(hit), 1), good))
        best = max(tried)
        if best[2] < precision or best[3] < support:
            best = tried[-1]
        if best[2] < precision or best[3] < support:
            break
        rule = rule[: -best[1]]
        rules.append(rule)
        left = [r for r in left if not holds(r[2], rule)]
    return rules


def test_learned_list_against_plain_covering(spark):
    """The rules, and kept of every document, from texts and labels alone."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            bad[r.doc_id] = max(bad.get(r.doc_id, 0), int(r.quality == 0))
    part = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "int(pmod(xxhash64(doc_id, 7), 3) = 0) AS h").collect()}
    rows = [(part[d], b, values_of(texts[d])) for d, b in bad.items() if d in texts]
    rules = covering(rows)
    learned = quality.learn(quality.labelled(docs, labels))
    flat = lambda r: [(f, above, round(t, 9)) for f, above, t in r]
    assert rules and [flat(r) for r in rules] == [flat([(c.feature, c.above, c.threshold) for c in r]) for r in learned]
    got = quality.quality_rules(docs, labels)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for r in got.collect():
        v = values_of(texts[r.doc_id])
        rejected = any(all((v[f] > t) == above for f, above, t in rule) for rule in rules)
        assert r.kept == (not brute(texts[r.doc_id])[-1] and not rejected)


def test_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "w " * 20, 5, "x"), (1, "w " * 20, 5, "x"), (None, " ".join(map(str, range(30))), 5, "x")], "doc_id long, text string, n_words int, kept string")
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == 3 and [r.kept for r in got if r.doc_id is None] == [True]
    assert quality.quality_rules(docs.limit(0), labels).collect() == []

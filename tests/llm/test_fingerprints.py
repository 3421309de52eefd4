"""Fingerprints against plain sets of paragraphs and a plain peeling."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import fingerprints


def pieces(text):
    return {p.strip(" ") for p in re.findall(r"[^\n.!?]{1,200}[.!?]*|[.!?]+", text)} - {""}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, hashes):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]))
    out = []
    for k, (d, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = pieces(text), pieces(edited), pieces(after)
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(a, b), likeness(a, c), len(a - b), len(b - a)))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, t, 1) for d, t in rows], "doc_id long, text string, keys string, _copy int").repartition(parts)
    got = fingerprints.contract(docs).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_gone, r.n_new) for r in got), key=str), got


def hashes_of(spark, rows):
    texts = spark.createDataFrame([(t or "",) for _, t in rows], "t string")
    return dict(texts.select("t", F.xxhash64("t")).collect())


@pytest.mark.parametrize("seed", range(3))
def test_texts_against_sets(spark, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(["été", "of", "日本", "x𝄞y", "plain", "words"]) for _ in range(rng.randint(0, 9))) + rng.choice(["", ".", "!", "?.."])
    rows = []
    for k in range(60):
        text = "\n".join(line() for _ in range(rng.randint(0, 40)))
        if rows and rng.random() < 0.3:  # a version of the text before
            text = rows[-1][1].replace("of", "to", rng.randint(0, 2)) if rows[-1][1] else None
        rows.append((rng.choice([3 * k, 3 * k, 3 * k, 7, None]), rng.choice([text, text, text, "", None])))
    rows += rows[:5]
    got, _ = run(spark, rows)
    assert got == brute(rows, hashes_of(spark, rows))


def test_one_row_and_no_row(spark):
    assert run(spark, [])[0] == []
    got, rows = run(spark, [(4, "One. Two. Three and more")])
    assert got == brute([(4, "One. Two. Three and more")], hashes_of(spark, [(4, "One. Two. Three and more")]))
    assert rows[0].near_next == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(k, "A line.\nThe same line.\n" * 3) for k in range(30)] + [(99, "A line.\nAnother line.")]
    _, got = run(spark, rows, 7)
    assert len({r.fingerprint for r in got}) == 2 and all(r.near_next == 1.0 for r in got if r.doc_id < 29)


def test_a_long_text_with_many_paragraphs(spark):
    rng = random.Random(5)
    long = "\n".join(f"line {rng.random()}" for _ in range(5000))
    rows = [(1, long), (2, long.replace("line 0.5", "lane 0.5")), (3, "x" * 100_000), (4, "short")]
    got, _ = run(spark, rows)
    assert got == brute(rows, hashes_of(spark, rows))


def test_sketches_that_fail_are_retried_larger(spark, monkeypatch):
    keys = [hash((k, "a")) for k in range(40)]
    df = spark.createDataFrame([(1, 1, keys[:30], keys[5:40], keys), (1, 2, keys, [], keys[:1]), (2, 1, [], [], []), (2, 2, keys, keys[1:], [])], "r int, t int, a array<long>, b array<long>, c array<long>")
    a, b = F.col("a"), F.col("b")
    wide = fingerprints.peeled(fingerprints.sketch(a, 64, b), 64)
    both = fingerprints.peeled(fingerprints.subtracted(fingerprints.sketch(a, 64), fingerprints.sketch(b, 64)), 64)
    for r in df.select("a", "b", wide.alias("w"), both.alias("s")).collect():
        for found in (r.w, r.s):
            assert found.ok and sorted(found.gone) == sorted(set(r.a) - set(r.b)) and sorted(found.new) == sorted(set(r.b) - set(r.a))
    # 40 digests don't fit 24 cells, whatever they are
    assert not df.where("t = 2 AND r = 1").select(fingerprints.peeled(fingerprints.sketch(a, 8), 8)["ok"]).first()[0]
    for load, widths in ((12, (8, 16)), (100, (8, 8)), (100, (8, 128))):
        monkeypatch.setattr(fingerprints, "LOAD", load)
        monkeypatch.setattr(fingerprints, "WIDTHS", widths)
        made = fingerprints.with_sketches(df, ("a", "b", "c"), [F.col("r").cast("long"), F.lit(None).cast("long"), F.lit(-7).cast("long")], ("r", "t"))
        kinds = fingerprints.OTHER, fingerprints.EDITED, fingerprints.EDITED_WIDE, fingerprints.EDITED_ALL
        got = {(r.r, r.t): (r.head, r.d.gone, r.d.new) for r in fingerprints.with_counts(made, "d", kinds).collect()}
        assert got == {(r.r, r.t): ([r.r, None, -7], len(set(r.a) - set(r.b)), len(set(r.b) - set(r.a))) for r in df.collect()}


def test_fingerprint_of_a_column(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["One. Two", "Two\nOne.", "", "Three " * 90])], "doc_id long, text string")
    alone = {r.doc_id: r.f for r in texts.select("doc_id", fingerprints.fingerprint(F.col("text")).alias("f")).collect()}
    assert alone == {r.doc_id: r.fingerprint for r in fingerprints.contract(texts).collect()} and alone[2] == ""


def test_no_python_in_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = fingerprints.contract(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # the texts are dealt once


def test_places_are_constants(spark):
    """An expression for each of a digest's places made code that Java doesn't compile."""
    df = spark.createDataFrame([(1, 1, [5], [6], [7])], "r int, t int, a array<long>, b array<long>, c array<long>")
    plan = fingerprints.with_sketches(df, ("a", "b", "c"), [F.col("r").cast("long")], ("r", "t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("shiftrightunsigned(k") <= 5

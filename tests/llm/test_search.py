import math
import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import search


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        best = {}
        for a in (v for i, v in good if i == q):
            for i, b in good:
                if i != q and len(a) == len(b):
                    s = max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63))  # noqa: B905
                    best[i] = max(s, best.get(i, s))
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def run(table):
    got = search.top_k(table, F.col("vec_id") % 50 == 0)
    return sorted(tuple(r) for r in got.collect())


def test_embeddings(spark, sf, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 64)
    monkeypatch.setattr(search, "QUERIES", 3)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert run(table) == brute([(r.vec_id, r.embedding) for r in table.collect()])


def test_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(5)]) for i in range(120)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 5), (350, [float("inf")] + [0.0] * 4), (400, []), (401, []), (450, [2.0]), (451, [-1.0]), (None, [1.0] * 5), (50, [1.0] * 5), (7, [9.0] * 5), (7, [9.0] * 5), (500, [1e18, -1e18]), (501, [1e18, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, ids int")
    assert run(table) == brute(rows)
    assert run(table.limit(0)) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 500, (8, 64))
    body = np.floor(centres[rng.integers(0, 8, 600)] + rng.normal(0, 20, (600, 64)))
    for s in search.SEGMENTS:
        o = search.outline(body, s)
        assert (o @ o.T >= body @ body.T - 1e-3).all()
    ids = rng.permutation(600)
    got = search.top_pairs(ids[:9], body[:9], ids, body, 5)
    want = [(int(q), int(i), int(s)) for q, v in zip(ids[:9], body[:9], strict=True) for s, i in sorted(((-float(v @ b), int(i)) for i, b in zip(ids, body, strict=True) if i != q))[:5] for s in [-s]]
    assert sorted(got) == sorted(want)


def test_bars_carry_over_and_skip_cells(monkeypatch):
    """Cells one after the other with shared bars give the rows of all at once; far cells are never multiplied out."""
    rng = np.random.default_rng(9)
    near, far = np.floor(rng.normal(300, 40, (400, 64))), np.floor(rng.normal(-300, 40, (400, 64)))
    ids = np.arange(800)
    queries, cells = near[:7], [(ids[:400], near), (ids[400:600], far[:200]), (ids[600:], far[200:])]
    bars, out, passed = np.full(7, -np.inf), [], []
    reach = search.may_reach
    monkeypatch.setattr(search, "may_reach", lambda *a: passed.append(reach(*a)) or passed[-1])
    for i, body in cells:
        out += search.top_pairs(ids[:7], queries, i, body, 5, bars)
    assert passed == [True, False, False]
    want = search.top_pairs(ids[:7], queries, ids, np.concatenate((near, far)), 5)
    assert sorted(out) == sorted(want)


def test_bars_with_repeated_ids():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 60, 300)
    body = rng.integers(-3, 4, (300, 8)).astype(float)
    bars, out = np.full(5, -np.inf), {}
    for a in range(0, 300, 50):
        for q, i, s in search.top_pairs(np.arange(5), body[:5], ids[a : a + 50], body[a : a + 50], 3, bars):
            out[q, i] = max(s, out.get((q, i), s))
    for q in range(5):
        best = {}
        for i, v in zip(ids.tolist(), body, strict=True):
            if i != q:
                best[i] = max(int(v @ body[q]), best.get(i, -(10**9)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]
        got = sorted(((i, s) for (p, i), s in out.items() if p == q), key=lambda x: (-x[1], x[0]))[:3]
        assert got == want

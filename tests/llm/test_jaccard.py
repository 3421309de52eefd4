import random
import re

import numpy as np
import pytest

from barloom.llm import components, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for k, (d, s) in enumerate(sets):
        for g in s if d is not None else ():
            holders.setdefault(g, []).append(k)
    pairs = {(a, b) for at in holders.values() for i, a in enumerate(at) for b in at[i + 1 :]}
    for a, b in pairs:
        (d, s), (e, t) = sets[a], sets[b]
        both = len(s & t)
        if 100 * both >= 80 * (len(s) + len(t) - both):
            x, y = sorted((root(d), root(e)))
            up[y] = x
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=str)


def run(docs):
    return sorted((tuple(r) for r in jaccard.jaccard_classes(docs).collect()), key=str)


def near_copies(seed=4, groups=12, most=25):
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 4, 6, 30, 80, 200]))]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = word().upper()
            if rng.random() < 0.3:
                text += passage.split()
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(text)))
    return rows


ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "  \n"), (10**6 + 3, "One"), (10**6 + 4, "one"), (10**6 + 5, "é É"), (None, "one"), (10**6 + 6, "w " * 30000), (10**6 + 7, "w " * 50), (10**6 + 8, "a b c d e f g h"), (10**6 + 8, "i j k l m n o p"), (10**6 + 9, "I J k l m n o P"), (10**6 + 10, "a\x1cb c\x85d")]


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**5 + d, t) for d, t in near_copies()] + ODD
    assert run(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")) == brute(rows)


def test_groups_of_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE", 7)
    rows = near_copies(9, 8, 60)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def families(sizes=(44, 30, 17)):
    """Families of near copies, unlike one another, whose members share a rare tail with one of another family: one candidate group."""
    rng, rows = random.Random(31), []
    word = lambda: "".join(rng.choice("ijklmnop") for _ in range(5))
    tails = [" ".join(word() for _ in range(6)) for _ in range(max(sizes))]
    for n in sizes:
        base = [word() for _ in range(70)]
        for k in range(n):
            text = list(base)
            text[rng.randrange(70)] = word()
            rows.append((len(rows), " ".join([*text[: 70 - k % 9], tails[k]])))
    rng.shuffle(rows)
    return rows


def test_links_outside_the_largest_class(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE", 3)
    docs = spark.createDataFrame(families(), "doc_id long, text string")
    want = brute(families())
    assert len({c for _, _, c in want}) >= 3
    assert run(docs) == want
    other_pairs = jaccard._other_pairs
    monkeypatch.setattr(jaccard, "_other_pairs", lambda *a: other_pairs(*a).limit(0))
    assert run(docs) != want  # the case does need the second round


@pytest.mark.parametrize("seed", range(6))
def test_trees_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 1 << 40, rng.integers(1, 90), dtype=np.uint64)) for _ in range(30)]
    sets = []
    for _ in range(400):
        s = base[rng.integers(30)]
        s = s[rng.random(len(s)) > rng.choice([0, 0.05, 0.2])]
        sets.append(np.unique(np.append(s, rng.integers(0, 1 << 40, rng.integers(1, 4), dtype=np.uint64))))
    ids, side = rng.permutation(400), rng.integers(0, 2, 400)
    for part in (None, side):
        groups = jaccard.Groups(400)
        for i in range(400):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and (part is None or part[i] != part[j]):
                    groups.join(i, j)
        want, got = {}, dict(jaccard.linked(ids, sets, part, 80))
        for i in range(400):
            want.setdefault(groups.root(i), []).append(int(ids[i]))
        assert {i: got.get(i, i) for i in ids.tolist()} == {d: min(g) for g in want.values() for d in g}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 499), (499, 500)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {499: 499, 500: 499}


def test_components_end_or_raise(spark):
    chain = spark.range(1, 60).selectExpr("id AS u", "id - 1 AS v")
    assert {tuple(r) for r in components.components(chain).collect()} == {(k, 0) for k in range(60)}
    with pytest.raises(RuntimeError):
        components.components(chain, most=1)

import random
from collections import Counter
from fractions import Fraction

import pytest

from barloom.llm import mixing


@pytest.mark.parametrize("seed", range(20))
def test_schedules_keep_every_window(seed):
    rng = random.Random(seed)
    weights = {f"s{k}": rng.choice([0.1, 1, 3, 50]) * rng.random() + 0.001 for k in range(rng.randint(1, 30))}
    slots = mixing.whole_weights(weights, 128)
    period, got = sum(slots.values()), Counter()
    assert period == 128 and set(slots) == set(weights)
    for k, (s, j, slot, release, deadline) in enumerate(mixing.schedule(slots)):
        assert slot == k and release <= slot < deadline and j == got[s]
        got[s] += 1
        for name, n in slots.items():
            assert abs(Fraction(n * (k + 1), period) - got[name]) < 1
    assert got == Counter(slots)


def rows_of(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    return docs, mixing.mix(docs, **how).collect()


def test_mix_holds_targets_and_all_rows(spark):
    rows = [(i, "x", "big", 0) for i in range(600)] + [(1000 + i, None, "mid", 0) for i in range(200)] + [(2000 + i, "", None, 0) for i in range(100)] + [(3000, "y", "unweighted", 0)]
    weights = {"big": 5.0, "mid": 3.0, None: 2.0}
    docs, got = rows_of(spark, rows, weights=weights, period=20, block_rows=4)
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert [r.source for r in got if r.mix_slot is None] == ["unweighted"]
    blocks = Counter()
    for r in got:
        if r.mix_slot is not None:
            blocks[r.mix_slot, r.source] += 1
    assert len({s for s, _ in blocks}) == len(blocks) and max(blocks.values()) <= 4
    seen, share = Counter(), {"big": Fraction(1, 2), "mid": Fraction(3, 10), None: Fraction(1, 5)}
    for k, (slot, source) in enumerate(sorted(blocks, key=lambda x: x[0])):
        if slot >= 120:  # all sources last that long
            break
        assert slot == k
        seen[source] += 1
        assert all(abs(w * (k + 1) - seen[s]) < 1 for s, w in share.items())
    for r in got:
        assert r.mix_slot is None or r.mix_release <= r.mix_slot < r.mix_deadline
    ordered = mixing.in_order(mixing.mix(docs, weights, period=20, block_rows=4), ["doc_id", "source"])
    assert [r.doc_id for r in ordered.collect()] == [r.doc_id for r in sorted(got, key=lambda r: (r.mix_slot is None, r.mix_slot or 0, r.mix_place))]


def test_against_a_plain_simulation(spark, sf):
    """Every row's slot from a slot-by-slot run over whole sources, without periods."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    slots = mixing.whole_weights({r[0]: mixing.root_weight(r[1]) for r in docs.groupBy("source").count().collect()})
    period = sum(slots.values())
    got = mixing.contract(docs).collect()
    assert len(got) == docs.count()
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.mix_block), set()).add((r.mix_slot, r.mix_release, r.mix_deadline))
    most = max(r.mix_slot for r in got) + 1
    done = Counter()
    for slot in range(most):
        due = [(-(-(done[s] + 1) * period // n), s) for s, n in slots.items() if done[s] * period // n <= slot]
        deadline, s = min(due)
        if (s, done[s]) in blocks:
            assert blocks[s, done[s]] == {(slot, done[s] * period // slots[s], deadline)}
        done[s] += 1


def test_odd_tables(spark):
    assert rows_of(spark, [])[1] == []
    twice = [(1, "a", "s", 0), (1, "a", "s", 0), (1, "b", "s", 0), (None, None, None, None)]
    got = rows_of(spark, twice, block_rows=1)[1]
    assert len(got) == 4 and len({r.mix_slot for r in got}) == 4


def test_targets_are_not_rounded(spark):
    """One hot source and 19 small ones over 100,000 slots: less than one block from the unrounded targets at every slot."""
    weights = {f"s{k:02}": (700.0 if k == 0 else 1.0 + k) ** 0.5 for k in range(20)}
    slots = mixing.whole_weights(weights)
    total = sum(map(Fraction, weights.values()))
    got = Counter()
    for k, (s, _, slot, release, deadline) in enumerate(mixing.schedule(slots, {s: 10**6 for s in weights})):
        if k == 100_000:
            break
        assert slot == k and release <= slot < deadline
        got[s] += 1
        if k % 97 == 0:
            assert all(abs(Fraction(w) / total * (k + 1) - got[n]) < 1 for n, w in weights.items())
    n = 12_000  # many times 1024 blocks, through mix()
    rows = [(i, "", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(n)]
    done = rows_of(spark, rows, block_rows=1)[1]
    counts = Counter(r[2] for r in rows)
    targets = {s: Fraction(float(c) ** 0.5) for s, c in counts.items()}
    total = sum(targets.values())
    assert len({r.mix_slot for r in done}) == len(done) == n and max(r.mix_slot for r in done) > 1024 * 4
    for r in done:
        w = targets[r.source] / total
        assert (r.mix_release, r.mix_deadline) == (r.mix_block // w, -(-(r.mix_block + 1) // w))
        assert r.mix_release <= r.mix_slot < r.mix_deadline


def test_more_sources_than_a_thousand(spark):
    """A source with a third of the rows keeps its weight among 1,500."""
    rows = [(i, "", "hot", 0) for i in range(1500)] + [(10_000 + i, "", f"s{i % 1499}", 0) for i in range(2998)]
    done = rows_of(spark, rows, block_rows=1)[1]
    w = Fraction(1500**0.5) / (Fraction(1500**0.5) + 1499 * Fraction(2**0.5))
    hot = sorted((r.mix_slot, r.mix_block) for r in done if r.source == "hot")
    assert len(done) == len(rows) and [b for _, b in hot] == list(range(1500))
    assert all(b // w <= slot < -(-(b + 1) // w) for slot, b in hot)


def test_names_that_clash(spark):
    names = ["s", "j", "n", "slot", "rate", "release", "due", "t", "a b", "x.y"]
    docs = spark.createDataFrame([(i, "z", f"s{i % 3}", *range(10)) for i in range(30)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.mix(docs, block_rows=2)
    assert got.columns[:13] == docs.columns and {tuple(r[3:13]) for r in got.collect()} == {tuple(range(10))} and got.count() == 30
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("Mix_Slot", docs.s))


def test_null_ids_are_spread(spark):
    rows = [(None, f"t{i}", "hot", 0) for i in range(400)]
    got = rows_of(spark, rows, block_rows=4)[1]
    assert sorted(r.text for r in got) == sorted(r[1] for r in rows)
    assert sorted((r.mix_slot, r.mix_place) for r in got) == [(k // 4, k % 4) for k in range(400)]

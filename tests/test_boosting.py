"""Boosting against a plain version that holds all rows in memory and evaluates children as they arise."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import ranged
from barloom.operators import boosting, models


def plain_tree(x, g, h, rules):
    """Leaf of each row, and leaf values, best leaf first; x holds bins."""

    def best(rows):
        whole = g[rows].sum() ** 2 / h[rows].sum()
        found = (0.0, None)
        for f in range(x.shape[1]):
            for b in range(int(x[:, f].max())):
                left, right = rows[x[rows, f] <= b], rows[x[rows, f] > b]
                if min(len(left), len(right)) < rules.min_samples_leaf or min(h[left].sum(), h[right].sum()) < rules.min_hessian:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - whole
                if gain > found[0] * (1 + 1e-9) + 1e-12:
                    found = (gain, (left, right))
        return found

    leaves = [(np.arange(len(g)), *best(np.arange(len(g))), 0)]
    while len(leaves) < rules.max_leaf_nodes:
        k = max(range(len(leaves)), key=lambda k: leaves[k][1])
        rows, gain, parts, depth = leaves[k]
        if not gain or (rules.max_depth is not None and depth >= rules.max_depth):
            break
        leaves[k : k + 1] = [(p, *(best(p) if rules.max_depth is None or depth + 1 < rules.max_depth else (0.0, None)), depth + 1) for p in parts]
    return [rows for rows, *_ in leaves]


def plain_boost(x, y, iterations, rate, rules):
    raw = np.full(len(y), math.log(y.sum() / (len(y) - y.sum())))
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        step = np.zeros(len(y))
        for rows in plain_tree(x, g, h, rules):
            step[rows] = -g[rows].sum() / h[rows].sum()
        raw = raw + rate * step
    return 1 / (1 + np.exp(-raw))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = []
    for k in range(600):
        a, b, c = rng.gauss(0, 1), rng.randint(0, 5), rng.random()
        rows.append((k, a, b, c, 1.0, int(rng.random() < 1 / (1 + math.exp(-(2 * a * (b > 2) + (c > 0.7) - 0.5))))))
    return spark.createDataFrame(rows, "k int, a double, b int, c double, d double, y int").repartition(3).cache()


def placed(table, edges, features):
    rows = sorted(table.collect())
    return rows, np.array([[sum(e < r[f] for e in edges[f]) for f in features] for r in rows]), np.array([r.y for r in rows], float)


@pytest.mark.parametrize("rules", [boosting.Rules(), boosting.Rules(6, None, 5), boosting.Rules(31, 3, 10), boosting.Rules(2)])
def test_scores_equal_a_plain_version(spark, table, rules):
    features = ["a", "b", "c", "d"]
    model = boosting.boost(table, features, "y", iterations=3, rate=0.3, max_bins=16, rules=rules)
    rows, x, y = placed(table, model.edges, features)
    want = plain_boost(x, y, 3, 0.3, rules)
    got = {r.k: r.y_score for r in model.scored(table).collect()}
    assert np.allclose([got[r.k] for r in rows], want, atol=1e-9)

    def depth(node):
        return 0 if node.left is None else 1 + max(depth(node.left), depth(node.right))

    for tree, scans in zip(model.trees, model.scans, strict=True):
        assert scans <= depth(tree) + 1  # a scan for the root, and one for each level at most


def test_bins(spark, table):
    edges = boosting.bin_edges(table, ["a", "b", "d"], 8)
    assert edges["b"] == [0.5, 1.5, 2.5, 3.5, 4.5] and edges["d"] == [] and len(edges["a"]) == 7
    want = table.agg(F.percentile("a", F.array(*[F.lit(k / 8) for k in range(1, 8)]))).first()[0]
    assert edges["a"] == pytest.approx(want)
    made, bins = boosting.binned(table, {"a": [edges["a"][3]], "b": [2.0], "d": []})
    for r in made.collect():
        assert (r[bins[0]], r[bins[1]], r[bins[2]]) == (int(r.a > edges["a"][3]), int(r.b > 2), 0)


def test_many_trees_are_written_in_between(spark, table, monkeypatch):
    want = [r.y_score for r in boosting.boost(table, ["a", "c"], "y", 5, 0.2, 8, boosting.Rules(4)).scored(table).orderBy("k").collect()]
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    assert [r.y_score for r in boosting.boost(table, ["a", "c"], "y", 5, 0.2, 8, boosting.Rules(4)).scored(table).orderBy("k").collect()] == pytest.approx(want)


def test_saved_and_loaded_as_a_model(spark, table, tmp_path):
    rows = table.withColumn("split", F.when(F.col("k") % 3 == 0, "validation").when(F.col("k") % 3 == 1, "test").otherwise("train"))
    data = models.dataset(rows, ["a", "b", "c"], "y")
    model = models.fit({"estimator": "boosted", "params": {"max_iter": 3, "learning_rate": 0.2, "max_bins": 16}}, data)
    model.save(spark, f"{tmp_path}/m")
    again = models.load(spark, f"{tmp_path}/m")
    a, b = (sorted(m.transform(data.test).select("k", "y_score", "y_pred").collect()) for m in (model, again))
    assert a == b and {r.y_pred for r in a} == {0, 1} and all((r.y_score >= 0.5) == (r.y_pred == 1) for r in a)
    one = models.dataset(rows.withColumn("y", F.lit(1)), ["a"], "y")
    assert isinstance(models.fit({"estimator": "boosted"}, one), models.MajorityModel)


def test_bad_input(spark, table):
    with pytest.raises(ValueError):
        boosting.boost(table.where("y = 1"), ["a"], "y", 1)
    with pytest.raises(ValueError):
        boosting.boost(table.where("false"), ["a"], "y", 1)
    with pytest.raises(ValueError):
        boosting.boost(table, ["a"], "y", 0)


def test_edges_stage_no_row_per_feature(spark, monkeypatch):
    sizes = []
    for module in (boosting, ranged):
        write = module.staged
        monkeypatch.setattr(module, "staged", lambda df, name, write=write: (made := write(df, name), sizes.append(made.count()))[0])
    rows = spark.range(3000).selectExpr("id % 5 AS a", "id % 3 AS b", "CAST(id AS double) AS c", "1 AS d")
    got = boosting.bin_edges(rows, ["a", "b", "c", "d"], 4)
    assert got == {"a": pytest.approx([1, 2, 3]), "b": [0.5, 1.5], "c": pytest.approx([749.75, 1499.5, 2249.25]), "d": []}
    assert max(sizes) <= 6000  # the rows once, and a value of each of the two features with more than four

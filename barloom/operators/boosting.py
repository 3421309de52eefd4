"""Gradient boosting of binary targets over binned features; trees grow leaf by leaf, the one with the largest gain first.

Features are cut once into at most max_bins bins, by their quantiles. A tree needs sums of gradients and second derivatives by leaf,
feature and bin: one aggregation, whose result has at most leaves x features x bins rows, whatever the number of rows. A scan
fills in the smaller child of every leaf that may still be split, and the larger one is the rest of its parent. So a tree takes at
most as many scans as it is deep, and yet the leaves are split in the order of their gains.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field
from itertools import count

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ranged import quantiles
from barloom.sources.staging import staged
from barloom.sources.tables import get_text, put_text

#: Trees after which the raw scores are written, so that no row recomputes more than these.
WRITTEN = 10


@dataclass
class Node:
    """A leaf has a value; an inner node a feature, the last bin that goes left, and two children."""

    feature: int = -1
    bin: int = -1
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0

    def column(self, bins: list[str]) -> Column:
        """The value of the leaf that a row falls into."""
        if self.left is None:
            return F.lit(self.value)
        return F.when(F.col(bins[self.feature]) <= self.bin, self.left.column(bins)).otherwise(self.right.column(bins))

    def plain(self) -> dict:
        return {"value": self.value} if self.left is None else {"feature": self.feature, "bin": self.bin, "left": self.left.plain(), "right": self.right.plain()}

    @staticmethod
    def of(plain: dict) -> Node:
        if "left" not in plain:
            return Node(value=plain["value"])
        return Node(plain["feature"], plain["bin"], Node.of(plain["left"]), Node.of(plain["right"]))


@dataclass
class Leaf:
    """A possible leaf: its sums by feature and bin (gradient, second derivative, rows), the best split of them, and what that gives."""

    sums: np.ndarray
    depth: int
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[Leaf, Leaf] | None = None

    def smaller_left(self) -> bool:
        n = self.sums[self.feature, :, 2]
        return bool(2 * n[: self.bin + 1].sum() <= n.sum())


@dataclass(frozen=True)
class Rules:
    max_leaf_nodes: int = 31
    max_depth: int | None = None
    min_samples_leaf: int = 20
    l2: float = 0.0
    min_hessian: float = 1e-3

    def value(self, sums: np.ndarray) -> float:
        g, h, _ = sums[0].sum(0)
        return float(-g / (h + self.l2 + 1e-15))

    def best(self, leaf: Leaf) -> Leaf:
        """The leaf with the split of largest gain; of equal ones that of the first feature, then of the first bin."""
        if self.max_depth is not None and leaf.depth >= self.max_depth:
            return leaf
        left = leaf.sums.cumsum(1)[:, :-1]
        whole = leaf.sums[0].sum(0)
        right = whole - left
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.l2 + 1e-15)
        gain = score(left) + score(right) - score(whole)
        sound = (np.minimum(left[..., 2], right[..., 2]) >= self.min_samples_leaf) & (np.minimum(left[..., 1], right[..., 1]) >= self.min_hessian)
        gain = np.where(sound, gain, -np.inf)
        if gain.size and (most := float(gain.max())) > 1e-12:
            at = int(np.argmax(gain >= most * (1 - 1e-9)))  # sums depend on the order of rows in their last digits
            leaf.gain, (leaf.feature, leaf.bin) = most, divmod(at, gain.shape[1])
        return leaf


def bin_edges(df: DataFrame, features: list[str], max_bins: int = 255) -> dict[str, list[float]]:
    """Of each feature the bounds of its bins: midpoints of its values where it has at most max_bins, else inner quantiles."""
    names = {f: f"_f{k}" for k, f in enumerate(features)}
    table = staged(df.select(*[F.col(f).cast("double").alias(c) for f, c in names.items()]), "features")
    some = table.agg(*[F.approx_count_distinct(c).alias(c) for c in names.values()]).first()
    # up to max_bins values, counted exactly where the estimate is near
    few = [f for f, c in names.items() if some[c] <= 2 * max_bins]
    values = table.agg(*[F.array_sort(F.collect_set(names[f])).alias(names[f]) for f in few]).first() if few else {}
    edges = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f in few if len(v := values[names[f]]) <= max_bins}  # noqa: B905
    rest = [f for f in features if f not in edges]
    if rest:
        at = [k / max_bins for k in range(1, max_bins)]
        pairs = F.array(*[F.struct(F.lit(features.index(f)).alias("feature"), F.col(names[f]).alias("value")) for f in rest])
        long = table.select(F.explode(pairs).alias("p")).select("p.*")
        for r in quantiles(long, "value", at, ("feature",)).groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("v")).collect():
            edges[features[r.feature]] = list(r.v)
    return {f: edges.get(f, []) for f in features}


def binned(df: DataFrame, edges: dict[str, list[float]]) -> tuple[DataFrame, list[str]]:
    """df with the bin of each feature, as _bin0, _bin1 ...: how many edges are below the value."""
    names = [f"_bin{k}" for k in range(len(edges))]
    cuts = [[-math.inf, *[math.nextafter(e, math.inf) for e in some], math.inf] for some in edges.values()]
    wide = [k for k, c in enumerate(cuts) if len(c) > 2]
    doubles = df.withColumns({f"_d{k}": F.col(f).cast("double") for k, f in enumerate(edges)})
    made = Bucketizer(splitsArray=[cuts[k] for k in wide], inputCols=[f"_d{k}" for k in wide], outputCols=[names[k] for k in wide], handleInvalid="error").transform(doubles) if wide else doubles
    kinds = {n: F.col(n).cast("int") if k in wide else F.lit(0) for k, n in enumerate(names)}
    return made.withColumns(kinds).drop(*[f"_d{k}" for k in range(len(edges))]), names


def _sums(rows: DataFrame, bins: list[str], group: Column, most: int) -> dict[int, np.ndarray]:
    """By group (null rows left out): an array of feature, bin and (gradient, second derivative, rows)."""
    each = F.posexplode(F.array(*[F.col(b) for b in bins])).alias("feature", "bin")
    found = rows.withColumn("group", group).where("group IS NOT NULL").select("group", "_g", "_h", each)
    out: dict[int, np.ndarray] = {}
    for r in found.groupBy("group", "feature", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r.group, np.zeros((len(bins), most, 3)))[r.feature, r.bin] = (r.g, r.h, r.n)
    return out


def best_first(root: Leaf, most: int) -> list[Leaf]:
    """The leaves that are split, in order, until there are `most`; what isn't known of children counts as nothing."""
    order, out = count(), []
    queue = [(-root.gain, next(order), root)] if root.gain > 0 else []
    while queue and len(out) + 1 < most:
        leaf = heapq.heappop(queue)[2]
        out.append(leaf)
        for child in leaf.children or ():
            if child.gain > 0:
                heapq.heappush(queue, (-child.gain, next(order), child))
    return out


def grow(rows: DataFrame, bins: list[str], most: int, rules: Rules) -> tuple[Node, int]:
    """A tree over rows of bins, _g and _h, and how many scans it took.

    Each scan opens every leaf without known children that may be split: what is unknown can only take splits away from the others.
    """
    empty = np.zeros((len(bins), most, 3))
    root, scans = rules.best(Leaf(_sums(rows, bins, F.lit(0), most).get(0, empty), 0)), 1
    while open_ := [leaf for leaf in best_first(root, rules.max_leaf_nodes) if leaf.children is None]:
        number = {id(leaf): k for k, leaf in enumerate(open_)}

        def group(leaf: Leaf) -> Column:
            """Of a row in the smaller child of an open leaf the number of that leaf, else null."""
            if leaf.feature < 0 or (leaf.children is None and id(leaf) not in number):
                return F.lit(None).cast("int")
            below = F.col(bins[leaf.feature]) <= leaf.bin
            if leaf.children is None:
                return F.when(below if leaf.smaller_left() else ~below, F.lit(number[id(leaf)]))
            return F.when(below, group(leaf.children[0])).otherwise(group(leaf.children[1]))

        found = _sums(rows, bins, group(root), most)
        scans += 1
        for k, leaf in enumerate(open_):
            part = found.get(k, empty)
            both = (part, leaf.sums - part) if leaf.smaller_left() else (leaf.sums - part, part)
            leaf.children = tuple(rules.best(Leaf(s, leaf.depth + 1)) for s in both)
    split = {id(leaf) for leaf in best_first(root, rules.max_leaf_nodes)}

    def node(leaf: Leaf) -> Node:
        if id(leaf) not in split:
            return Node(value=rules.value(leaf.sums))
        return Node(leaf.feature, leaf.bin, node(leaf.children[0]), node(leaf.children[1]))

    return node(root), scans


@dataclass
class BoostedTrees:
    """raw = base + rate x the sum of the trees; the score of class 1 is its logistic function."""

    edges: dict[str, list[float]]
    base: float
    rate: float
    trees: list[Node] = field(default_factory=list)
    scans: list[int] = field(default_factory=list)

    def raw(self, bins: list[str], trees: list[Node]) -> Column:
        parts = F.array(*[t.column(bins) for t in trees])
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) * F.lit(self.rate) if trees else F.lit(0.0)

    def scored(self, df: DataFrame, name: str = "y_score") -> DataFrame:
        made, bins = binned(df, self.edges)
        total = F.lit(self.base)
        for a in range(0, len(self.trees), WRITTEN):
            made = made.withColumn("_raw", (F.col("_raw") if a else total) + self.raw(bins, self.trees[a : a + WRITTEN]))
        raw = F.col("_raw") if self.trees else total
        return made.withColumn(name, 1 / (1 + F.exp(-raw))).drop("_raw", *bins)

    def save(self, spark: SparkSession, path: str) -> None:
        put_text(spark, f"{path}/boosted.json", json.dumps({"edges": self.edges, "base": self.base, "rate": self.rate, "trees": [t.plain() for t in self.trees]}))

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees | None:
        text = get_text(spark, f"{path}/boosted.json")
        if text is None:
            return None
        plain = json.loads(text)
        return BoostedTrees(plain["edges"], plain["base"], plain["rate"], [Node.of(t) for t in plain["trees"]])


def boost(train: DataFrame, features: list[str], target: str, iterations: int = 200, rate: float = 0.05, max_bins: int = 255, rules: Rules = Rules()) -> BoostedTrees:  # noqa: B008
    """Fits trees to a target of 0 and 1 by its logistic loss. Null features raise; a target of one class raises, too."""
    if iterations < 1 or rules.max_leaf_nodes < 2 or max_bins < 2:
        raise ValueError("boosting needs an iteration, two leaves and two bins at least")
    edges = bin_edges(train, features, max_bins)
    table, bins = binned(train, edges)
    most = max(len(e) for e in edges.values()) + 1
    rows = staged(table.select(*bins, F.col(target).cast("double").alias("_y"), F.lit(0.0).alias("_raw")), "binned")
    n, ones = rows.agg(F.count("_y"), F.sum("_y")).first()
    if not n or not 0 < ones < n:
        raise ValueError("the target needs both classes")
    model = BoostedTrees(edges, math.log(ones / (n - ones)), rate)
    written = 0
    for k in range(iterations):
        chance = 1 / (1 + F.exp(-(F.lit(model.base) + F.col("_raw") + model.raw(bins, model.trees[written:]))))
        graded = rows.withColumn("_p", chance).select(*bins, (F.col("_p") - F.col("_y")).alias("_g"), (F.col("_p") * (1 - F.col("_p"))).alias("_h"))
        tree, scans = grow(graded, bins, most, rules)
        model.trees.append(tree)
        model.scans.append(scans)
        if k + 1 - written == WRITTEN and k + 1 < iterations:
            rows = staged(rows.withColumn("_raw", F.col("_raw") + model.raw(bins, model.trees[written:])), "binned")
            written = k + 1
    return model

"""Connected components of a large graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import through_table


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. An aggregate joined back: a hub's rows can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).drop("w")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (u, v): the least node that is reachable. Loops and repeated edges don't matter.

    Each round is written to the shared folder; rounds end when a round changes nothing. Raises when `most` rounds don't get there,
    as components may not be final then.
    """
    now = through_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = _with_least(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(starred.select("u", F.col("m").alias("v")))
        now = through_table(small.distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not final after {most} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

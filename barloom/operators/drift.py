"""Drift of distributions (population stability index) and freshness of bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import severity
from barloom.functions.ranged import quantile_arrays
from barloom.operators import quality
from barloom.sources.staging import staged

EPSILON = 1e-6


def of_splits(df: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    return df if values is None else df.where(F.col(column).isin(*values))


def long_form(df: DataFrame, features: list[str], side: str) -> DataFrame:
    """(feature, value, side) without nulls: one expansion per row, whatever the number of features."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.explode(pairs).alias("p")).select("p.feature", "p.value", F.lit(side).alias("side")).where("value IS NOT NULL")


def numeric_summary(long: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by, n, mean, std, min, p25, median, p75, max); the quantiles by ranges of the values."""
    made = long.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantile_arrays(long, "value", [0.25, 0.5, 0.75], by)
    return made.join(q, list(by), "left").select(*by, "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max")


def bin_edges(long: DataFrame, bins: int) -> DataFrame:
    """(feature, edges): the distinct inner quantiles of the reference; the outer edges are open."""
    quantiles = quantile_arrays(long.where("side = 'reference'"), "value", [k / bins for k in range(bins + 1)], ("feature",))
    distinct = quantiles.select("feature", F.array_sort(F.array_distinct("q")).alias("q"))
    inner = F.when(F.size("q") > 2, F.slice("q", F.lit(2), F.size("q") - 2)).otherwise(F.array().cast("array<double>"))
    return distinct.select("feature", inner.alias("edges"))


def stability(long: DataFrame, bins: int, epsilon: float = EPSILON) -> DataFrame:
    """(feature, psi): over half-open bins of the reference's quantiles; null where a side is empty. `long` is read for the edges
    and once for the counts, which also give the totals."""
    edges = bin_edges(long, bins)  # a row per feature
    place = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    counted = long.join(F.broadcast(edges), "feature").groupBy("feature", "edges", place.alias("bin")).agg(F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "current").alias("c"))
    bars = counted.groupBy("feature", F.size("edges").alias("last")).agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"), F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c")))).alias("held"))  # a few bins
    share = lambda k, n: F.greatest(F.try_divide(F.coalesce(k, F.lit(0)), F.col(n)), F.lit(epsilon))
    shares = bars.select("feature", "rn", "cn", "held", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin")).withColumn("h", F.try_element_at("held", F.col("bin")))
    shares = shares.select("feature", "rn", "cn", share(F.col("h.r"), "rn").alias("a"), share(F.col("h.c"), "cn").alias("b"))
    psi = F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a")))
    return shares.groupBy("feature").agg(F.when((F.max("cn") > 0) & (F.max("rn") > 0), psi).alias("psi"))


#: Size of a stored sketch; see rank_error(). Up to so many values a sketch holds all of them.
SKETCH = 2000


def rank_error(k: int, share: bool = False) -> float:
    """How far off a sketch of size k has a rank, or the share of values between two bounds, in 99 of 100 cases (published fit)."""
    return 2.446 / k**0.9433 if share else 2.296 / k**0.9021


def day_sketches(df: DataFrame, features: list[str], k: int = SKETCH, timestamp: str = "timestamp") -> DataFrame:
    """(feature, day, n, sketch): the values of each feature and day in a sketch of bounded size, without nulls. Written once, it answers for
    any period; days that come later are more rows. Tasks sketch what they read, and sketches are merged."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(F.to_date(timestamp).alias("day"), F.explode(pairs).alias("p")).select("p.feature", "day", "p.value").where("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy("feature", "day").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def of_period(sketches: DataFrame, start=None, end=None) -> DataFrame:
    """(feature, n, sketch) of the days from start to end, both included; None leaves a side open."""
    for bound, test in ((start, F.col("day") >= F.lit(start).cast("date")), (end, F.col("day") <= F.lit(end).cast("date"))):
        sketches = sketches if bound is None else sketches.where(test)
    return sketches.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_stability(reference: DataFrame, current: DataFrame, bins: int = 10, epsilon: float = EPSILON) -> DataFrame:
    """(feature, psi) of two periods from their sketches, a row per feature: no values are read again. Edges are the distinct inner
    quantiles of the reference, taken from its values; a bin has the values from its edge on and below the next. psi is null where a
    side has none. Shares are off by rank_error(k, True), and exact while a period has at most k values."""
    quantiles = F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / bins) for k in range(bins + 1)]))))
    # a rank is asked for by a literal: the edges come to the driver, a row per feature. Ranks count the value itself: the double before
    edges = {r.feature: [math.nextafter(e, -math.inf) for e in r.q[1:-1]] for r in reference.where("n > 0").select("feature", quantiles.alias("q")).collect()}

    def ranks(side: str):
        asked = [F.when(F.col("feature") == f, F.kll_sketch_get_rank_double(side, F.array(*map(F.lit, some)))) for f, some in edges.items() if some]
        return F.concat(F.array(F.lit(0.0)), F.coalesce(*asked, F.array().cast("array<double>")), F.array(F.lit(1.0)))

    sides = reference.select("feature", F.col("n").alias("rn"), F.col("sketch").alias("r")).join(current.select("feature", F.col("n").alias("cn"), F.col("sketch").alias("c")), "feature", "full")
    ranked = sides.where("rn > 0 AND cn > 0").select("feature", ranks("r").alias("a"), ranks("c").alias("b"))
    share = lambda x, k: F.greatest(F.element_at(x, k + 1) - F.element_at(x, k), F.lit(epsilon))
    each = ranked.select("feature", "a", "b", F.explode(F.sequence(F.lit(1), F.size("a") - 1)).alias("k"))
    a, b = share(F.col("a"), F.col("k")), share(F.col("b"), F.col("k"))
    empty = (F.element_at("a", F.col("k") + 1) == F.element_at("a", F.col("k"))) & (F.element_at("b", F.col("k") + 1) == F.element_at("b", F.col("k")))
    psi = F.sum(F.when(empty, 0.0).otherwise((b - a) * F.ln(b / a)))
    found = each.groupBy("feature").agg(psi.alias("psi"))
    return sides.select("feature").join(found, "feature", "left").select("feature", "psi")


def feature_drift(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10, warning: float = 0.1, alert: float = 0.25) -> DataFrame:
    """A row per feature: psi, severity and both summaries. The reader sorts by severity, then psi downwards."""
    long = staged(long_form(reference, features, "reference").unionByName(long_form(current, features, "current")), "long")
    names = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    out = names.join(stability(long, bins), "feature", "left").withColumn("severity", severity(F.col("psi"), warning, alert))
    sums = numeric_summary(long, ("feature", "side"))
    for side in ("reference", "current"):
        mine = sums.where(F.col("side") == side).drop("side")
        out = out.join(mine.select("feature", *[F.col(c).alias(f"{side}_{c}") for c in mine.columns[1:]]), "feature", "left")
    return out.orderBy("severity", F.desc_nulls_last("psi"), "feature")


def prediction_drift(reference: DataFrame, current: DataFrame, score: str, threshold: float = 0.5, bins: int = 10, warning: float = 0.1, alert: float = 0.25) -> DataFrame:
    """One row: psi of the scores, severity, and each side's summary and share of positives."""
    out = feature_drift(reference, current, [score], bins, warning, alert)
    for side, df in (("reference", reference), ("current", current)):
        rate = df.where(F.col(score).isNotNull()).agg(F.avg((F.col(score) >= threshold).cast("int")).alias(f"{side}_positive_rate"))
        out = out.crossJoin(F.broadcast(rate))  # an aggregate: one row
    return out


def severity_counts(drift: DataFrame) -> DataFrame:
    return drift.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def freshness(df: DataFrame, seconds: int, mode: str = "historical", most_minutes: float = 15, reference: str | None = None, preview: int = 10) -> DataFrame:
    """A row per symbol (ALL where there is none): rows, bounds, missing bars, the first few of them, delay and is_fresh.

    historical: coverage is reported, and old data are fresh. live: fresh if the last bar is at most most_minutes before the
    reference (now). Null times raise when the rows are read."""
    if mode not in ("historical", "live"):
        raise ValueError(f"unknown mode {mode!r}")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit("ALL"))
    timed = F.when(F.col("timestamp").isNull(), F.raise_error(F.lit("a null time")).cast("timestamp_ntz")).otherwise(F.col("timestamp"))
    df = df.withColumn("timestamp", timed)
    rows = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))
    holes = quality.first_missing(staged(quality.gaps(df, seconds), "gaps"), df.schema["timestamp"].dataType.simpleString(), preview)
    holes = holes.withColumnRenamed("symbol", "_s")
    now: Column = F.lit(reference).cast("timestamp_ntz") if reference else F.localtimestamp()
    delay = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 60e6 if mode == "live" else F.lit(None).cast("double")
    out = rows.join(holes, F.col("symbol").eqNullSafe(F.col("_s")), "left").select("symbol", "n_rows", "earliest", "latest", F.coalesce("m", F.lit(0)).cast("long").alias("missing_count"), "missing_preview", delay.alias("delay_minutes"))
    return out.withColumn("is_fresh", F.col("delay_minutes") <= most_minutes if mode == "live" else F.lit(True))


def freshness_overall(fresh: DataFrame) -> DataFrame:
    """One row over the rows of freshness(): passed (all symbols are fresh) and total_missing."""
    return fresh.agg(F.coalesce(F.bool_and("is_fresh"), F.lit(True)).alias("passed"), F.coalesce(F.sum("missing_count"), F.lit(0)).alias("total_missing"))

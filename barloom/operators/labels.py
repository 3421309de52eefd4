"""Forward-looking values and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import by_time, leading_sum, log, ratio
from barloom.functions.ranged import quantiles
from barloom.operators import chunks
from barloom.operators.bars import coerced, require
from barloom.sources.staging import staged


def _checked(df: DataFrame) -> DataFrame:
    bad = df.agg(F.count_if(F.col("timestamp").isNull() | F.col("close").isNull() | (F.col("close") <= 0))).first()[0]
    if bad:
        raise ValueError(f"{bad} rows have a null time or close, or a close at or below 0")
    return df


def _typed(df: DataFrame) -> DataFrame:
    require(df, ("symbol", "timestamp", "close"), "labels")
    return coerced(df)


def prepared(df: DataFrame) -> DataFrame:
    """Input of labels in canonical types. Raises on missing columns, null times or closes, and closes at or below 0."""
    return _checked(_typed(df))


def build(df: DataFrame, h: int, fraction: float, q: float, chunk_rows: int | None = None) -> DataFrame:
    """future_return_h, future_rv_h, used_for_label_threshold and y_high_vol_h of bars, checked as prepared() does. The mask is written
    once: the checks, the threshold and the labels read it. chunk_rows: for few symbols with very many rows, by chunks of that many
    rows and places from counts, without a task for each symbol."""
    typed = _typed(df)
    masked = threshold_mask(future_values(typed, h), h, fraction) if chunk_rows is None else threshold_mask_placed(future_values_chunked(typed, h, chunk_rows), h, fraction)
    made = _checked(staged(masked, "masked"))
    return binary_label(made, h, threshold(made, h, q, "used_for_label_threshold"))


def future_values(df: DataFrame, h: int) -> DataFrame:
    """Adds future_return_h and future_rv_h (root of the sum of squared log returns over the next h rows)."""
    if h <= 0:
        raise ValueError("the horizon must be positive")
    w = by_time()
    r = log(F.col("close")) - F.lag(log(F.col("close"))).over(w)
    made = df.withColumns({"_r2": r * r, f"future_return_{h}": F.lead(log(F.col("close")), h).over(w) - log(F.col("close"))})
    return made.withColumn(f"future_rv_{h}", F.sqrt(leading_sum(F.col("_r2"), h, w))).drop("_r2")


def future_sum(df: DataFrame, column: str, h: int, out: str = "future_sum") -> DataFrame:
    return df.withColumn(out, leading_sum(F.col(column), h, by_time()))


def future_values_chunked(df: DataFrame, h: int, rows: int) -> DataFrame:
    """future_values() for few symbols with very many rows, `rows` rows at a time."""
    return chunks.in_chunks(df, 1, h, rows, lambda part: future_values(part, h))


def _mask(there: Column, place: Column, n: Column, fraction: float) -> Column:
    """Whether the place is among the first floor(n * fraction); a symbol with values of which none would be taken raises."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    first = F.floor(n * F.lit(float(fraction)))
    few = F.raise_error(F.concat(F.lit("too few rows with a value for a threshold: "), F.coalesce(F.col("symbol"), F.lit("null")))).cast("boolean")
    return F.when(there, F.when(first < 1, few).otherwise(place < first)).otherwise(F.lit(False))


def threshold_mask(df: DataFrame, h: int, fraction: float, out: str = "used_for_label_threshold") -> DataFrame:
    """Flags the first floor(n * fraction) rows with a value of each symbol. A symbol with values but too few raises."""
    there = F.col(f"future_rv_{h}").isNotNull()
    place = F.count(F.when(there, 1)).over(by_time().rowsBetween(Window.unboundedPreceding, 0)) - 1
    n = F.count(F.when(there, 1)).over(Window.partitionBy("symbol"))
    return df.withColumns({"_place": place, "_all": n}).withColumn(out, _mask(there, F.col("_place"), F.col("_all"), fraction)).drop("_place", "_all")


def threshold_mask_placed(df: DataFrame, h: int, fraction: float, out: str = "used_for_label_threshold") -> DataFrame:
    """threshold_mask() without a task for each symbol: places follow from counts per day."""
    there = F.col(f"future_rv_{h}").isNotNull()
    return chunks.placed(df, there, "_place", "_all").withColumn(out, _mask(there, F.col("_place"), F.col("_all"), fraction)).drop("_place", "_all")


def threshold(df: DataFrame, h: int, q: float, where: Column | str) -> DataFrame:
    """One row: the exact quantile over the chosen rows, all symbols together; null without values. Found by ranges of the value."""
    found = quantiles(df.where(where), f"future_rv_{h}", [q])
    return df.sparkSession.range(1).join(F.broadcast(found), F.lit(True), "left").select(F.col("value").alias("threshold"))  # one row each


def binary_label(df: DataFrame, h: int, limit: DataFrame | float, out: str | None = None) -> DataFrame:
    """1 where future_rv_h > limit, 0 where not, null where the value is. A limit of one row joins as a broadcast scalar."""
    name, value = out or f"y_high_vol_{h}", F.col(f"future_rv_{h}")
    if isinstance(limit, DataFrame):
        df = df.crossJoin(F.broadcast(limit.select(F.col("threshold").alias("_limit"))))  # an aggregate: always one row
        return df.withColumn(name, (value > F.col("_limit")).cast("long")).drop("_limit")
    return df.withColumn(name, (value > F.lit(float(limit))).cast("long"))


def labeled(df: DataFrame, h: int) -> DataFrame:
    out = df.where(F.col(f"y_high_vol_{h}").isNotNull())
    if out.isEmpty():
        raise ValueError("no labeled rows")
    return out


def summary(df: DataFrame, h: int, mask: str = "used_for_label_threshold") -> DataFrame:
    """One row: label counts and rates, over all and over masked rows, and the spread of the value."""
    y, rv = F.col(f"y_high_vol_{h}"), F.col(f"future_rv_{h}")
    masked = F.col(mask)
    sums = df.agg(
        F.count(y).alias("labeled_rows"),
        F.count_if(y.isNull()).alias("unlabeled_rows"),
        F.count_if(y == 0).alias("low_rows"),
        F.count_if(y == 1).alias("high_rows"),
        F.avg(y).alias("positive_rate"),
        F.avg(F.when(masked, y)).alias("masked_positive_rate"),
        F.min(rv).alias("rv_min"),
        F.avg(rv).alias("rv_mean"),
        F.max(rv).alias("rv_max"),
    )
    median = threshold(df, h, 0.5, F.lit(True)).withColumnRenamed("threshold", "rv_median")  # one row
    return sums.crossJoin(F.broadcast(median))


def sensitivity(df: DataFrame, h: int, qs: list[float], mask: str = "used_for_label_threshold") -> DataFrame:
    """(quantile, threshold, train_rate, overall_rate) for each quantile."""
    rv = F.col(f"future_rv_{h}")
    limits = quantiles(df.where(mask), f"future_rv_{h}", qs).select(F.col("q").alias("quantile"), F.col("value").alias("threshold"))
    above = (rv > F.col("threshold")).cast("int")
    rated = df.where(rv.isNotNull()).select(rv, mask).crossJoin(F.broadcast(limits))  # a row per quantile
    return rated.groupBy("quantile", "threshold").agg(F.avg(F.when(F.col(mask), above)).alias("train_rate"), F.avg(above).alias("overall_rate"))


def missingness(df: DataFrame, h: int) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(f"future_return_{h}").isNull()).alias("missing_return"),
        F.count_if(F.col(f"future_rv_{h}").isNull()).alias("missing_rv"),
        F.lit(h).cast("long").alias("expected_missing"),
    )


def multiclass(df: DataFrame, h: int = 7, lower: float = -0.02, upper: float = 0.02, out: str = "regime") -> DataFrame:
    """-1, 0 or 1 by the return over h rows; 0 where it looks past the end."""
    move = ratio(F.lead("close", h).over(by_time()), F.col("close")) - 1
    return df.withColumn("_move", move).withColumn(out, F.when(F.col("_move") < lower, -1).when(F.col("_move") > upper, 1).otherwise(0)).drop("_move")


def multiclass_chunked(df: DataFrame, rows: int, h: int = 7, lower: float = -0.02, upper: float = 0.02, out: str = "regime") -> DataFrame:
    return chunks.in_chunks(df, 0, h, rows, lambda part: multiclass(part, h, lower, upper, out))


def alignment_check(df: DataFrame, h: int, row: int = 10, values: DataFrame | None = None) -> DataFrame:
    """(symbol, expected, actual, abs_diff) at one row: future_rv_h (of `values` where given, which has the rows of df) against a
    sum of named leads."""
    w = by_time()
    c = log(F.col("close"))
    squares = [(F.lead(c, k).over(w) - F.lead(c, k - 1).over(w)) for k in range(1, h + 1)]
    total = squares[0] * squares[0]
    for s in squares[1:]:
        total = total + s * s
    made = (future_values(df, h) if values is None else values).withColumns({"_expected": F.sqrt(total), "_at": F.row_number().over(w) - 1})
    actual = F.col(f"future_rv_{h}")
    return made.where(F.col("_at") == row).select("symbol", F.col("_expected").alias("expected"), actual.alias("actual"), F.abs(F.col("_expected") - actual).alias("abs_diff"))

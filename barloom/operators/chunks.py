"""Few symbols with very many rows: places of rows, and windows over bounded chunks of time, without a task that sorts a symbol."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, where: Column | None = None, row: str = "_row", n: str = "_n") -> DataFrame:
    """Adds row (how many rows of the symbol that satisfy `where` come before, in time) and n (how many the symbol has).

    Counts per symbol and day come first, and are small next to the rows; the order within a day gives the rest.
    """
    hit = F.lit(1) if where is None else F.when(where, 1).otherwise(0)
    timed = df.withColumns({"_day": F.date_trunc("day", "timestamp"), "_hit": hit})
    per_day = timed.groupBy("symbol", "_day").agg(F.sum("_hit").alias("_k"))
    each, upto = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    starts = per_day.select(F.col("symbol").alias("_s"), F.col("_day").alias("_d"), (F.sum("_k").over(upto) - F.col("_k")).alias("_before"), F.sum("_k").over(each).alias(n))
    joined = timed.join(starts, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("_day").eqNullSafe(F.col("_d")))
    today = Window.partitionBy("symbol", "_day").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(row, F.col("_before") + F.sum("_hit").over(today) - F.col("_hit")).select(*df.columns, row, n)


def in_chunks(df: DataFrame, before: int, after: int, rows: int, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """made(df), for a function whose windows by symbol and time reach at most `before` rows back and `after` rows ahead: time is
    cut into chunks of `rows` rows of a symbol, each with the rows around it that its frames reach, and made() sees each chunk as a
    symbol of its own."""
    if rows < 1 or before < 0 or after < 0:
        raise ValueError("a chunk needs rows, and frames don't reach a negative number of them")
    first, last = F.greatest(F.floor((F.col("_row") - after) / rows), F.lit(0)), F.least(F.floor((F.col("_row") + before) / rows), F.floor((F.col("_n") - 1) / rows))
    own = F.floor(F.col("_row") / rows)
    copies = placed(df).withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_core", F.col("_chunk") == own)
    key = F.concat_ws("\0", "symbol", F.col("_chunk").cast("string"))
    named = copies.withColumns({"_symbol": F.col("symbol"), "symbol": key}).drop("_row", "_n", "_chunk")
    return made(named).where("_core").withColumn("symbol", F.col("_symbol")).drop("_symbol", "_core")

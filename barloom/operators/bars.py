"""Bars: from events, from finer bars, and to canonical types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE = ("symbol", "timestamp", "open", "high", "low", "close", "volume")
OPTIONAL = ("quote_volume", "num_trades")
NUMBERS = ("open", "high", "low", "close", "volume", "quote_volume")


def event_sums(time: str, price: str, tie: str) -> list[Column]:
    """The aggregates of a bar of point events, of a batch or a stream."""
    at, value = F.struct(time, tie), F.col(price).cast("double")
    return [
        F.min_by(value, at).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, at).alias("close"),
        F.sum(value).alias("volume"),
        F.count(F.lit(1)).alias("num_trades"),
    ]


def from_events(events: DataFrame, symbol: str, time: str, price: str, tie: str, every: str = "1 hour") -> DataFrame:
    """Bars of point events: open and close are the first and last price by (time, tie), volume their sum. One shuffle, with
    partial aggregation before it."""
    grouped = events.groupBy(F.col(symbol).alias("symbol"), F.window(F.col(time).cast("timestamp_ntz"), every).alias("bucket")).agg(*event_sums(time, price, tie))
    return grouped.select("symbol", F.col("bucket.start").alias("timestamp"), "open", "high", "low", "close", "volume", "num_trades")


def resample(bars: DataFrame, every: str = "1 day") -> DataFrame:
    """Coarser bars: first, max, min, last, sum; buckets with any null are left out. Ties in time go by the open."""
    at = F.struct("timestamp", "open")
    made = bars.groupBy("symbol", F.window("timestamp", every).alias("bucket")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume")
    )
    return made.select("symbol", F.col("bucket.start").alias("timestamp"), "open", "high", "low", "close", "volume").na.drop()


def coerced(df: DataFrame) -> DataFrame:
    """Columns in their canonical types; what doesn't parse becomes null, NaN and infinities too. Other columns stay."""

    def parsed(name: str) -> Column:
        c = F.col(name)
        if name == "timestamp":
            kind = dict(df.dtypes)[name]
            return c if kind.startswith("timestamp") else F.try_to_timestamp(c.cast("string"))
        if name in NUMBERS:
            x = c.cast("string").try_cast("double")
            return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)
        return c.cast("string").try_cast("double").try_cast("long") if name == "num_trades" else c.cast("string")

    return df.withColumns({c: parsed(c) for c in (*CORE, *OPTIONAL) if c in df.columns})


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what}: missing columns {missing}")


def keep_first(df: DataFrame, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


def in_range(df: DataFrame, start=None, end=None, closed: bool = True, column: str = "timestamp") -> DataFrame:
    """Rows from start to end, the end included where closed; None leaves a side open. Pushed down to the scan."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        stop = F.lit(end).cast("timestamp_ntz")
        df = df.where(F.col(column) <= stop if closed else F.col(column) < stop)
    return df


def of_symbol(df: DataFrame, symbol: str | None) -> DataFrame:
    return df if symbol is None or "symbol" not in df.columns else df.where(F.col("symbol") == symbol)

"""An extension: bars of a stream of events, by event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import event_sums


def bars(events: DataFrame, symbol: str, time: str, price: str, tie: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The bars of barloom.operators.bars.from_events for a streaming table; events later than the watermark allows are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = timed.groupBy(F.col(symbol).alias("symbol"), F.window(time, every).alias("bucket")).agg(*event_sums(time, price, tie))
    return made.select("symbol", F.col("bucket.start").cast("timestamp_ntz").alias("timestamp"), "open", "high", "low", "close", "volume", "num_trades")

"""Split rows with their predictions, and the series that charts are drawn from."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.staging import run_folder
from barloom.sources.tables import artifacts, get_text, read_or_empty, with_times


def _unique(df: DataFrame, key: tuple[str, ...], side: str) -> DataFrame:
    """df; a key that it repeats raises when the rows are read. The count is dealt by key, as the join is."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    held = F.assert_true(F.col("_n") == 1, f"the {side} side repeats keys {key}")
    return df.withColumn("_n", n).where(held.isNull()).drop("_n")


def join_predictions(left: DataFrame, right: DataFrame | None, key: tuple[str, ...] = ("symbol", "timestamp"), one_to_one: bool = True) -> DataFrame:
    """Left join on the key. Columns of the right that the left has are dropped; repeated keys on either side raise when the rows are
    read; without a right side, or without the key on both, the left comes back."""
    if right is None or any(k not in left.columns or k not in right.columns for k in key):
        return left
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in key])
    if one_to_one:
        left, right = _unique(left, key, "left"), _unique(right, key, "right")
    return left.join(right, list(key), "left")


def write_buckets(df: DataFrame, name: str, buckets: int, path: str | None = None, key: tuple[str, str] = ("symbol", "timestamp")) -> None:
    """df as a table in buckets by its key, each sorted by it: at path, in the folder of this run unless given. The time is part of the
    key, so a symbol of many rows is in all buckets; a bucket is one file."""
    place = path or f"{run_folder(df.sparkSession)}/buckets-{uuid.uuid4().hex}"
    df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).option("path", place).mode("overwrite").saveAsTable(name)


def join_buckets(spark: SparkSession, left: str, right: str, key: tuple[str, str] = ("symbol", "timestamp")) -> DataFrame:
    """join_predictions() of two tables of write_buckets() with as many buckets: neither side is dealt again, and repeated keys are
    counted within their bucket. Rows with a null symbol or time stay, and meet none."""
    a, b = spark.table(left), spark.table(right)
    b = b.drop(*[c for c in b.columns if c in a.columns and c not in key])
    return _unique(a, key, "left").join(_unique(b, key, "right").hint("merge"), list(key), "left").select(*a.columns, *[c for c in b.columns if c not in key])


def load_artifacts(spark: SparkSession, paths: dict[str, str], columns: dict[str, str] | None = None) -> dict:
    """Everything that a view of a run reads, missing files tolerated: split_df, prediction_df, timeline_df (both joined), metrics_df, side
    files as they are, and which paths are there."""
    names = {"timestamp": "timestamp", "symbol": "symbol"} | (columns or {})
    split = with_times(read_or_empty(spark, paths.get("split_data_path")), column=names["timestamp"])
    predictions = with_times(read_or_empty(spark, paths.get("prediction_path")), column=names["timestamp"])
    out = {
        "split_df": split,
        "prediction_df": predictions,
        "timeline_df": join_predictions(split, predictions, (names["symbol"], names["timestamp"])),
        "metrics_df": read_or_empty(spark, paths.get("evaluation_metrics_table_path")),
        "monitoring_report": get_text(spark, paths.get("monitoring_report_path", "")),
        "artifact_status": artifacts(spark, paths),
    }
    for name in ("monitoring_summary", "feature_schema", "label_config", "split_manifest", "training_summary"):
        text = get_text(spark, paths.get(f"{name}_path", ""))
        out[name] = json.loads(text) if text else {}
    return out


def monitoring_rows(spark: SparkSession, summary: dict) -> DataFrame:
    """(check, status, details): freshness, feature drift and prediction drift of a monitoring summary, those that it has."""
    rows = []
    if fresh := summary.get("freshness"):
        rows.append(("data_freshness", "passed" if fresh.get("passed") else "failed", f"missing_intervals={fresh.get('total_missing_interval_count')}"))
    if drift := summary.get("feature_drift"):
        rows.append(("feature_drift", "available", str(drift.get("severity_counts"))))
    if scores := summary.get("prediction_drift"):
        rows.append(("prediction_drift", scores.get("severity", "unknown"), f"psi={scores.get('psi')}"))
    return spark.createDataFrame(rows, "check string, status string, details string")


def series(df: DataFrame, columns: list[str], threshold: float | None = None) -> DataFrame:
    """Columns in order of time, with the threshold as a column where one is given."""
    made = df.select("timestamp", *columns)
    return (made if threshold is None else made.withColumn("threshold", F.lit(float(threshold)))).orderBy("timestamp")


def overlay(df: DataFrame, target: str) -> DataFrame:
    """Rows of a timeline where the target holds."""
    return df.where(F.col(target) == 1)


def metric_bars(metrics: DataFrame, metric: str, model: str = "model_name", split: str = "split") -> DataFrame:
    value = F.col(f"`{metric}`").cast("string").try_cast("double")
    return metrics.select(model, split, value.alias(metric)).where(value.isNotNull())


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), split)


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))

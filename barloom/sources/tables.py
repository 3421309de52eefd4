"""Readers and writers by suffix, and small side files on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _place(spark: SparkSession, path: str):
    """The path, and the file system that it belongs to, local or not."""
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small side file, on whatever file system the path names."""
    place, system = _place(spark, path)
    out = system.create(place, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def get_text(spark: SparkSession, path: str, missing: str | None = None) -> str | None:
    if not path or not _exists(spark, path):
        return missing
    place, system = _place(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_of(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted."""
    place, system = _place(spark, pattern)
    return sorted(str(f.getPath().toString()) for f in system.globStatus(place) or [])


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Parquet or CSV by suffix. Other suffixes and missing paths raise."""
    kind = Path(str(path)).suffix.lower()
    if kind not in (".parquet", ".csv"):
        raise ValueError(f"neither .parquet nor .csv: {path}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == ".csv":
        reader = reader.options(**({"header": True, "inferSchema": True} | options))
    return reader.parquet(str(path)) if kind == ".parquet" else reader.csv(str(path))


def read_or_empty(spark: SparkSession, path: str | None, schema: T.StructType | str = "symbol string, timestamp timestamp") -> DataFrame:
    """An empty table where the path is blank or missing."""
    if not path or not str(path).strip() or not _exists(spark, path) or Path(str(path)).suffix.lower() not in (".parquet", ".csv"):
        return spark.createDataFrame([], schema)
    return read(spark, path)


def with_times(df: DataFrame, strict: bool = False, column: str = "timestamp") -> DataFrame:
    """Times as UTC timestamps. What doesn't parse is null, or with strict raises when it is read."""
    if column not in df.columns:
        return df
    parsed = F.col(column).cast("timestamp_ntz") if dict(df.dtypes)[column].startswith("timestamp") else F.try_to_timestamp(F.col(column).cast("string")).cast("timestamp_ntz")
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a time: "), F.col(column).cast("string"))).cast("timestamp_ntz")
        parsed = F.when(parsed.isNull() & F.col(column).isNotNull(), bad).otherwise(parsed)
    return df.withColumn(column, parsed)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A table of splits; times that don't parse are null."""
    return with_times(read(spark, path))


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Bars for prediction; times that don't parse raise."""
    return with_times(read(spark, path), strict=True)


def with_arrival(df: DataFrame) -> DataFrame:
    """Adds _ingest_order: file order, then order within the file. Taken at the scan, before any shuffle."""
    return df.withColumn("_ingest_order", F.monotonically_increasing_id())


def write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet (partitioned where asked) or CSV by suffix."""
    kind = Path(str(path)).suffix.lower()
    writer = df.write.mode("overwrite")
    if kind == ".parquet":
        (writer.partitionBy(*by) if by else writer).parquet(str(path))
    elif kind == ".csv":
        writer.option("header", True).csv(str(path))
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")


def _side_text(path: str | None) -> str | None:
    """A small file on the file system that the path names; without a session, on the local disk."""
    spark = SparkSession.getActiveSession()
    if not path:
        return None
    return get_text(spark, str(path)) if spark else Path(path).read_text() if Path(path).is_file() else None


def read_config(path: str) -> dict:
    """A JSON or YAML mapping, on any file system."""
    text = _side_text(path)
    if text is None:
        raise FileNotFoundError(path)
    if str(path).endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"not a mapping: {path}")
    return found


def read_json(path: str | None, missing: object = None) -> object:
    text = _side_text(path)
    return missing if text is None else json.loads(text)


def read_text(path: str | None, missing: str | None = None) -> str | None:
    text = _side_text(path)
    return missing if text is None else text


def write_json(path: str, value: object) -> None:
    """With the folders that it needs, on any file system; without a session on the local disk."""
    text, spark = json.dumps(plain(value), indent=2, default=str), SparkSession.getActiveSession()
    if spark:
        put_text(spark, str(path), text)
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)


def plain(value: object) -> object:
    """JSON-safe: NaN and infinities become None, tables are left out."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items() if not isinstance(v, DataFrame)}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value if not isinstance(v, DataFrame)]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def artifacts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(artifact, path, there)."""
    rows = [(k, str(p), bool(p) and _exists(spark, p)) for k, p in paths.items()]
    return spark.createDataFrame(rows, "artifact string, path string, there boolean")


def processed_path(symbol: str, interval: str, start: str, end: str, folder: str) -> str:
    return f"{folder}/{symbol}_{interval}_{start[:10]}_{end[:10]}_processed.parquet"


def report(title: str, sections: dict[str, DataFrame | dict | str], most: int = 50) -> str:
    """A Markdown report: tables are cut at `most` rows with a note, mappings become lists."""
    lines = [f"# {title}", ""]
    for name, body in sections.items():
        if isinstance(body, DataFrame):
            text = to_markdown(body, most)
        elif isinstance(body, dict):
            text = "\n".join(f"- {k}: {v}" for k, v in plain(body).items()) or "None."
        else:
            text = str(body)
        lines += [f"## {name}", "", text, ""]
    return "\n".join(lines)


def to_markdown(df: DataFrame, most: int = 50) -> str:
    """The first rows as a Markdown table, with a note where more were left out."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"\nOnly the first {most} rows are shown."] if len(rows) > most else []))

"""Raw exchange bars ("klines"): monthly archives, pages of a REST endpoint, and their canonical form.

There is no network here: archives are read from where they are staged, and pages come from a function that is passed in.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import clean, interval_seconds
from barloom.operators.bars import CORE, OPTIONAL, keep_first
from barloom.operators.quality import globally_sorted
from barloom.sources import tables
from barloom.sources.staging import staged

#: Columns of the archives, by position, and where a host keeps them.
RAW = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades", "taker_buy_base_volume", "taker_buy_quote_volume", "ignore")
ARCHIVES = "data/spot/monthly/klines"
RAW_SCHEMA = ", ".join(f"{c} string" for c in RAW) + ", _ingest_order long"
#: A median above this is in microseconds.
MICROSECONDS_FROM = 1e14


def parse_utc(text: str | datetime) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00")) if isinstance(text, str) else text
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def months(start: str | datetime, end: str | datetime) -> list[tuple[int, int]]:
    """(year, month) that [start, end) touches."""
    a, b = parse_utc(start), parse_utc(end) - timedelta(microseconds=1)
    first, last = a.year * 12 + a.month - 1, b.year * 12 + b.month - 1
    return [(m // 12, m % 12 + 1) for m in range(first, last + 1)]


def month_table(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(month): the first of each month that [start, end) touches."""
    a, b = (F.lit(parse_utc(x).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz") for x in (start, end))
    last = F.date_trunc("month", b - F.make_dt_interval(secs=F.lit(0.000001)))
    return spark.range(1).select(F.explode(F.sequence(F.date_trunc("month", a), last, F.make_ym_interval(months=F.lit(1)))).alias("month"))


def archive_url(base: str, symbol: str, interval: str, year: int, month: int) -> str:
    return f"{base.rstrip('/')}/{ARCHIVES}/{symbol}/{interval}/{archive_name(symbol, interval, year, month)}"


def archive_name(symbol: str, interval: str, year: int, month: int) -> str:
    return f"{symbol}-{interval}-{year}-{month:02d}.zip"


def unzip_rows(content: bytes) -> list[list[str]]:
    """Rows of the first CSV in a ZIP, without a header line; rows of another width raise."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".csv")]
        if not names:
            raise ValueError("the archive holds no CSV file")
        lines = z.read(names[0]).decode("utf-8-sig").splitlines()
    rows = [x.split(",") for x in lines if x.strip()]
    if rows and rows[0][0].strip().lower() == RAW[0]:
        rows = rows[1:]
    if bad := next((r for r in rows if len(r) != len(RAW)), None):
        raise ValueError(f"{len(bad)} columns instead of {len(RAW)}")
    return rows


def read_archives(spark: SparkSession, path: str, symbol: str, interval: str, start: str, end: str) -> DataFrame:
    """Raw rows of the symbol's months that [start, end) touches, wherever below path they are staged: other files are not opened.
    A month that isn't there raises. A task reads one archive at a time; rows come in order of month, then of their file."""
    wanted = [archive_name(symbol, interval, y, m) for y, m in months(start, end)]
    plain = [re.sub(r"([\\*?{}\[\],])", r"\\\1", n) for n in wanted]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(plain) + "}").option("recursiveFileLookup", True).load(path)
    there = {unquote(f).rsplit("/", 1)[-1] for f in files.inputFiles()}  # one name per month
    if gone := [n for n in wanted if n not in there]:
        raise FileNotFoundError(f"archives that are not below {path}: {gone}")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = unzip_rows(content)
                columns = list(zip(*rows, strict=True)) or [()] * len(RAW)
                year, month = re.search(r"-(\d{4})-(\d\d)\.zip$", name).groups()
                order = pa.array([(int(year) * 12 + int(month) << 32) + k for k in range(len(rows))], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), order], names=[*RAW, "_ingest_order"])

    return files.select("path", "content").mapInArrow(run, RAW_SCHEMA)


def pages(fetch: Callable[[int, int, int], list[list]], interval: str, start: str, end: str, limit: int = 1000) -> Iterator[list]:
    """Rows page by page from fetch(start_ms, end_ms, limit); the next page starts an interval after the last row. A page that
    doesn't move on raises. The last page may hold a bar that opens exactly at the end."""
    at, stop = (int(parse_utc(x).timestamp() * 1000) for x in (start, end))
    while at < stop:
        rows = fetch(at, stop, limit)
        if not rows:
            return
        yield from rows
        after = int(rows[-1][0]) + interval_seconds(interval) * 1000
        if after <= at:
            raise RuntimeError("the pages don't move on")
        at = after


def raw_table(spark: SparkSession, rows: list[list]) -> DataFrame:
    """Rows that are at hand as a table, in their order."""
    return spark.createDataFrame([(*map(str, r), k) for k, r in enumerate(rows)], RAW_SCHEMA)


def read_pages(spark: SparkSession, fetch: Callable[[int, int, int], list[list]], interval: str, start: str, end: str, limit: int = 1000) -> DataFrame:
    """Raw rows of [start, end) from pages: each month is fetched by a task of its own, and nothing passes through the driver.
    A bar that opens exactly where a month ends can come twice; canonical() keeps the first."""
    a, b = (parse_utc(x).replace(tzinfo=None).isoformat(sep=" ") for x in (start, end))
    bounds = month_table(spark, start, end).select(
        F.greatest("month", F.lit(a).cast("timestamp_ntz")).cast("string").alias("a"),
        F.least(F.col("month") + F.make_ym_interval(months=F.lit(1)), F.lit(b).cast("timestamp_ntz")).cast("string").alias("b"),
    )
    n = len(months(start, end))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = parse_utc(first)
                rows = [[str(x) for x in r] for r in pages(fetch, interval, first, last, limit)]
                columns = list(zip(*rows, strict=True)) or [()] * len(RAW)
                order = pa.array([(at.year * 12 + at.month << 32) + k for k in range(len(rows))], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), order], names=[*RAW, "_ingest_order"])

    return bounds.repartition(max(n, 1)).mapInArrow(run, RAW_SCHEMA)


def canonical(raw: DataFrame, symbol: str, per_row_unit: bool = False) -> DataFrame:
    """Nine columns, the first of each (symbol, timestamp) in order of arrival. A symbol column of the raw table stays; where it is
    missing or null, `symbol` is taken. The unit of time follows from the median of the whole table, or with per_row_unit from
    each row. The order of arrival, _ingest_order, is taken at the scan: without it this raises."""
    if "_ingest_order" not in raw.columns:
        raise ValueError("the raw table has no _ingest_order: add it at the scan, by with_arrival()")
    opened = F.col("open_time").cast("string").try_cast("double").try_cast("long")
    rows = raw.withColumn("_t", opened)
    micro = F.col("_t") > MICROSECONDS_FROM if per_row_unit else F.col("_micro")
    if not per_row_unit:
        # whether the median is above, from counts; halfway it is the mean of the two values in the middle
        late = F.col("_t") > MICROSECONDS_FROM
        sums = rows.agg(F.count("_t").alias("n"), F.count_if(late).alias("late"), F.max(F.when(~late, F.col("_t"))).alias("low"), F.min(F.when(late, F.col("_t"))).alias("high"))
        above = F.when(2 * F.col("late") == F.col("n"), (F.col("low") + F.col("high")) / 2 > MICROSECONDS_FROM).otherwise(2 * F.col("late") > F.col("n"))
        rows = rows.crossJoin(F.broadcast(sums.select(F.coalesce(above, F.lit(False)).alias("_micro"))))  # an aggregate: one row
    number = lambda c: clean(F.col(c).cast("string").try_cast("double"))
    own = F.coalesce(F.col("symbol").cast("string"), F.lit(symbol)) if "symbol" in raw.columns else F.lit(symbol)
    made = rows.select(
        own.alias("symbol"),
        F.when(micro, F.timestamp_micros("_t")).otherwise(F.timestamp_millis("_t")).cast("timestamp_ntz").alias("timestamp"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
        number("quote_asset_volume").alias("quote_volume"),
        number("number_of_trades").try_cast("long").alias("num_trades"),
        "_ingest_order",
    )
    return keep_first(made, ("symbol", "timestamp"), [F.col("_ingest_order")]).drop("_ingest_order")


def check_sums(columns: list[str]) -> dict[str, Column]:
    """What ingestion_checks() adds up, as aggregates: they can be observed while rows are written."""
    if missing := [c for c in (*CORE, *OPTIONAL) if c not in columns]:
        raise ValueError(f"missing columns: {missing}")
    prices = F.least("open", "high", "low", "close")
    return {
        "n": F.count(F.lit(1)),
        "nulls": F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in CORE]) == 1),
        "low": F.count_if(prices <= 0),
        "negative": F.count_if(F.col("volume") < 0),
        "first": F.min("timestamp"),
        "last": F.max("timestamp"),
    }


def raise_unless_sound(sums: dict) -> None:
    if not sums.get("n") or sums["nulls"] or sums["low"] or sums["negative"]:
        raise ValueError(f"{sums.get('n', 0)} rows, {sums.get('nulls', 0)} with nulls, {sums.get('low', 0)} with prices at or below 0, {sums.get('negative', 0)} with negative volumes")


def ingestion_checks(bars: DataFrame, order: str | None = None) -> None:
    """Raises on missing columns, an empty table, nulls in core columns, prices at or below 0, negative volumes, repeated keys, and
    where a column of order is named on a row that is earlier than the one before it."""
    raise_unless_sound(bars.agg(*[c.alias(k) for k, c in check_sums(bars.columns).items()]).first().asDict())
    if not bars.groupBy("symbol", "timestamp").count().where("count > 1").isEmpty():
        raise ValueError("repeated keys")
    if order is not None and not globally_sorted(bars, order).first()[0]:
        raise ValueError("rows are not in order of time")


def raw_bars(spark: SparkSession, symbol: str, interval: str, start: str, end: str, archives: str | None, fetch=None) -> tuple[DataFrame, str]:
    """Raw rows of [start, end) with their symbol, and their source: from staged archives where all months are there and have rows in
    the range, else from pages, else it raises."""
    a, b = (parse_utc(x).timestamp() for x in (start, end))
    why = "no archives"
    if archives is not None:
        try:
            raw = read_archives(spark, archives, symbol, interval, start, end)
        except (FileNotFoundError, AnalysisException) as e:
            why = str(e)
        else:
            t = F.col("open_time").try_cast("double").try_cast("long")
            seconds = t / F.when(t > MICROSECONDS_FROM, 1e6).otherwise(1e3)
            raw = raw.where((seconds >= a) & (seconds < b)).withColumn("symbol", F.lit(symbol))
            if not raw.isEmpty():
                return raw, "archives"
            why = "no rows in the range"
    if fetch is None:
        raise ValueError(f"{why}, and no pages")
    return read_pages(spark, fetch, interval, start, end).withColumn("symbol", F.lit(symbol)), "pages"


def ingest(spark: SparkSession, symbol: str, interval: str, start: str, end: str, archives: str | None, fetch=None) -> DataFrame:
    """Canonical bars of [start, end)."""
    return canonical(raw_bars(spark, symbol, interval, start, end, archives, fetch)[0], symbol)


def run_ingestion(spark: SparkSession, config: dict, fetch=None) -> dict:
    """Raw rows as CSV, canonical bars in order of time as Parquet after the checks, and a summary. config: symbol, interval,
    start_utc, end_utc, raw_dir, processed_dir, archives (where they are staged), use_pages."""
    symbol, interval, start, end = (str(config[k]) for k in ("symbol", "interval", "start_utc", "end_utc"))
    raw, source = raw_bars(spark, symbol, interval, start, end, config.get("archives"), fetch if config.get("use_pages", True) else None)
    processed = tables.processed_path(symbol, interval, start, end, str(config["processed_dir"]))
    raw_path = f"{str(config['raw_dir']).rstrip('/')}/{symbol}_{interval}_{start[:10]}_{end[:10]}_raw.csv"
    tables.write(raw, raw_path)
    # what was written is read: archives and pages are opened once
    kept = tables.read(spark, raw_path, RAW_SCHEMA + ", symbol string", header=True)
    # the checks are added up while the canonical rows are written; their keys differ, as the first of each key is kept
    made, seen = canonical(kept, symbol), Observation()
    bars = staged(made.observe(seen, *[c.alias(k) for k, c in check_sums(made.columns).items()]), "canonical")
    row = seen.get
    raise_unless_sound(row)
    tables.write(bars.repartitionByRange("timestamp").sortWithinPartitions("timestamp"), processed)
    return {
        "data_source": source, "symbol": symbol, "interval": interval, "raw_path": raw_path, "processed_path": processed,
        "num_rows": row["n"], "start_timestamp": str(row["first"]), "end_timestamp": str(row["last"]), "columns": bars.columns,
    }

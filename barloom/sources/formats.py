"""Exchange bars as data sources of Spark: `klines` reads staged monthly archives, `kline_pages` reads or follows an endpoint by pages.

    register(spark)
    spark.read.format("klines").option("path", "/staged").load().where("symbol = 'BTCUSDT' AND timestamp >= '2024-02-01'")
    spark.readStream.format("kline_pages").options(symbol="BTCUSDT", interval="5m", fetch="my_module:fetch", start="2024-01-01").load()

A partition is a month of a symbol. The options symbols (comma-separated), from and to name what is wanted: other months are not
opened. With the option push_filters, and spark.sql.python.filterPushdown.enabled, filters on symbol and time do the same; Spark 4.1
then keeps what was pushed with the loaded table, so each query has to load its own. A stream's offset is the open time up to
which it has read: it goes on from there, without a gap or a repeat.
"""

from __future__ import annotations

import importlib
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from barloom.functions.columns import interval_seconds
from barloom.sources.klines import MICROSECONDS_FROM, RAW, months, pages, parse_utc, unzip_rows

SCHEMA = "symbol string, timestamp timestamp_ntz, " + ", ".join(f"{c} string" for c in RAW) + ", _ingest_order long"
_NAME = re.compile(r"(?:^|/)([^/]+)-([0-9]+[mhd])-(\d{4})-(\d\d)\.zip$")


def register(spark: SparkSession) -> None:
    for source in (KlineArchives, KlinePages):
        spark.dataSource.register(source)


@dataclass
class Month(InputPartition):
    """A month of a symbol: the archive that has it, or the open times in milliseconds that are asked for."""

    symbol: str
    year: int
    month: int
    path: str = ""
    first: int = 0
    last: int = 0

    @property
    def starts(self) -> datetime:
        return datetime(self.year, self.month, 1)

    @property
    def ends(self) -> datetime:
        return datetime(self.year + self.month // 12, self.month % 12 + 1, 1)


def batch_of(rows: list[list[str]], symbol: str, year: int, month: int) -> pa.RecordBatch:
    """Raw rows with their symbol, their time (null where the text is none) and their place."""
    columns = list(zip(*rows, strict=True)) or [()] * len(RAW)
    at = []
    for text in columns[0]:
        try:
            t = int(float(text))
            at.append(t if t > MICROSECONDS_FROM else 1000 * t)
        except (TypeError, ValueError, OverflowError):
            at.append(None)
    order = pa.array([((year * 12 + month) << 32) + k for k in range(len(rows))], pa.int64())
    arrays = [pa.array([symbol] * len(rows), pa.string()), pa.array(at, pa.timestamp("us")), *(pa.array(c, pa.string()) for c in columns), order]
    return pa.RecordBatch.from_arrays(arrays, names=["symbol", "timestamp", *RAW, "_ingest_order"])


class _Narrowed:
    """What is wanted of symbols and times: whole months here."""

    symbols: frozenset[str] | None = None
    after: datetime | None = None
    before: datetime | None = None

    def narrowed_by(self, options: dict) -> None:
        """By the options symbols, from and to (both included)."""
        if options.get("symbols"):
            self.symbols = frozenset(x.strip() for x in options["symbols"].split(","))
        self.asked = self.after, self.before = tuple(parse_utc(options[k]).replace(tzinfo=None) if options.get(k) else None for k in ("from", "to"))

    def exact(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Without rows outside the options' times; rows without a time stay where none are asked for."""
        keep = None
        for limit, test in ((self.asked[0], pc.greater_equal), (self.asked[1], pc.less_equal)):
            if limit is not None:
                mask = test(batch.column("timestamp"), pa.scalar(limit, pa.timestamp("us")))
                keep = mask if keep is None else pc.and_(keep, mask)
        return batch if keep is None else batch.filter(keep)

    def wanted(self, part: Month) -> bool:
        if self.symbols is not None and part.symbol not in self.symbols:
            return False
        return (self.after is None or part.ends > self.after) and (self.before is None or part.starts <= self.before)


class _Pushed:
    """Takes filters as further limits."""

    def pushFilters(self, filters):
        for f in filters:
            if len(f.attribute if hasattr(f, "attribute") else ()) == 1:
                self._narrow(f)
            yield f  # rows are filtered by Spark as well

    def _narrow(self, f) -> None:
        column, value = f.attribute[0], getattr(f, "value", None)
        if column == "symbol" and isinstance(f, EqualTo | In):
            some = frozenset([value] if isinstance(f, EqualTo) else value)
            self.symbols = some if self.symbols is None else self.symbols & some
        if column == "timestamp" and isinstance(value, datetime):
            value = value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.after = value if self.after is None else max(self.after, value)
            if isinstance(f, LessThan):
                value -= timedelta(microseconds=1)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.before = value if self.before is None else min(self.before, value)


class ArchiveReader(_Narrowed, DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.interval = options.get("path"), options.get("interval")
        if not self.path:
            raise ValueError("klines needs a path")
        self.narrowed_by(options)

    def partitions(self) -> list[Month]:
        files, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = []
        for info in files.get_file_info(fs.FileSelector(base, recursive=True)):
            name = _NAME.search(info.path)
            if info.type == fs.FileType.File and name and self.interval in (None, name[2]):
                part = Month(name[1], int(name[3]), int(name[4]), info.path)
                if self.wanted(part):
                    found.append(part)
        return sorted(found, key=lambda p: (p.symbol, p.year, p.month, p.path)) or [Month("", 1, 1)]

    def read(self, partition: Month) -> Iterator[pa.RecordBatch]:
        if partition.path:
            files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
            with files.open_input_stream(partition.path, compression=None) as f:
                yield self.exact(batch_of(unzip_rows(f.read()), partition.symbol, partition.year, partition.month))


class PushedArchiveReader(_Pushed, ArchiveReader):
    pass


class KlineArchives(DataSource):
    """Options: path (a folder on a file system that pyarrow knows), and interval where only one is wanted."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return (PushedArchiveReader if self.options.get("push_filters") == "true" else ArchiveReader)(self.options)


def _millis(at: datetime) -> int:
    return (at.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


class _Pages:
    """Options: symbol, interval, start, end (now unless given), fetch as module:function of (symbol, start_ms, end_ms, limit), limit."""

    def __init__(self, options: dict):
        if missing := [k for k in ("symbol", "interval", "start", "fetch") if not options.get(k)]:
            raise ValueError(f"kline_pages needs {missing}")
        self.symbol, self.interval, self.limit = options["symbol"], options["interval"], int(options.get("limit", 1000))
        self.module, _, self.function = options["fetch"].partition(":")
        self.step = interval_seconds(self.interval) * 1000
        self.start, self.end = options["start"], options.get("end")

    def now(self) -> int:
        """The end, or the start of the bar that is not closed yet."""
        most = _millis(parse_utc(self.end).replace(tzinfo=None)) if self.end else int(time.time() * 1000)
        return most // self.step * self.step

    def split(self, first: int, last: int) -> list[Month]:
        """By month, so that tasks fetch them side by side."""
        if first >= last:
            return []
        a, b = (datetime.fromtimestamp(x / 1000, UTC) for x in (first, last))
        parts = [Month(self.symbol, y, m) for y, m in months(a, b)]
        return [Month(p.symbol, p.year, p.month, first=max(first, _millis(p.starts)), last=min(last, _millis(p.ends))) for p in parts]

    def fetched(self, part: Month) -> Iterator[pa.RecordBatch]:
        fetch = getattr(importlib.import_module(self.module), self.function)
        a, b = (datetime.fromtimestamp(x / 1000, UTC).isoformat() for x in (part.first, part.last))
        rows = [[str(x) for x in r] for r in pages(lambda *args: fetch(self.symbol, *args), self.interval, a, b, self.limit)]
        # an endpoint may give the bar that opens at the end: it belongs to the next part
        yield batch_of([r for r in rows if part.first <= int(r[0]) < part.last], part.symbol, part.year, part.month)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def partitions(self) -> list[Month]:
        return self.pages.split(_millis(parse_utc(self.pages.start).replace(tzinfo=None)), self.pages.now()) or [Month("", 1, 1)]

    def read(self, partition: Month) -> Iterator[pa.RecordBatch]:
        if partition.symbol:
            yield from self.pages.fetched(partition)


class PageStream(DataSourceStreamReader):
    """The offset is the open time in milliseconds up to which bars were read."""

    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return {"at": _millis(parse_utc(self.pages.start).replace(tzinfo=None))}

    def latestOffset(self) -> dict:
        return {"at": max(self.pages.now(), self.initialOffset()["at"])}

    def partitions(self, start: dict, end: dict) -> list[Month]:
        return self.pages.split(start["at"], end["at"])

    def read(self, partition: Month) -> Iterator[pa.RecordBatch]:
        return self.pages.fetched(partition)

    def commit(self, end: dict) -> None:
        pass


class KlinePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kline_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)

"""Data sources for archives and pages: what is opened, what is read, and how a stream goes on."""

import io
import sys
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from barloom.sources import formats, klines

HELPER = '''
STEP = 3600_000

def fetch(symbol, start, end, limit):
    """Bars on the hour; as some endpoints do, the one that opens at the end is among them."""
    first = -(-start // STEP) * STEP
    return [[t, "1", "2", "0.5", "1.5", "10", t + STEP - 1, "15", "3", "1", "1", "0"] for t in range(first, end + 1, STEP)][:limit]
'''


def archive(folder, symbol, interval, year, month, rows):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x.csv", "\n".join(",".join([str(t), "1", "2", "0.5", "1.5", "10", str(t + 1), "15", "3", "1", "1", "0"]) for t in rows))
    path = folder / symbol / interval / klines.archive_name(symbol, interval, year, month)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data.getvalue())
    return path


def millis(*at):
    return int(datetime(*at, tzinfo=UTC).timestamp() * 1000)


@pytest.fixture
def staged(spark, tmp_path):
    formats.register(spark)
    for symbol in ("AAA", "B-B"):
        for month in (1, 2, 3):
            archive(tmp_path, symbol, "1h", 2024, month, [millis(2024, month, 5, h) * (1000 if month == 3 else 1) for h in range(4)])
    archive(tmp_path, "AAA", "5m", 2024, 1, [millis(2024, 1, 5)])
    (tmp_path / "notes.txt").write_text("no archive")
    return tmp_path


def load(spark, folder, **options):
    return spark.read.format("klines").options(path=str(folder), interval="1h", **options).load()


def test_archives_are_read_by_month(spark, staged):
    df = load(spark, staged)
    assert df.rdd.getNumPartitions() == 6 and df.count() == 24
    canonical = klines.canonical(df, "none", per_row_unit=True)
    assert canonical.count() == 24 and canonical.columns[:3] == ["symbol", "timestamp", "open"]
    got = load(spark, staged).where("symbol = 'B-B' AND timestamp >= '2024-02-05 02:00:00'").orderBy("timestamp").select("timestamp", "open", "_ingest_order").collect()
    assert [str(r[0]) for r in got] == ["2024-02-05 02:00:00", "2024-02-05 03:00:00", *[f"2024-03-05 0{h}:00:00" for h in range(4)]]
    assert [r[2] for r in got] == sorted(r[2] for r in got)
    assert spark.read.format("klines").option("path", str(staged)).load().where("timestamp = '2024-01-05'").count() == 3


def test_options_open_only_their_months(spark, staged):
    broken = archive(staged, "AAA", "1h", 2023, 1, [])
    broken.write_bytes(b"no zip at all")  # opened, it would raise
    some = load(spark, staged, symbols="AAA, ZZ", **{"from": "2024-02-05T01:00:00", "to": "2024-03-05T00:00:00Z"})
    assert some.rdd.getNumPartitions() == 2 and some.count() == 4
    assert load(spark, staged, symbols="B-B").count() == 12 and load(spark, staged, symbols="none").count() == 0
    with pytest.raises(Exception, match="zip"):
        load(spark, staged).count()


def test_filters_open_only_their_months(spark, staged):
    broken = archive(staged, "AAA", "1h", 2023, 1, [])
    broken.write_bytes(b"no zip at all")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = lambda: load(spark, staged, push_filters="true")
        some = pushed().where("symbol IN ('AAA', 'ZZ') AND timestamp >= '2024-02-01' AND timestamp < '2024-03-01'")
        assert some.rdd.getNumPartitions() == 1 and some.count() == 4
        assert pushed().where("symbol = 'B-B'").count() == 12 and pushed().where("symbol = 'none'").count() == 0
        assert pushed().where(F.col("timestamp") > datetime(2024, 3, 5, 1)).count() == 4
        df = load(spark, staged, symbols="B-B")  # without the option nothing stays behind
        assert df.where("timestamp < '2024-02-01'").count() == 4 and df.count() == 12
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    broken.unlink()
    again = load(spark, staged).where("symbol = 'AAA' AND timestamp < '2024-02-01'")
    assert again.rdd.getNumPartitions() == 6 and again.count() == 4


def test_empty_folder_and_missing_options(spark, tmp_path):
    formats.register(spark)
    assert spark.read.format("klines").option("path", str(tmp_path)).load().count() == 0
    for name in ("klines", "kline_pages"):
        with pytest.raises(Exception, match="needs"):
            spark.read.format(name).load().count()


@pytest.fixture
def endpoint(spark, tmp_path):
    (tmp_path / "barloom_test_pages.py").write_text(HELPER)
    spark.sparkContext.addPyFile(str(tmp_path / "barloom_test_pages.py"))
    sys.path.insert(0, str(tmp_path))
    formats.register(spark)
    made = lambda read, end: read.format("kline_pages").options(symbol="S", interval="1h", fetch="barloom_test_pages:fetch", start="2024-01-30T00:00:00Z", end=end, limit="10")
    yield made
    sys.path.remove(str(tmp_path))


def test_pages_as_a_batch(spark, endpoint):
    df = endpoint(spark.read, "2024-02-02T00:00:00Z").load()
    assert df.rdd.getNumPartitions() == 2  # January and February
    times = sorted(str(r.timestamp) for r in df.select("timestamp").collect())
    assert len(times) == 72 == len(set(times)) and times[0] == "2024-01-30 00:00:00" and times[-1] == "2024-02-01 23:00:00"


def test_a_stopped_stream_goes_on(spark, endpoint, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    seen = []
    for end in ("2024-01-31T05:00:00Z", "2024-01-31T05:30:00Z", "2024-02-03T01:00:00Z"):
        stream = endpoint(spark.readStream, end).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        stream.processAllAvailable()
        stream.stop()
        seen.append(spark.read.parquet(out).count())
    times = sorted(str(r.timestamp) for r in spark.read.parquet(out).select("timestamp").collect())
    assert seen == [29, 29, 97] and len(set(times)) == 97 and times[-1] == "2024-02-03 00:00:00"

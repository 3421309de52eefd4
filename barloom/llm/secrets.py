"""Secret scans over an incremental blob ledger.

A blob is the content of a version of a path, named by its SHA-256. The ledger is a Parquet table in the shared folder with one
row for each blob and rule version that has been scanned. A scan names the versions of a table, sets aside the names that the
ledger has under this rule version, and only then reads the bodies of the others: each is scanned once and appended. Findings are
joined back from the ledger to all paths. Of seen blobs nothing but the name crosses the network.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import spans as S
from barloom.llm.common import partitions, scratch, small, through_table

#: Change it with any rule: blobs are then scanned anew.
RULE_VERSION = "2"
LEDGER = "blob string, rule_version string, scan string, base string, spans string"

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:(?!-----)[\s\S])*+(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")


def more(text: str, base: list[S.Span]) -> list[S.Span]:
    """Spans beside the base ones: whole private keys in armour."""
    if "PRIVATE KEY-----" not in text:
        return []
    return [(m.start(), m.end(), "pem") for m in _PEM.finditer(text)]


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; empty where nothing has been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def blobs(versions: DataFrame, text_col: str) -> DataFrame:
    """(blob, body): each task hands on a content once, compressed, so copies that fill a task cross the network once."""

    def run(batches):
        import zstandard

        press, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in small(batches):
            names, bodies = [], []
            for cell in batch.column(0):
                body = cell.as_buffer().to_pybytes() if cell.is_valid else b""
                name = hashlib.sha256(body).digest()
                if name not in seen:
                    seen.add(name)
                    names.append(name.hex())
                    bodies.append(press(body))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["blob", "body"])

    return versions.select(F.encode(F.col(text_col).cast("string"), "UTF-8").alias("t")).mapInArrow(run, "blob string, body binary")


def scan_blobs(unseen: DataFrame, rule_version: str, name: str) -> DataFrame:
    """Findings of each blob, once: copies of a blob meet in one partition, and all but the first are passed over."""

    def run(batches):
        import zstandard

        open_, seen = zstandard.ZstdDecompressor().decompress, set()
        for batch in small(batches):
            names, base, every = [], [], []
            for blob, body in zip(batch.column(0), batch.column(1), strict=True):
                blob = blob.as_py()
                if blob in seen:
                    continue
                seen.add(blob)
                text = open_(body.as_buffer().to_pybytes()).decode("utf-8", "replace")
                found = S.secrets(text)
                names.append(blob)
                base.append(S.listed(found, S.SECRET))
                every.append(S.listed(found + more(text, found), S.SECRET))
            version, scan = (pa.array([x] * len(names), pa.string()) for x in (rule_version, name))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), version, scan, pa.array(base, pa.string()), pa.array(every, pa.string())], names=["blob", "rule_version", "scan", "base", "spans"])

    spread = unseen.repartition(partitions(unseen.sparkSession), "blob")
    return spread.mapInArrow(run, LEDGER)


def scan(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, base, spans, scanned_now): findings of every version, through the ledger at `ledger`. scanned_now: this call
    scanned the blob, where no earlier one had under this rule version.

    Null texts are the empty blob. A path with several versions, and repeated rows, give a row each; null paths are kept.
    Scanning the same contents again under the same rule version scans nothing. Blobs that two scans at once both appended count
    once.
    """
    spark, name = versions.sparkSession, uuid.uuid4().hex
    known = lambda: ledger_rows(spark, ledger).where(F.col("rule_version") == rule_version)
    body = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    paths = versions.select(F.col(path_col).alias("path"), F.sha2(body, 256).alias("blob"))
    unseen = through_table(paths.select("blob").distinct().join(known().select("blob"), "blob", "left_anti"), "unseen-blobs")
    if not unseen.isEmpty():
        # a written table has a known size: the planner broadcasts few names, and joins many by exchange
        scan_blobs(blobs(versions, text_col).join(unseen, "blob", "left_semi"), rule_version, name).write.mode("append").parquet(ledger)
    found = known().groupBy("blob").agg(F.first("base").alias("base"), F.first("spans").alias("spans"), F.bool_and(F.col("scan") == name).alias("scanned_now"))
    found = through_table(found, "findings")  # written, so that the join's sides are dealt anew: a hot blob's paths can be split
    return paths.join(found, "blob").select("path", "blob", "base", "spans", "scanned_now")


def contract(docs: DataFrame) -> DataFrame:
    """Two scans through one new ledger, as of two snapshots: the second finds every blob there, scans none (scanned_now is false) and
    returns the findings of all paths."""
    ledger = scratch(docs.sparkSession, "blob-ledger")
    scan(docs, ledger)
    found = scan(docs, ledger)
    return found.select(F.col("path").cast("long").alias("doc_id"), *[S.count_of("base", k) for k in S.SECRET], S.digest_of("base"), "spans", "scanned_now")

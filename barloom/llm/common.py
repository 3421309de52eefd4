"""What the operators share: shared scratch folders, blocks of documents, and packing of arrays into binary cells."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.staging import run_folder
from barloom.sources.staging import staged as through_table

__all__ = ["block_count", "blocked", "pack", "partitions", "read_table", "scratch", "small", "split_by", "through_table", "unpack"]

#: Groups that one shuffle partition takes when rows are grouped by block.
BLOCKS_PER_PARTITION = 2
#: Bytes of text in a block, about.
BLOCK_BYTES = 1 << 26


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this run."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small(batches, rows: int = 500):
    """Texts are long rows: slices of few of them, so that what a worker makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, column: str, size: int = BLOCK_BYTES) -> int:
    """Blocks of about `size` bytes of a column of texts or bytes, and at least two for each shuffle partition: a worker holds one
    block at a time, so blocks become more with the input, not larger."""
    kind = docs.schema[column].dataType.typeName()
    n = docs.agg(F.sum(F.octet_length(F.col(column) if kind == "binary" else F.col(column).cast("string")))).first()[0] or 0
    return max(partitions(docs.sparkSession) * BLOCKS_PER_PARTITION, -(-n // size))


def blocked(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(block, doc_id, body): block follows from doc_id, or from the text where that is null, so every pass over the same documents
    makes the same blocks. Rows of one doc_id share a block."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.pmod(F.coalesce(F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"))), F.xxhash64(text)), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.encode(text, "UTF-8").alias("body"),
    )


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, compressed column by column."""
    import zstandard

    n = len(arrays[0])
    head = np.array([n, *(a.dtype.itemsize for a in arrays)], "<i8")
    body = b"".join(
        np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes() if n else b"" for a in arrays
    )
    return head.tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(cell: bytes, *dtypes: str) -> list[np.ndarray]:
    import zstandard

    n = int(np.frombuffer(cell, "<i8", 1)[0])
    body = zstandard.ZstdDecompressor().decompress(cell[8 * (1 + len(dtypes)) :])
    out, at = [], 0
    for dtype in map(np.dtype, dtypes):
        size = dtype.itemsize
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if n else np.empty(0, dtype))
        at += n * size
    return out


def split_by(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows by key (stable), and the n + 1 bounds of the keys in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n + 1))

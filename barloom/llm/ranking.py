"""Ranked search by whole-number impacts: the product of two sparse matrices, block by block.

Rows of the left matrix are items, with how often they hold each term; rows of the right one are terms, with the impact of each
document that holds them. Spark makes blocks of both; a task multiplies each block of items with each of its blocks of documents
after Gustavson (the rows of an item's terms are added up into one dense row of the block's documents), and keeps the first k
documents of each item over all its blocks. The first of all tasks are ranked by a window.

1. Tasks turn documents into blocks: term by term the documents and counts, of the terms that items may hold. They know these by a
   table of 2^BITS bits, whatever the size of the input; a term too many is one more row that no item asks for. Blocks are written
   once, packed; document frequencies and lengths are added up from them.
2. Items are joined with the frequencies, weighed and packed into blocks of about ITEM_TERMS terms, grouped so that at most
   SENT bytes, about, are broadcast at a time (one item is never split); each group meets all blocks of documents.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import pack, small, through_table, unpack
from barloom.llm.words import LOWER, runs, slices, strings, word_hashes

TOP = 20
#: Bits of the table of terms that items hold (1 MB), terms in a block of items, bytes of items broadcast at a time.
BITS, ITEM_TERMS, SENT = 23, 1 << 16, 1 << 25

#: Bytes of a term: digits, letters, and all of characters beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x41:0x5B] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every term of some texts: (number of the text, start, end, hash) and the lower-cased bytes."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = _INSIDE[data]
    starts, ends = runs(inside)
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return of, starts, ends, word_hashes(data[inside], ends - starts), data


def bit_table(items: DataFrame) -> np.ndarray:
    """The 2^BITS bits of the terms that items hold: of a fixed size, merged by tasks as whole numbers of 64 bits."""

    def placed(batches):
        for batch in small(batches):
            for _, texts in slices(batch.column("text").to_pylist()):
                bit = np.unique(terms_of(texts)[3] >> np.uint64(64 - BITS))
                if len(bit):
                    word, first = np.unique(bit >> np.uint64(6), return_index=True)
                    value = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
                    yield pa.record_batch({"word": pa.array(word.astype(np.int32)), "bits": pa.array(value.view(np.int64))})

    merged = items.select("text").mapInArrow(placed, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[merged["word"].to_numpy()] = merged["bits"].to_numpy()
    return out.view(np.uint8)


BLOCK = "n_docs long, n_terms long, ids binary, lengths binary, terms array<string>, df array<int>, postings binary"


def document_blocks(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """Blocks of documents of doc_id and text: ids and lengths in terms of those that have one, their known terms in order, and for
    each term the places of its documents with its counts."""
    shared = docs.sparkSession.sparkContext.broadcast(known.tobytes())

    def made(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in small(batches, 4000):
            ids = batch.column("doc_id")
            for first, texts in slices(batch.column("text").to_pylist()):
                of, starts, ends, h, data = terms_of(texts)
                if not len(of):
                    continue
                length = np.bincount(of, minlength=len(texts))
                some = np.flatnonzero(length)
                bit = h >> np.uint64(64 - BITS)
                hit = bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
                coded = strings(data, starts[hit], ends[hit]).dictionary_encode()
                term, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(some, of[hit])
                pair, tf = np.unique(term * len(some) + doc, return_counts=True)
                df = np.bincount(pair // len(some), minlength=len(coded.dictionary)) if len(pair) else np.zeros(0, np.int64)
                own = ids.slice(first, len(texts)).take(pa.array(some))
                number = own.fill_null(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(some)], pa.int64()),
                        pa.array([int(length.sum())], pa.int64()),
                        pa.array([pack(number.astype(np.int64), own.is_valid().to_numpy(zero_copy_only=False))], pa.binary()),
                        pa.array([pack(length[some].astype(np.int64))], pa.binary()),
                        pa.array([[t.decode() for t in coded.dictionary.to_pylist()]], pa.list_(pa.string())),
                        pa.array([df.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([pack((pair % len(some)).astype(np.uint32), tf.astype(np.uint32))], pa.binary()),
                    ],
                    names=[c.split()[0] for c in BLOCK.split(", ")],
                )

    return docs.mapInArrow(made, BLOCK)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, of, term, times): of tells items of one id with different texts apart; items that are equal are one."""

    def made(batches):
        for batch in small(batches):
            ids = batch.column("item_id")
            for first, texts in slices(batch.column("text").to_pylist()):
                of, starts, ends, _, data = terms_of(texts)
                digest = pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
                term = strings(data, starts, ends)
                table = pa.table({"k": pa.array(of, pa.int64()), "term": term}).group_by(["k", "term"], use_threads=False).aggregate([("term", "count")]).combine_chunks()
                k = table["k"].chunk(0) if table.num_rows else pa.array([], pa.int64())
                if table.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(texts)).take(k), digest.take(k), table["term"].chunk(0).cast(pa.large_string()).cast(pa.string()), table["term_count"].chunk(0)],
                        names=["item_id", "of", "term", "times"],
                    )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(made, f"item_id {kind}, of binary, term string, times long").dropDuplicates()


def multiplied(items: list[tuple], block: dict, n_docs: int, n_terms: int, top: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """For a block of documents, (number of the item, its first documents as (-score, id or None, row)). items: (terms with weight and times)."""
    number, valid = unpack(block["ids"], "i8", "?")
    (length,) = unpack(block["lengths"], "i8")
    doc, tf = unpack(block["postings"], "u4", "u4")
    tf, m = tf.astype(np.int64), 75 + (25 * length * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
    bounds = np.concatenate(([0], np.cumsum(block["df"], dtype=np.int64)))
    row_of = {t: k for k, t in enumerate(block["terms"])}
    total, out = np.zeros(len(number), np.int64), []
    for item, (terms, weights) in enumerate(items):
        total[:] = 0
        for term, weight in zip(terms, weights, strict=True):
            k = row_of.get(term)
            if k is not None:
                total[doc[bounds[k] : bounds[k + 1]]] += weight * impact[bounds[k] : bounds[k + 1]]
        found = np.flatnonzero(total > 0)
        if len(found) > top:
            least = np.partition(total[found], len(found) - top)[len(found) - top]
            found = found[total[found] >= least]
        if len(found):
            found = found[np.lexsort((number[found], valid[found], -total[found]))][:top]
            out.append((item, list(zip((-total[found]).tolist(), valid[found].tolist(), number[found].tolist(), strict=True))))
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the first `top` documents of each item with a score above 0.

    Null and empty texts have no terms and aren't found; an item without a term of some document has no rows, nor has any of an empty
    table. Rows of one doc_id are documents of their own; a null id comes before others of the same score. Equal rows of items are one
    item; items of one id with different texts are ranked each by itself. Texts are read whole: a very long one is a block of its own.
    Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = through_table(document_blocks(texts, bit_table(asked)), "ranking-blocks")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("z")).groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.df").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = item_terms(asked)
    weighed = terms.join(df, "term").select("item_id", "of", "term", (F.col("times") * weight).alias("weight"))
    whole = weighed.groupBy("item_id", "of").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("row"))
    whole = through_table(whole.select("item_id", "of", F.col("row.term").alias("terms"), F.col("row.weight").alias("weights"), F.size("row").alias("n")), "ranking-items")
    n, size = whole.agg(F.sum("n"), F.sum(F.expr("aggregate(terms, 0L, (s, t) -> s + octet_length(t) + 16) + 64"))).first()
    kind = items.schema[item_col].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    parts = max(-(-n // ITEM_TERMS), -(-size // (SENT // 4)))
    parted = whole.withColumn("part", F.pmod(F.xxhash64("of"), F.lit(parts)))
    cells = blocks.select("ids", "lengths", "terms", "df", "postings")
    rows, each = None, max(parts * SENT // (2 * size + 1), 1)
    for first in range(0, parts, each):
        group = parted.where((F.col("part") >= first) & (F.col("part") < first + each)).drop("n", "part").toArrow()
        got = cells.mapInArrow(first_of_blocks(spark.sparkContext.broadcast(group), n_docs, n_terms, top), f"item_id {kind}, of binary, doc_id long, score long")
        rows = got if rows is None else rows.unionByName(got)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "of").orderBy(*order)))
    return placed.where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def first_of_blocks(shared, n_docs: int, n_terms: int, top: int):
    def made(batches):
        table = shared.value
        rows = list(zip(table["terms"].to_pylist(), table["weights"].to_pylist(), strict=True))
        best: dict[int, list] = {}  # of each item of the group the first documents of this task
        for batch in batches:
            for k in range(batch.num_rows):
                block = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                for item, found in multiplied(rows, block, n_docs, n_terms, top):
                    best[item] = sorted(best[item] + found)[:top] if item in best else found
        flat = [(item, d if there else None, -s) for item, found in best.items() for s, there, d in found]
        if flat:
            item, doc, score = zip(*flat, strict=True)
            of = pa.array(item, pa.int64())
            columns = [table["item_id"].combine_chunks().take(of), table["of"].combine_chunks().take(of), pa.array(doc, pa.int64()), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "of", "doc_id", "score"])

    return made

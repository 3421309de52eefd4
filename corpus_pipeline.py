"""From documents to token ids: quality rules, one document of each near-duplicate class, personal data masked, sources mixed,
BPE. Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Stages are written and read back between one another, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import bpe, jaccard, mixing, pii, quality
from barloom.llm.common import read_table, through_table
from barloom.llm.registry import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the decision list is learned from the labels.

    Null and empty texts fail the base rule and go. Repeated rows and null ids are judged row by row.
    """
    judged = quality.quality_rules(docs, read_table(spark, sf_dir, "labels"), keep=COLUMNS[1:])
    return judged.where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of least doc_id (a null one only where there is no other), then of least row hash.

    Classes are of rows, not of ids: rows with one doc_id, or with none, that have little in common all stay. Of rows that are
    equal in all columns one stays; texts without words are alone, and stay.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))
    classes = jaccard.jaccard_classes(rows, "row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("of")).distinct()
    named = rows.select("row", "doc_id").distinct().join(classes, "row")
    first = named.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    again = Window.partitionBy("row", *COLUMNS).orderBy("row")  # rows that are equal in all columns
    turn = rows.join(first.select("row"), "row", "left_semi").withColumn("turn", F.row_number().over(again))
    return turn.where("turn = 1").select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind, and their new lengths. Every row stays; null texts stay null."""
    found = pii.find_personal_data(docs, keep=COLUMNS[2:4])
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix. Every row stays; null sources are a source, repeated rows take places of their own."""
    return mixing.in_order(mixing.mix(docs.select(*COLUMNS)), list(COLUMNS))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digest of the text that the ids decode to, a row per document. Null and empty texts have no ids."""
    done = bpe.bpe_roundtrip(docs, vocabulary())
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("source_mix", mixing_stage),
    ("bpe_tokens", token_stage),
]
#: Learned rules, the random field and BPE have no SQL form; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = through_table(docs, f"pipeline-{name}")
    return docs

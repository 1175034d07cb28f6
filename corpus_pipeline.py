"""The document pipeline: quality, exact copies, near copies, benchmark passages, packing.

STAGES lists (name, function). A function takes (spark, docs, sf_dir), docs being what its predecessor kept, and all but
the last return the columns of documents. Each stage's result is written and read again as the next one's docs; what a stage wrote on its
way, and its input, are deleted once its result stands.

Cases: a null or empty text has no terms and gets the mean score, so it stays or goes with it; of all empty or white texts one stays. Very long texts are
read whole, and packed in pieces. Of repeated rows one stays. Ties go as each operator says: the most code points, then the smallest doc_id.
A row with a null doc_id is a copy or not by its text, and in no near-duplicate group. Other columns, whatever their names, are dropped. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, exact_dedup, near_dedup, packing, quality_knn, tokens
from textloom.llm.common import drop, passing, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep(docs).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(docs, tokens.vocabulary_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", clean), ("best-fit packing", pack)]
ORACLE_SQL = None  # nearest neighbours and tokens are beyond SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        with passing(spark) as kept:
            out = stage(spark, function(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(out)
        if hasattr(docs, "staged_at"):
            drop(spark, docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)

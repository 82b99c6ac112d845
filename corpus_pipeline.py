"""Corpus pipeline over documents: STAGES in order, each written as Parquet and read again as the next one's docs.

Every stage works on all rows that the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm import decontaminate, langid, mixing, near_dedup, secrets
from graphtide.llm.columns import free_name
from graphtide.runtime import Shelf, table

#: Near-duplicate stage: five-word shingles, similarity of 0.8.
SHINGLE, NUM, DEN = 5, 80, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; dictionaries come from labelled rows of docs that are not held out."""
    models = langid.train(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    return langid.predict(docs, models).filter("NOT rejected").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows that share an id are one
    document; rows without an id stay if any of them leads a group."""
    name = free_name(docs, "kept_id")
    kept = near_dedup.components(docs.select("doc_id", "text"), SHINGLE, NUM, DEN).filter("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage by the contract's rule."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contamination(docs, items).filter("NOT contaminated").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their text replaced by <kind>."""
    found = secrets.scan(docs)
    return found.withColumn("text", secrets.redacted(F.col("text"), F.col("secrets"))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their calibrated probabilities."""
    return mixing.mix(docs).filter("kept").select(*docs.columns, F.round("probability", 6).alias("probability"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing_stage),
]
#: Compression and near-duplicate components are not SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        shelf = Shelf(spark)
        docs = shelf.put(stage(spark, docs, sf_dir))
        if before is not None:
            before.clear()
        before = shelf
    # the result is lazy: what it reads stays until the end of the process
    return STAGES[-1][1](spark, docs, sf_dir)

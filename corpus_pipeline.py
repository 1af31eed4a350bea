"""Corpus cleaning pipeline over ``documents``: five stages, each by one training-data operator.

Every stage works on all that its predecessor kept and its decisions take effect;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import language_id, packing, queries, secrets, simhash
from tidegraph.llm.common import remove, scratch, small_batches
from tidegraph.llm.exact_dedup import drop_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or unlike every labelled language."""
    small_batches(spark)
    sample = language_id.training_sample(docs, F.lit(True), "doc_id", "text", "lang")
    return language_id.keep_accepted(docs.select(*COLUMNS), language_id.fit(sample))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the smallest doc_id."""
    return drop_copies(docs.select(*COLUMNS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike in their five-word shingles (0.8 or more) keep the smallest doc_id of each group."""
    small_batches(spark)
    return simhash.near_dedup(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark; every document stays."""
    found = secrets.scan(docs.select(*COLUMNS))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("secret_spans")))
    return clean.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 ids."""
    small_batches(spark)
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Language models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = scratch(spark, f"stage{k}")
            docs.write.parquet(kept)
            docs = spark.read.parquet(kept)
            if earlier:
                remove(earlier)
            earlier = kept
    return docs

"""A five-stage corpus pipeline over `documents`: filter, deduplicate, decontaminate, redact, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrograin.llm import bpe, decontaminate, quality, secrets, simhash
from hydrograin.llm.shared import read_table, stage

#: Near-duplicates: shingles of five words, a Jaccard similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are too short. Repeated rows and null ids stay if their text does."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id (a null one last; the first row where it repeats)."""
    return simhash.deduplicated(docs, SHINGLE, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts stay, and so do repeated rows and null ids."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars brought up to date; a null text stays null."""
    found = secrets.redacted(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else found


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digests of ids and decoded text; a null text counts as empty. Rows stay as they are."""
    found = bpe.encoded(docs, bpe.vocabulary())
    return bpe.digests(found, "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", tokens),
]

#: Near-dedup, redaction and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, f in STAGES:
        docs = stage(f(spark, docs, sf_dir))
    return docs

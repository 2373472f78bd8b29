"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages take nulls in any column, empty and very long texts, repeated rows and ids, extra columns of any name, and
empty tables. What becomes of each is said below; an empty table gives an empty table with the stage's columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, dedup, mixing, pii, quality
from gridloom.llm.common import remove, shared_folder, temporary_tables
from gridloom.llm.queries import pii_key, rank_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules accept, with their columns.

    Null, empty and blank texts and those under 50 words are rejected; repeated rows are judged alike, each by itself.
    """
    return quality.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8), that of the smallest id.

    Repeated rows of one id are one document: one row stays, that of the smallest text, null last. Rows without an id are
    compared by their texts and stay after all ids. Null and blank texts are near copies of nothing and stay.
    """
    return dedup.drop_near_duplicates(docs, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced; null and empty texts stay, and so do rows and their order."""
    return pii.with_pseudonyms(docs, pii_key(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: each document once for each pass the mix makes over it, in training order.

    Null and blank texts have no words and never come; a null source is a source of its own; repeated rows count each.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and decoded bytes; a null text counts as empty and has none."""
    return bpe.encode_documents(docs, *rank_file())


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("pii", pseudonyms), ("mixing", mix), ("bpe", encode)]

#: The EM of the first stage and the library's merges are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is a Parquet table in the shared folder, deleted once the next is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

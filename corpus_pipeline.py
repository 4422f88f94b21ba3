"""A corpus from raw documents to packed sequences, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from merchantry.llm import exact_dedup, ngram_join, packing, pii, quality
from merchantry.llm.common import prepare, table
from merchantry.session import configure, cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_one(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms in place of private data."""
    return pii.replace_private(docs, pii.key_of(spark))


#: Words a worker keeps while packing: fewer than op3 alone, as workers of earlier stages are still about.
PACKING_WORDS = 700_000


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, cached=PACKING_WORDS)


STAGES = [
    ("quality rules", quality_rules), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
    ("PII", replace_pii), ("best-fit packing", pack_sequences),
]

#: Distances to learned references, tokens and pseudonyms are not for SQL: the tests hold run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(prepare(spark), docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

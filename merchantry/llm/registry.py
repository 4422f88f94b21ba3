"""Queries of the operators, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from merchantry.llm import exact_dedup, hard_negatives, licenses, line_dedup, ngram_join, packing, pieces, pii, quality, quotes, repair, repeats, toxicity
from merchantry.session import configure

QUERIES = [
    ngram_join.op1_ngram_jaccard, licenses.op2_license_scan, packing.op3_best_fit_packing, line_dedup.op4_line_dedup, exact_dedup.op5_exact_dedup, quality.op6_quality_divergence, pieces.op7_sentencepiece,
    pii.op8_pii_pseudonyms, repeats.op9_suffix_repeats, quotes.op10_quotation_links, hard_negatives.op11_hard_negatives, toxicity.op12_toxicity, repair.op13_conversation_repair,
]
SQL = {
    "op1_ngram_jaccard": ngram_join.SQL, "op2_license_scan": licenses.sql(), "op4_line_dedup": line_dedup.SQL, "op5_exact_dedup": exact_dedup.SQL, "op10_quotation_links": quotes.SQL,
    "op11_hard_negatives": hard_negatives.SQL, "op13_conversation_repair": repair.SQL,
}


def _run(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _run(q) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""The corpus pipeline: quality rules, near-dedup, decontamination, surrogates, mixing.

Each stage works on everything that its predecessor kept; all but the last return the columns of
documents.  ``ORACLE_SQL`` is None: the perplexity model and the keyed surrogates have no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import decontam, dedup, mixing, perplexity, privacy
from rivulet.llm.runtime import made, settle, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band."""
    return perplexity.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark passages."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data."""
    return privacy.rewritten(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("mixing sources to target weights", mixing_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read again.

    Once a stage's result is written, its predecessor's and all that it wrote for itself go.
    """
    docs, before = table(spark, sf_dir, "documents"), made()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        settle(before)
    return STAGES[-1][1](spark, docs, sf_dir)

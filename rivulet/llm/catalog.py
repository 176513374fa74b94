"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import chat, decontam, dedup, licenses, lmscore, mixing, perplexity, privacy, secrets, toxicity
from rivulet.llm.runtime import table


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.surrogates(table(spark, sf_dir, "documents"))


def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"), nested=True)


def op7_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.likelihoods(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted(chat.with_conflict(table(spark, sf_dir, "conversations"))))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_perplexity, op2_surrogates, op3_tensored_minhash, op4_winnowing, op5_mixing, op6_licenses, op7_gru, op8_chat, op9_secrets, op10_toxicity)}

ORACLES: dict[str, str] = {"op4_winnowing": decontam.ORACLE, "op5_mixing": mixing.ORACLE, "op6_licenses": licenses.oracle(), "op8_chat": chat.ORACLE}

"""The queries opN_<name>: each operator over its whole table, with the columns its contract fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing
from .attribution import section_tokens
from .classifier import quality_scores
from .contextmix import score_texts
from .decontamination import find_leaks
from .minhash import near_duplicates
from .oracles import ORACLE_SQL  # noqa: F401
from .pii import find_pii
from .quality import quality_rules
from .repair import token_output
from .substring import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.withColumnRenamed("id", "doc_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


def op6_contextmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), group_col="lang").withColumnRenamed("id", "doc_id")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_token_counts, op3_pii, op4_mixing, op5_decontamination, op6_contextmix, op7_fertility, op8_substring, op9_classifier, op10_repair)}

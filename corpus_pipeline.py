"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token files.

Rows of null or empty text fail the quality rules. Rows of null id are judged, mixed and encoded as others are, and are near
duplicates of nothing; rows that repeat an id are one document to the near-duplicates and rows of their own elsewhere. No
documents: no rows. Columns beyond those of documents go with their rows up to the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidefold.llm.decontamination import without_leaks
from tidefold.llm.minhash import keep_first
from tidefold.llm.mixing import mixture
from tidefold.llm.quality import keep_good
from tidefold.llm.repair import token_output
from tidefold.llm.scratch import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, group_col="lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: No SQL: min-max hashing apart, BM25 retrieval and Re-Pair files are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, name)
    return docs

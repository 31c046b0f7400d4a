"""The corpus pipeline: five operators in a row over ``documents``.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``.  All stages but the last return the
columns of ``documents``.

1. ``quality``: failed lines leave the texts, rejected documents leave the corpus.
2. ``near_dedup``: of each component of near duplicates the document of least id stays.
3. ``repeats``: byte strings of 100 that start earlier elsewhere leave the texts.
4. ``mix``: documents are repeated by Poisson counts towards the target weights.
5. ``tokens``: texts are encoded; each row gets the digests of its ids and decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noetica.llm import bpe, mixing, quality, simhash, suffix_dedup
from noetica.llm.common import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: SimHash, the suffix ranks and BPE are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

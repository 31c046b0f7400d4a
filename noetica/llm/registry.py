"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, licenses, mixing, quality, simhash, suffix_dedup, token_files, topk, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), copy_col="copy_no")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    prototypes = langid.learn(docs.where("not held_out"))
    return langid.identify(docs, prototypes, keep=("held_out",))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


_QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_warc_salvage, op2_exact_topk, op3_simhash_near_dedup, op4_source_mixing, op5_language_id, op6_suffix_dedup, op7_byte_bpe, op8_token_files, op9_quality_rules, op10_license_scan)}
_ORACLE: dict[str, str] = {"op1_warc_salvage": warc.ORACLE_SQL, "op2_exact_topk": topk.ORACLE_SQL, "op4_source_mixing": mixing.ORACLE_SQL, "op6_suffix_dedup": suffix_dedup.ORACLE_SQL, "op9_quality_rules": quality.ORACLE_SQL}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

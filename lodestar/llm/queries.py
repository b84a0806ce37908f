"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import ann, bpe, html, mixing, neardup, quality, rollups, substring, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(_table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0, k=5)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(_table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(ann.searchable(_table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0, k=20)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, docs, _table(spark, sf_dir, "labels"))


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_totals(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, docs, _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ann": op3_ann,
    "op4_mix_sources": op4_mix_sources,
    "op5_main_text": op5_main_text,
    "op6_toxicity": op6_toxicity,
    "op7_token_rollups": op7_token_rollups,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": topk.SQL,
    "op2_substring_dedup": substring.SQL,
    "op4_mix_sources": mixing.SQL,
    "op7_token_rollups": rollups.SQL,
    "op8_near_duplicates": neardup.SQL,
}

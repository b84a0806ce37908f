"""The corpus pipeline: documents without toxic texts, near copies and repeated passages, mixed by source and encoded.

Each stage takes (spark, docs, sf_dir) and returns a table; the next stage reads what it wrote as Parquet.

Defined results, for all stages: an empty table gives an empty table of the same columns; columns besides doc_id, text,
source and n_chars are passed on as they are, whatever their names, by all but the last stage; null labels are no labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, mixing, neardup, substring, toxicity
from lodestar.llm.common import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Similarity in hundredths from which texts are near copies; op8_near_duplicates asks for 85.
NEAR_COPIES = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score of toxicity is below the bar.

    Null and empty texts score as texts without words; repeated rows score alike and so share their fate; a text of any
    length is scored whole; null ids are scored and not learned from; without labels of both kinds the score is the share
    of toxic ones, and without any labels everything stays.
    """
    return toxicity.without_toxic(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id.

    Null and empty texts, and rows with a null id, stay; rows that share id and text stay or go together; rows that share
    an id but not a text are judged one by one; texts are compared whole.
    """
    return neardup.deduplicated(docs, NEAR_COPIES)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that also stand in a document of smaller id.

    Null and empty texts, and rows with a null id, stay as they are; rows that share an id are no copies of each other; a
    document that loses all its words goes; what is left of a text is joined by single spaces, and n_chars is set anew.
    """
    return substring.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and are not taken; null sources are one source; a null id is drawn as the empty
    one; ties go by id, then size; rows that share id and source share their fate; a document of which only some words are
    taken has its first words, and n_chars is set anew.
    """
    return mixing.materialise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the hash of the text that they decode to.

    A null text is encoded as the empty one, without ids; every row gives one row, repeated ones and null ids too; texts
    are encoded whole.
    """
    return bpe.digest(docs, bpe.vocabulary_path(), keep=["lang", "source"], with_ids=True, chunks=100_000, rows=128)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither a learned classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

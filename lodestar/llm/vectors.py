"""Vector tables for the searches: cleaning, blocks, and query blocks against row blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that one task holds at once.
ROWS_PER_BLOCK = 8_192
QUERIES_PER_BLOCK = 1_024


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v array<double>) of the rows that take part in a search.

    Rows with a null id, a null vector, or null or non-finite components take none. Of rows that share an id, the one
    with the least vector counts.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def blocks_of(n: int, size: int) -> int:
    """How many blocks of about size n rows make."""
    return max(1, math.ceil(n / size))


def in_blocks(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """rows with the number of their block under name."""
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def matrix(column: pd.Series, width: int = 0) -> np.ndarray:
    """The vectors of a column as rows of doubles, short ones filled with zeros."""
    lists = [np.asarray(x, dtype=np.float64) for x in column]
    width = max([width, *map(len, lists)])
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def search_blocks(rows: DataFrame, queries: DataFrame, search: Callable, k: int, score: str = "double") -> DataFrame:
    """The k best over all row blocks: query_id, rank, vec_id, score.

    rows has block; queries has block and qblock. search(rows, queries), over pandas frames of one row block and one
    query block, gives the frame (query_id, vec_id, score) of each query's k best in the block. Each row block goes to
    each query block that asks for it; nothing is collected. A query's results of all blocks meet at k rows a block.
    """
    anew = lambda *names: queries.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  columns of its own, for the two joins
    asked = anew("block", "qblock").distinct()
    dealt = rows.join(asked, "block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search(left, right)

    found = dealt.groupBy("block", "qblock").cogroup(anew(*queries.columns).groupBy("block", "qblock")).applyInPandas(run, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

"""Exact top-k search.

One query is a projection and a TakeOrderedAndProject: every task keeps its k best and the driver merges them, no
shuffle. Many queries are dealt out in blocks against blocks of rows, and meet again as k rows per query and block.
Equal scores go to the smaller id; scores that are no number come last.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import has_dimensions, l2_norm, score, vector
from lodestar.operators.metadata import matches
from lodestar.types import RESULTS, Metric, Scalar

#: Queries that a row is scored against at once; beyond it queries and rows meet in blocks.
QUERIES_PER_BLOCK = 1_024
ROWS_PER_BLOCK = 65_536


def _best_first(by: str = "score") -> list[Column]:
    return [F.isnan(by).asc(), F.desc(by), F.asc("id")]


def empty_results(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], RESULTS)


def _numbered(found: DataFrame) -> DataFrame:
    """Add rank to k rows at most, which are in one partition already."""
    rank = F.row_number().over(Window.orderBy(*_best_first()))
    return found.select(rank.cast("int").alias("rank"), "id", "score")


def scored(rows: DataFrame, query: Column | Sequence[float], dimensions: int, metric: Metric) -> DataFrame:
    """(id, score) of all rows (id, values) that have the dimensions."""
    q = vector(query)
    norm = l2_norm(q) if metric is Metric.cosine else None  # of a literal: folded once
    known = F.col("norm") if metric is Metric.cosine and "norm" in rows.columns else None
    fit = rows.where(has_dimensions("values", dimensions))
    return fit.select("id", score(q, F.col("values"), metric, norm, known).alias("score"))


def top_k(rows: DataFrame, query: Sequence[float], k: int | None, dimensions: int, metric: Metric = Metric.cosine) -> DataFrame:
    """rank, id, score of the k best live rows (id, values) for a query; all of them if k is None.

    A query of other dimensions, or k = 0, gives an empty result. A column norm of rows is used if it is there.
    """
    if len(query) != dimensions or k == 0:
        return empty_results(rows)
    found = scored(rows, query, dimensions, metric).orderBy(*_best_first())
    if k is not None:
        return _numbered(found.limit(k))
    return ranked(scored(rows, query, dimensions, metric))


def ranked(found: DataFrame, ranges: int | None = None) -> DataFrame:
    """rank, id, score of all rows (id, score), without gathering them in one task.

    Scores are cut into ranges at approximate quantiles, of which one list reaches the driver; the rank is what stands in
    better ranges plus the place within the range.
    """
    parts = ranges or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = found.select(F.col("score").cast("double").alias("x")).where(~F.isnan("x"))
    cuts = sorted(set(numbers.approxQuantile("x", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    better = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("score").cast("double"))) if cuts else F.lit(0)
    cut = found.withColumn("_range", F.when(F.isnan("score"), len(cuts) + 1).otherwise(better))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_range").alias("_of"), before.alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*_best_first()))
    placed = cut.withColumn("_place", place).join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return placed.select((F.col("_before") + F.col("_place")).cast("int").alias("rank"), "id", "score")


def filtered_top_k(rows: DataFrame, metadata: DataFrame, predicates: Mapping[str, Scalar] | Sequence[tuple[str, Scalar]], query: Sequence[float], k: int | None, dimensions: int, metric: Metric = Metric.cosine) -> DataFrame:
    """top_k among the rows whose metadata (id, metadata) meets all predicates. The filter comes before the scores.

    No predicates: all rows. A field that is missing, or has another type, doesn't match.
    """
    wanted = list(predicates.items() if isinstance(predicates, Mapping) else predicates)
    if not wanted:
        return top_k(rows, query, k, dimensions, metric)
    if len(query) != dimensions or k == 0:
        return empty_results(rows)
    return top_k(rows.join(metadata.where(matches("metadata", wanted)).select("id"), "id", "left_semi"), query, k, dimensions, metric)


def candidates_top_k(rows: DataFrame, candidates: DataFrame, query: Sequence[float], k: int | None, dimensions: int, metric: Metric = Metric.cosine) -> DataFrame:
    """top_k among the rows whose id is among candidates (id), as an index gives them. Ids that are not live are passed over."""
    return top_k(rows.join(candidates.select("id").distinct(), "id", "left_semi"), query, k, dimensions, metric)


def post_filtered_top_k(rows: DataFrame, metadata: DataFrame, predicates: Sequence[tuple[str, Scalar]], query: Sequence[float], k: int, dimensions: int, metric: Metric = Metric.cosine) -> DataFrame:
    """The same result by scoring all rows first and filtering then: for tests, and to compare plans."""
    meets = metadata.where(matches("metadata", predicates)).select("id")
    everything = scored(rows, query, dimensions, metric)
    return _numbered(everything.join(meets, "id", "left_semi").orderBy(*_best_first()).limit(k))


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, dimensions: int, metric: Metric = Metric.cosine) -> DataFrame:
    """query_id, rank, id, score: the k best rows (id, values) for each of queries (query_id, q).

    One block of queries is broadcast: its size is checked. More are joined in blocks, by the pair of a row block and a
    query block, so nothing that grows with the data is broadcast or gathered. k rows per query leave each task.
    """
    asked = queries.where(has_dimensions("q", dimensions))
    fit = rows.where(has_dimensions("values", dimensions)).select("id", "values")
    n = asked.count()
    if not n or not k:
        return rows.sparkSession.createDataFrame([], f"query_id bigint, {RESULTS}")
    if metric is Metric.cosine:
        asked, fit = asked.withColumn("q_norm", l2_norm("q")), fit.withColumn("norm", l2_norm("values"))
    norms = (F.col("q_norm"), F.col("norm")) if metric is Metric.cosine else (None, None)
    if n <= QUERIES_PER_BLOCK:
        pairs = fit.crossJoin(F.broadcast(asked))
    else:
        blocks, row_blocks = math.ceil(n / QUERIES_PER_BLOCK), math.ceil(fit.count() / ROWS_PER_BLOCK) or 1
        left = fit.withColumn("_rows", F.pmod(F.xxhash64("id"), F.lit(row_blocks))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_rows", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint"))))
        pairs = left.join(right, ["_rows", "_block"])
    found = pairs.select("query_id", "id", score("q", "values", metric, *norms).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_best_first()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")

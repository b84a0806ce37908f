"""Newest-wins visibility over versions (generation, id, is_deleted, values).

For each id the version of the highest generation counts; if it is a tombstone, the id is not visible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(segments: list[DataFrame], pending: DataFrame | None = None) -> DataFrame:
    """All versions of segments (id, is_deleted, values), oldest first, and of pending rows, which are newest."""
    parts = [*segments, *([pending] if pending is not None else [])]
    numbered = [df.select(F.lit(n).alias("generation"), "id", "is_deleted", "values") for n, df in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


def newest(rows: DataFrame) -> DataFrame:
    """The newest version of every id, tombstones too: one shuffle by id, summed in each task first."""
    best = F.max_by(F.struct("generation", "is_deleted", "values"), "generation").alias("v")
    return rows.groupBy("id").agg(best).select("v.generation", "id", "v.is_deleted", "v.values")


def newest_wins(rows: DataFrame) -> DataFrame:
    """(id, values) of the visible rows."""
    return newest(rows).where("NOT is_deleted").select("id", "values")


def newest_wins_by_rank(rows: DataFrame) -> DataFrame:
    """The same by a window, whose limit of one row runs before and after the shuffle."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("generation")))
    return rows.withColumn("_rank", rank).where("_rank = 1 AND NOT is_deleted").select("id", "values")


def point_get(rows: DataFrame, id: int) -> DataFrame:
    """(id, values) of one id, or nothing. The filter reaches the scans; no shuffle."""
    return rows.where(F.col("id") == id).orderBy(F.desc("generation")).limit(1).where("NOT is_deleted").select("id", "values")


def live_count(rows: DataFrame) -> DataFrame:
    """(n): how many ids are visible. Vectors are not read."""
    best = F.max_by("is_deleted", "generation").alias("gone")
    return rows.groupBy("id").agg(best).agg(F.count(F.when(~F.col("gone"), 1)).alias("n"))


def compacted(rows: DataFrame) -> DataFrame:
    """The rows of one segment that stands for all of rows: newest versions without tombstones, as live rows."""
    return newest_wins(rows).select("id", F.lit(False).alias("is_deleted"), "values")

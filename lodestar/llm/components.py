"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_staged, staged

#: Rounds after which something must be wrong: the method needs about the squared logarithm of the longest path.
MOST_ROUNDS = 200
#: Edges that one task writes, if their number is known.
ROWS_A_FILE = 20_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours at the least of its neighbourhood. Edges (u, v) have u > v, before and after.

    A hot node's least is summed in parts first; the edges are joined to it by their smaller end, and a join splits
    a hot key.
    """
    around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("m", "x").alias("m"))
    return edges.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours at the least of these."""
    least = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or points at one centre only."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select(F.col("v").alias("x"), F.lit(0), F.lit(1)))
    roles = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return roles.where("down > 1 OR (down = 1 AND up = 1)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, most: int = 0) -> DataFrame:
    """(id, component): each node of edges (u, v) with the least node it can reach. Loops and repeated edges don't matter.

    edges is read several times, so it should be a written table. most: its rows or more, if known, to bound the files
    of each round. Every round's edges are written to the shared folder, so lineage stays short and a lost executor costs
    one round; rounds end as soon as the edges are stars.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for n in range(MOST_ROUNDS):
        if _are_stars(edges):
            stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        starred = _small_star(_large_star(edges))
        starred = staged(starred.coalesce(math.ceil(most / ROWS_A_FILE)) if most else starred, "edges")
        if n:
            drop_staged(edges)
        edges = starred
    raise RuntimeError("components did not settle")

"""Exact top-k search by aggregation without random access (NRA) over integer vectors.

The score of a row for a query is the inner product of their integer vectors: a sum over dimensions, each of which is a
list of the block's rows sorted by component. For a query every list is read from its better end, all lists to the
same depth. What has been read of a row gives its lower bound (its unread components at their worst) and its upper
bound (its unread components at the list's present value). Reading stops when few rows have an upper bound that reaches
the k-th lower bound; no outsider can then qualify, and the scores of those few are resolved exactly. Many queries read
the lists side by side.

Rows are dealt out in blocks by a hash of their id, queries in blocks as well; the k best of a block are among the
results, so the k best of all blocks' results are exact.

Defined results: see vectors.clean; an empty vector scores 0; vectors of different length are compared with missing
components as 0; equal scores go to the smaller id; fewer than k other rows give all of them; an empty table gives an
empty result. Scores must be below 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged
from lodestar.llm.vectors import QUERIES_PER_BLOCK, ROWS_PER_BLOCK, blocks_of, clean, in_blocks, matrix, search_blocks

SCALE = 256
#: Shares of the lists after which bounds are compared. A query that has not stopped by then reads its lists whole.
DEPTHS = (0.6, 0.8, 0.9)
#: Reading stops when so many rows may still qualify; they are resolved.
RESOLVED = 256
#: Queries that read the lists side by side.
SIDE_BY_SIDE = 64


class SortedLists:
    """The lists of one block: for each dimension the rows by component.

    Positive weights read a list from its top, negative ones from its bottom, so at a given depth two tables hold all
    that has been read: one of what was read from the tops, one from the bottoms. What is unread stands in them at the
    last value read (for upper bounds) or at the list's other end (for lower bounds). The bounds of all rows for many
    queries are then products with these tables.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.rows = np.argsort(values, axis=0, kind="stable")
        self.parts = np.take_along_axis(values, self.rows, axis=0)

    def _read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For upper and for lower bounds: the tables read from the tops and from the bottoms, side by side."""
        n, dims = self.values.shape
        ends = ((self.rows[n - depth :], self.parts[n - depth :], self.parts[n - depth], self.parts[0]), (self.rows[:depth], self.parts[:depth], self.parts[depth - 1], self.parts[-1]))
        upper, lower = np.empty((n, 2 * dims)), np.empty((n, 2 * dims))
        for k, (rows, parts, last, worst) in enumerate(ends):
            at = slice(k * dims, (k + 1) * dims)
            for table, unread in ((upper, last), (lower, worst)):
                table[:, at] = unread
                np.put_along_axis(table[:, at], rows, parts, axis=0)
        return upper, lower

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the k best rows but those with its own id, best first."""
        n, dims = self.values.shape
        weights = np.zeros((len(queries), dims))
        weights[:, : min(dims, queries.shape[1])] = queries[:, :dims]
        split = np.concatenate([np.maximum(weights, 0), np.minimum(weights, 0)], axis=1)
        others = [self.ids != i for i in own]
        found: list = [None] * len(queries)
        reading = list(range(len(queries)))
        for share in DEPTHS if n > RESOLVED and dims else ():
            upper, lower = self._read(max(1, int(n * share)))
            still = []
            for at in range(0, len(reading), SIDE_BY_SIDE):
                group = reading[at : at + SIDE_BY_SIDE]
                tops, bottoms = split[group] @ upper.T, split[group] @ lower.T
                for q, top, bottom in zip(group, tops, bottoms, strict=True):
                    least = bottom[others[q]]
                    few = min(k, len(least))
                    alive = np.flatnonzero((top >= np.partition(least, len(least) - few)[len(least) - few] - 0.5) & others[q]) if few else np.zeros(0, int)
                    if len(alive) <= RESOLVED:  # scores are whole numbers, so half of one is slack enough
                        found[q] = self._resolved(weights[q], alive, k)
                    else:
                        still.append(q)
            reading = still
        for q in reading:  # the lists are read whole
            found[q] = self._resolved(weights[q], np.flatnonzero(others[q]), k)
        return found

    def _resolved(self, weights: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = np.rint((self.values if len(rows) == len(self.values) else self.values[rows]) @ weights).astype(np.int64)
        k = min(k, len(rows))
        if k < len(rows):
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k]) if k else np.zeros(0, int)
            rows, scores = rows[some], scores[some]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def top_k(items: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of items (id, v) that is a query, the k best of all other rows."""
    items = staged(items, "topk")
    blocks = blocks_of(items.count(), ROWS_PER_BLOCK)
    rows = in_blocks(items, blocks, "block")
    queries = items.where(is_query)
    queries = in_blocks(queries, blocks_of(queries.count(), QUERIES_PER_BLOCK), "qblock")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        lists = SortedLists(block["id"].to_numpy(), matrix(block["v"]))
        own = asked["id"].to_numpy()
        out = [(q, *found) for q, found in zip(own.tolist(), lists.search(matrix(asked["v"]), own, k), strict=True)]
        return pd.DataFrame({
            "query_id": np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64),
            "vec_id": np.concatenate([i for _, i, _ in out]),
            "score": np.concatenate([s for _, _, s in out]),
        })

    return search_blocks(rows, queries, search, k, score="long")


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) with every component x as floor(SCALE * x)."""
    return clean(df, id_col, vector_col).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("double")))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

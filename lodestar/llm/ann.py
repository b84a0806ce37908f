"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every row is then assigned to a leaf by descending it. A query walks the tree
with a priority queue over nodes, the one whose centre has the largest inner product first, and so puts the leaves in
the order of promise. How many leaves to visit is calibrated: a bounded set of calibration queries is answered by brute
force over all rows, and the visits are widened until their recall reaches the target. A leaf's rows are scored exactly,
in double precision, by one fixed order of summation.

Leaves are packed into blocks of bounded size; a leaf with more rows than a block is cut into pieces, so a third of all
rows in one leaf does no harm. A query goes to the blocks that hold one of its leaves.

Defined results: see vectors.clean; zero and empty vectors take no part; vectors of different length are compared with
missing components as 0; equal scores go to the smaller id; a query visits leaves until they hold k other rows, so fewer
than k other rows give all of them; equal vectors can't be cut, so a table of one vector, or of one row, is one leaf; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import staged
from lodestar.llm.vectors import QUERIES_PER_BLOCK, ROWS_PER_BLOCK, blocks_of, clean, in_blocks, matrix, search_blocks

#: Rows that the tree is fitted on at most, and its shape: branches of a node at most, rows of a leaf, leaves at least and at most.
SAMPLE = 20_000
BRANCHES = 12
LEAF_ROWS = 128
LEAST_LEAVES = 4
MOST_LEAVES = 4_096
ROUNDS = 8
#: Queries answered by brute force to calibrate, and the recall they must reach: more than the 0.9 asked for.
CALIBRATION = 96
RECALL = 0.95
#: By how much, of the product of the norms, scores of one summation order may differ from another's.
SLACK = 1e-9


@dataclass
class Tree:
    """Centres of all nodes; the children of a node are rows first[i]:first[i + 1] of it; a leaf has a number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def _node(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, seed: int = 7) -> Tree:
        """A tree of about the number of leaves over the sample, each cut taking the largest node left.

        A cut makes so many branches that the tree has two levels below its root, or more, from four leaves on.
        """
        tree, rng = cls(), np.random.default_rng(seed)
        branches = min(BRANCHES, max(2, math.isqrt(leaves)))
        unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
        open_nodes = [(-len(unit), tree._node(unit.mean(axis=0) if len(unit) else np.zeros(sample.shape[1])), np.arange(len(unit)))]
        closed = []
        while open_nodes and len(open_nodes) + len(closed) + branches - 1 <= leaves:
            _, node, rows = heapq.heappop(open_nodes)
            parts = _k_means(unit[rows], branches, rng) if len(rows) >= branches else [np.arange(len(rows))]
            if len(parts) < 2:
                closed.append(node)
                continue
            for part in parts:
                child = tree._node(unit[rows[part]].mean(axis=0))
                tree.children[node].append(child)
                heapq.heappush(open_nodes, (-len(part), child, rows[part]))
        for node in sorted([*closed, *(n for _, n, _ in open_nodes)]):
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
        return tree

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector: at each node, the child whose centre is nearest to the vector's direction."""
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        out, todo = np.zeros(len(unit), np.int32), [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = np.stack([self.centres[i] for i in self.children[node]])
            best = np.argmin((c * c).sum(axis=1) - 2 * unit[rows] @ c.T, axis=1)
            todo += [(child, rows[best == k]) for k, child in enumerate(self.children[node]) if (best == k).any()]
        return out

    def best_bins(self, query: np.ndarray, n: int, sizes: list[int] | None = None, least: int = 0) -> list[int]:
        """The n leaves of most promise, in the order in which best-bin-first traversal reaches them; more, until by their sizes they hold the least number of rows."""
        scores = self._all @ query if hasattr(self, "_all") else self._stack() @ query
        queue, found, rows = [(0.0, 0)], [], 0
        while queue and (len(found) < n or rows < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-scores[child], child))
            else:
                found.append(self.leaf[node])
                rows += sizes[self.leaf[node]] if sizes else 0
        return found

    def _stack(self) -> np.ndarray:
        self._all = np.stack(self.centres)
        return self._all


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of each of k clusters; empty ones are left out."""
    centres, own = x[rng.choice(len(x), k, replace=False)], np.zeros(len(x), int)
    for _ in range(ROUNDS):
        own = np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return [rows for c in range(k) if len(rows := np.flatnonzero(own == c))]


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products whose bits depend on the two vectors alone, not on what else is scored with them."""
    return np.add.accumulate(rows * query, axis=1)[:, -1] if rows.shape[1] else np.zeros(len(rows))


def nearest(ids: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows but own, given rough scores (-inf: not visited)."""
    rough = np.where(ids == own, -np.inf, rough)
    k = min(k, int(np.isfinite(rough).sum()))
    if not k:
        return ids[:0], np.zeros(0)
    bar = np.partition(rough, len(rough) - k)[len(rough) - k]
    slack = SLACK * np.linalg.norm(query) * np.linalg.norm(rows, axis=1).max()
    some = np.flatnonzero(rough >= bar - slack)
    scores = exact_scores(rows[some], query)
    best = np.lexsort((ids[some], -scores))[:k]
    return ids[some][best], scores[best]


def _calibrated(tree: Tree, items: DataFrame, queries: DataFrame, k: int) -> tuple[int, float]:
    """How many leaves to visit, and the recall measured with so many. CALIBRATION queries, and k rows a task and query, reach the driver at most."""
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toPandas()
    ids, asked = chosen["id"].to_numpy(), matrix(chosen["v"], len(tree.centres[0]))
    shared = items.sparkSession.sparkContext.broadcast((tree, ids, asked))

    def brute(batches):
        tree, ids, asked = shared.value
        for b in batches:
            if len(b):
                own, x = b["id"].to_numpy(), matrix(b["v"], asked.shape[1])
                at, rough = dict(zip(own, tree.assign(x), strict=True)), asked @ x.T
                for q in range(len(ids)):
                    near, scores = nearest(own, x, ids[q], asked[q], rough[q], k)
                    yield pd.DataFrame({"query_id": q, "vec_id": near, "score": scores, "leaf": [at[i] for i in near]})

    found = items.mapInPandas(brute, "query_id int, vec_id long, score double, leaf int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).select("query_id", "leaf").toPandas()
    place = [{leaf: p for p, leaf in enumerate(tree.best_bins(q, tree.leaves))} for q in asked]
    visits = np.array([place[q][leaf] for q, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
    n = 1
    while n < tree.leaves and len(visits) and (visits < n).mean() < RECALL:
        n += 1
    return n, float((visits < n).mean()) if len(visits) else 1.0


def search(items: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of items (id, v) that is a query, the k nearest other rows found.

    leaves, visits and recall, the same in every row, tell how many leaves the tree has, how many of them a query visits at
    least, and the share of the true k nearest that the calibration queries found there.
    """
    spark = items.sparkSession
    items = staged(items, "ann")
    queries = items.where(is_query)
    n, n_queries, width = (x or 0 for x in items.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first())
    sample = items.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    tree = Tree.fit(matrix(sample["v"], width), min(MOST_LEAVES, max(LEAST_LEAVES, math.ceil(n / LEAF_ROWS))))
    visits, recall = _calibrated(tree, items, queries, k)
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.assign(matrix(v, width)))

    rows = staged(items.withColumn("leaf", leaf_of("v")), "ann-leaves")
    counts = dict(rows.groupBy("leaf").count().collect())  # MOST_LEAVES rows at most
    sizes = [counts.get(leaf, 0) for leaf in range(tree.leaves)]
    blocks: list[tuple[int, int]] = []  # of each leaf: its first block, and how many it has
    last, filled = 0, 0
    for size in sizes:
        if filled and filled + size > ROWS_PER_BLOCK:
            last, filled = last + 1, 0
        pieces = blocks_of(size, ROWS_PER_BLOCK)
        blocks.append((last, pieces))
        last, filled = (last + pieces - 1, filled + size) if pieces == 1 else (last + pieces, 0)
    deal = spark.sparkContext.broadcast(blocks)

    @F.pandas_udf("int")
    def block_of(leaf: pd.Series, draw: pd.Series) -> pd.Series:
        first, pieces = np.array(deal.value).T
        return pd.Series(first[leaf] + draw.to_numpy() % pieces[leaf])

    @F.pandas_udf("array<int>")
    def bins_of(v: pd.Series) -> pd.Series:
        return pd.Series([sorted(shared.value.best_bins(q, visits, sizes, k + 1)) for q in matrix(v, width)])

    @F.pandas_udf("array<int>")
    def blocks_for(bins: pd.Series) -> pd.Series:
        return pd.Series([sorted({b for leaf in x for b in range(deal.value[leaf][0], sum(deal.value[leaf]))}) for x in bins])

    rows = rows.withColumn("block", block_of("leaf", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")))
    asked = in_blocks(queries, blocks_of(n_queries, QUERIES_PER_BLOCK), "qblock").withColumn("bins", bins_of("v"))
    asked = asked.withColumn("block", F.explode(blocks_for("bins")))

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids, x, leaf = block["id"].to_numpy(), matrix(block["v"], width), block["leaf"].to_numpy()
        out = []
        for at in range(0, len(asked), 128):
            some = asked.iloc[at : at + 128]
            q = matrix(some["v"], width)
            rough = q @ x.T
            for i, (own, bins) in enumerate(zip(some["id"], some["bins"], strict=True)):
                near, scores = nearest(ids, x, own, q[i], np.where(np.isin(leaf, bins), rough[i], -np.inf), k)
                out.append((own, near, scores))
        return pd.DataFrame({
            "query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64),
            "vec_id": np.concatenate([o[1] for o in out]),
            "score": np.concatenate([o[2] for o in out]),
        })

    told = [F.lit(x).alias(name) for name, x in (("leaves", tree.leaves), ("visits", visits), ("recall", recall))]
    return search_blocks(rows, asked, run, k).select("*", *told)


def searchable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that can be near to anything: vectors.clean without zero vectors."""
    return clean(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0))

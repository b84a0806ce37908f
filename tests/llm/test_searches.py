"""Exact and approximate nearest rows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, queries, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, id int, v string"  # clashing names


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def brute(rows, every, k):
    parts = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    out = {}
    for q, w in parts:
        if q % every == 0:
            scores = [(int((w * x).sum()), i) for i, x in parts if i != q]
            out[q] = [(i, s) for s, i in sorted(scores, key=lambda t: (-t[0], t[1]))[:k]]
    return {q: v for q, v in out.items() if v}


def random_rows(n, dims=6, seed=1, distinct=40):
    rng = np.random.default_rng(seed)
    pool = rng.normal(size=(distinct, dims)).astype(np.float32)
    return [(i, pool[rng.integers(distinct)].tolist()) for i in range(n)]  # many ties


def test_top_k_against_brute_force(spark, monkeypatch):
    rows = random_rows(700)
    monkeypatch.setattr(topk, "RESOLVED", 20)
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    found = topk.top_k(topk.quantised(table(spark, rows)), F.col("id") % 50 == 0, 5)
    assert rows_of(found) == brute(rows, 50, 5)


def test_bounds_stop_early_and_are_exact():
    rng = np.random.default_rng(0)
    values = np.floor(256 * rng.normal(size=(3000, 4)))
    lists = topk.SortedLists(np.arange(3000), values)
    queries = np.stack([np.array([9.0, 0, 0, 0]), np.array([-3.0, 2, 0, 1]), np.zeros(4)])
    for (ids, scores), q in zip(lists.search(queries, np.array([5, 6, 7]), 5), queries, strict=True):
        want = (values @ q).astype(int)
        assert (want[ids] == scores).all()
    first = lists.search(queries[:1], np.array([5]), 5)[0]
    want = values @ queries[0]
    want[5] = -np.inf
    assert first[0].tolist() == np.lexsort((np.arange(3000), -want))[:5].tolist()


ODD = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, [None, 1.0]), (None, [1.0, 1.0]), (300, [1.0]), (1, []), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])]


def test_top_k_odd_rows(spark):
    found = rows_of(topk.top_k(topk.quantised(table(spark, ODD)), F.col("id") % 50 == 0, 5))
    assert set(found) == {0, 50, 300}
    assert found[0] == [(300, 65536), (2, 32768), (1, 0), (50, 0), (3, -65536)]
    assert [i for i, _ in found[50]] == [0, 1, 2, 3, 300]
    assert found[300][0] == (0, 65536)


@pytest.mark.parametrize("search", [lambda d: topk.top_k(topk.quantised(d), F.col("id") % 50 == 0, 5), lambda d: ann.search(ann.searchable(d), F.col("id") % 20 == 0, 5)])
def test_empty_tables(spark, search):
    empty = spark.createDataFrame([], SCHEMA)
    assert search(empty).collect() == []
    assert search(table(spark, [(0, [1.0])])).collect() == []
    assert search(table(spark, [(1, [1.0]), (2, [2.0])])).collect() == []


def nearest(rows, every, k):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [int(ids[j]) for j in order]
    return out


def test_ann_recall(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    monkeypatch.setattr(ann, "ROWS_PER_BLOCK", 400)
    found = rows_of(ann.search(ann.searchable(table(spark, rows)), F.col("id") % 20 == 0, 20))
    truth = nearest(rows, 20, 20)
    assert set(found) == set(truth) and all(len(v) == 20 for v in found.values())
    recall = np.mean([len({i for i, _ in found[q]} & set(truth[q])) / 20 for q in truth])
    assert recall >= 0.9
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in found.items():
        assert [i for i, _ in near] == [i for i, _ in sorted(near, key=lambda t: (-t[1], t[0]))]
        assert all(s == pytest.approx(float(x[q] @ x[i]), abs=1e-12) for i, s in near)


def test_ann_with_a_hot_vector(spark, monkeypatch):
    """A third of the rows are one vector: its leaf is cut into blocks, and ties go to smaller ids."""
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    monkeypatch.setattr(ann, "ROWS_PER_BLOCK", 64)
    rng = np.random.default_rng(4)
    rows = [(i, [3.0, 3.0, 3.0, 3.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(900)]
    found = rows_of(ann.search(ann.searchable(table(spark, rows)), F.col("id") % 60 == 0, 7))
    assert [i for i, _ in found[60]] == [0, 3, 6, 9, 12, 15, 18]


def test_ann_odd_rows(spark):
    found = rows_of(ann.search(ann.searchable(table(spark, ODD)), F.col("id") % 50 == 0, 20))
    assert set(found) == {0, 300} and [i for i, _ in found[0]] == [300, 2, 3] and [i for i, _ in found[300]] == [0, 2, 3]


@pytest.mark.parametrize("n", [500, 2_000])
def test_ann_walks_a_tree_at_every_size(spark, n):
    """With the registered parameters, in tables like the small ones: a tree of two levels or more, and few misses."""
    rng = np.random.default_rng(n)
    middles = rng.normal(size=(40, 16))
    rows = [(i, (middles[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(n)]
    found = ann.search(ann.searchable(table(spark, rows)), F.col("id") % 20 == 0, 20).toPandas()
    assert set(found["leaves"]) == {max(4, -(-n // 128))} and (found["visits"] < found["leaves"]).all() and (found["recall"] >= ann.RECALL).all()
    truth = nearest(rows, 20, 20)
    hits = found.groupby("query_id")["vec_id"].agg(set)
    assert np.mean([len(hits[q] & set(truth[q])) / 20 for q in truth]) >= 0.9


@pytest.mark.parametrize("leaves", [4, 16, 40, 400])
def test_tree_has_two_levels(leaves):
    tree = ann.Tree.fit(np.random.default_rng(3).normal(size=(3_000, 8)), leaves)
    assert any(tree.children[child] for child in tree.children[0]) and leaves - 11 <= tree.leaves <= leaves


def test_tree_holds_every_row_in_one_leaf():
    x = np.random.default_rng(2).normal(size=(2000, 8))
    tree = ann.Tree.fit(x, 50)
    leaf = tree.assign(x)
    assert leaf.min() >= 0 and leaf.max() < tree.leaves <= 50
    assert sorted(tree.best_bins(x[0], tree.leaves)) == list(range(tree.leaves))
    assert len(tree.best_bins(x[0], 1, np.bincount(leaf, minlength=tree.leaves).tolist(), 300)) > 1


def test_clean_takes_the_least_vector_of_an_id(spark):
    found = vectors.clean(table(spark, [(1, [2.0]), (1, [1.0, 9.0])]), "vec_id", "embedding").collect()
    assert [(r["id"], r["v"]) for r in found] == [(1, [1.0, 9.0])]


def test_all_ten_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))

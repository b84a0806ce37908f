"""Top-k: order, ties, guards, filters, batches."""

import random

import pytest

from lodestar.operators import metadata as md
from lodestar.operators import search
from lodestar.types import METADATA, Metric, tagged

ROWS = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.5, 0.5, 0.0]), (4, [0.2, 0.1, 0.7]), (5, [-1.0, 0.0, 0.0])]


def rows(spark, data=ROWS):
    return spark.createDataFrame(data, "id bigint, values array<float>")


def ids(found):
    return [r["id"] for r in found.orderBy("rank").collect()]


def test_best_first(spark):
    assert ids(search.top_k(rows(spark), [1, 0, 0], 3, 3, Metric.dot_product)) == [1, 3, 4]


def test_guards(spark):
    assert ids(search.top_k(rows(spark), [1, 0, 0], 0, 3)) == []
    assert ids(search.top_k(rows(spark), [1, 0], 3, 3)) == []
    assert len(ids(search.top_k(rows(spark), [1, 0, 0], 100, 3))) == 5
    assert ids(search.top_k(rows(spark, []), [1, 0, 0], 5, 3)) == []


def test_ties_go_to_the_smaller_id_and_nan_comes_last(spark):
    data = [(9, [1.0]), (4, [1.0]), (7, [float("nan")]), (1, [0.5])]
    assert ids(search.top_k(rows(spark, data), [1], 4, 1, Metric.dot_product)) == [4, 9, 1, 7]
    assert ids(search.top_k(rows(spark, data), [1], None, 1, Metric.dot_product)) == [4, 9, 1, 7]


def test_rows_of_other_dimensions_are_passed_over(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0]), (3, None)]
    assert ids(search.top_k(rows(spark, data), [1, 0], 5, 2)) == [1]


@pytest.mark.parametrize("metric", list(Metric))
def test_batch_equals_single_queries(spark, metric, monkeypatch):
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    queries = spark.createDataFrame([(i, data[i][1]) for i in range(9)], "query_id bigint, q array<float>")
    for most in (1_024, 4):  # broadcast, and in blocks
        monkeypatch.setattr(search, "QUERIES_PER_BLOCK", most)
        monkeypatch.setattr(search, "ROWS_PER_BLOCK", 16)
        found = search.batch_top_k(rows(spark, data), queries, 5, 4, metric).collect()
        for i in range(9):
            mine = [(r["rank"], r["id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == i]
            one = search.top_k(rows(spark, data), data[i][1], 5, 4, metric).orderBy("rank").collect()
            assert mine == [(r["rank"], r["id"], r["score"]) for r in one]


def test_full_ranking_equals_sorting(spark):
    rng = random.Random(5)
    data = [(i, [rng.choice([0.0, 0.5, 1.0])]) for i in range(200)]
    found = search.top_k(rows(spark, data), [1.0], None, 1, Metric.dot_product).orderBy("rank").collect()
    assert [r["id"] for r in found] == [i for i, _ in sorted(data, key=lambda x: (-x[1][0], x[0]))]
    assert [r["rank"] for r in found] == list(range(1, 201))


META = [(1, "book", "en"), (2, "book", "en"), (3, "movie", "en"), (4, "book", "de")]


def filtered_input(spark):
    vectors = rows(spark, [(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.9, 0.0]), (4, [0.7, 0.0])])
    meta = spark.createDataFrame([(i, {"category": tagged(c), "lang": tagged(x)}) for i, c, x in META], f"id bigint, metadata {METADATA}")
    return vectors, meta


def test_filters(spark):
    vectors, meta = filtered_input(spark)
    wanted = [("category", "book"), ("lang", "en")]
    assert ids(search.filtered_top_k(vectors, meta, wanted, [1, 0], 2, 2, Metric.dot_product)) == [1, 2]
    assert ids(search.post_filtered_top_k(vectors, meta, wanted, [1, 0], 2, 2, Metric.dot_product)) == [1, 2]
    found = md.lookup_all(md.build_index(meta), wanted)
    assert ids(search.candidates_top_k(vectors, found, [1, 0], 2, 2, Metric.dot_product)) == [1, 2]
    assert ids(search.filtered_top_k(vectors, meta, [("category", "song")], [1, 0], 2, 2)) == []
    assert ids(search.filtered_top_k(vectors, meta, [("year", 1999)], [1, 0], 2, 2)) == []
    assert ids(search.filtered_top_k(vectors, meta, [], [1, 0], 9, 2, Metric.dot_product)) == [1, 3, 4, 2]
    assert ids(search.filtered_top_k(vectors, meta, wanted, [1], 2, 2)) == []


def test_one_query_plans_no_shuffle(spark):
    plan = search.scored(rows(spark), [1.0, 0.0, 0.0], 3, Metric.cosine).orderBy("score").limit(2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan

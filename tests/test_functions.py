"""Scores of vectors: hand-calculated values and edge cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.functions import vectors as vec
from lodestar.types import Metric

CASES = [
    ("dot", (1, 2, 3), (1, 2, 3), 14),
    ("dot", (1, 2), (-1, -2), -5),
    ("dot", (2, 3), (4, 5), 23),
    ("dot", (), (), 0),
    ("cosine", (3, 4), (4, 3), 0.96),
    ("cosine", (0, 0, 0), (1, 2, 3), 0),
    ("cosine", (1, 2, 3), (0, 0, 0), 0),
    ("cosine", (0, 0), (0, 0), 0),
    ("cosine", (1, 2, 3), (-1, -2, -3), -1),
    ("cosine", (), (), 0),
    ("squared_euclidean", (1, 2), (4, 6), 25),
    ("squared_euclidean", (0, 0), (3, 4), 25),
    ("squared_euclidean", (), (), 0),
]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name,a,b,expected", CASES)
def test_values(spark, name, a, b, expected):
    assert value(spark, getattr(vec, name)(a, b)) == pytest.approx(expected, abs=1e-6)


def test_euclidean_score_is_negated_square_and_zero_for_itself(spark):
    assert value(spark, vec.score((0, 0), (3, 4), Metric.euclidean)) == -25
    itself = value(spark, vec.score((1, 2), (1, 2), Metric.euclidean))
    assert itself == 0 and math.copysign(1, itself) == 1


def test_large_and_small_components(spark):
    assert value(spark, vec.dot((1e6, 1e-6), (1e6, 0))) == pytest.approx(1e12, abs=1e6)


def test_underflowing_norms_score_zero(spark):
    assert value(spark, vec.cosine((1e-30, 0), (1e-30, 0))) == 0


def test_dimensions_and_finiteness(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([float("nan"), 1.0],), ([1.0, None],)], "v array<float>")
    assert [r[0] for r in rows.select(vec.has_dimensions("v", 2)).collect()] == [True, False, False, True, True]
    assert [r[0] for r in rows.select(vec.is_finite("v")).collect()] == [True, True, None, False, False]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-100, 100, width=32), min_size=1, max_size=6))
def test_dot_is_a_sequential_float32_sum(spark, xs):
    total = np.float32(0)
    for x in np.array(xs, np.float32):
        total = np.float32(total + np.float32(x * x))
    assert value(spark, vec.dot(xs, xs)) == pytest.approx(float(total), rel=0, abs=0)

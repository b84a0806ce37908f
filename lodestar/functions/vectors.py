"""Scores of float vectors as column expressions.

All arithmetic is 32-bit and runs from left to right, so a score has the same bits wherever it is computed. The
higher-order functions stay in the JVM. Vectors of unequal length have no score: guard with has_dimensions().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.types import Metric

Vector = Column | str | Sequence[float]


def vector(v: Vector) -> Column:
    """A column of array<float>: a column, the name of one, or numbers."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<float>") if len(v) else F.array().cast("array<float>")


def _zero() -> Column:
    return F.lit(0.0).cast("float")


def dot(a: Vector, b: Vector) -> Column:
    """Sum of products; 0 for empty vectors."""
    return F.aggregate(F.zip_with(vector(a), vector(b), lambda x, y: x * y), _zero(), lambda s, x: s + x)


def squared_euclidean(a: Vector, b: Vector) -> Column:
    """Sum of squared differences, without a root; 0 for empty vectors."""
    return F.aggregate(F.zip_with(vector(a), vector(b), lambda x, y: (x - y) * (x - y)), _zero(), lambda s, x: s + x)


def l2_norm(a: Vector) -> Column:
    """Root of the sum of squares, rounded to a float."""
    return F.sqrt(dot(a, a)).cast("float")


def cosine(a: Vector, b: Vector, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if a norm, or their product, is 0. Norms that are known spare their computation."""
    norms = ((l2_norm(a) if norm_a is None else norm_a) * (l2_norm(b) if norm_b is None else norm_b)).cast("float")
    return F.when(norms == 0, _zero()).otherwise(F.try_divide(dot(a, b), norms).cast("float"))


def score(a: Vector, b: Vector, metric: Metric, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """The score under a metric, higher is better: euclidean is the negated squared distance."""
    if metric is Metric.dot_product:
        return dot(a, b)
    if metric is Metric.euclidean:
        return _zero() - squared_euclidean(a, b)  # not -x, which makes -0.0 of 0
    return cosine(a, b, norm_a, norm_b)


def has_dimensions(v: Vector, dimensions: int) -> Column:
    """Whether a vector has the dimensions of its collection; false for null."""
    return F.coalesce(F.size(vector(v)) == dimensions, F.lit(False))


def is_finite(v: Vector) -> Column:
    """Whether all components are finite numbers."""
    return F.forall(vector(v), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))

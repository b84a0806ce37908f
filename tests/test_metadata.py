"""Typed values, the inverted index and posting lists."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import metadata as md
from lodestar.types import METADATA, tagged, untagged


def meta(spark, rows):
    return spark.createDataFrame([(i, None if m is None else {k: tagged(v) for k, v in m.items()}) for i, m in rows], f"id bigint, metadata {METADATA}")


def found(df):
    return sorted(r["id"] for r in df.collect())


def test_values_keep_their_type():
    for v in (-3, 2.5, False, "x", True, 0):
        assert untagged(tagged(v)) == v and type(untagged(tagged(v))) is type(v)
    assert tagged(True)["t"] == "bool"
    with pytest.raises(ValueError):
        tagged(float("nan"))
    with pytest.raises(ValueError):
        tagged(1 << 63)
    with pytest.raises(TypeError):
        tagged([1])


def test_types_do_not_collide(spark):
    index = md.build_index(meta(spark, [(1, {"x": 42}), (2, {"x": "42"}), (3, {"x": 42.0}), (4, {"x": True}), (5, {"x": 1})]))
    for value, expected in ((42, [1]), ("42", [2]), (42.0, [3]), (True, [4]), (1, [5])):
        assert found(md.lookup(index, "x", value)) == expected


def test_index_changes(spark):
    a = meta(spark, [(1, {"k": "a", "n": 1}), (2, {"k": "a"}), (3, None), (4, {})])
    index = md.build_index(a)
    assert found(md.lookup(index, "k", "a")) == [1, 2]
    assert found(md.lookup(index, "k", "zzz")) == [] and found(md.lookup(index, "zzz", "a")) == []
    less = md.index_remove(index, meta(spark, [(1, {"k": "a", "n": 1})]))
    assert found(md.lookup(less, "k", "a")) == [2]
    assert less.where("field = 'n'").count() == 0
    moved = md.index_update(index, meta(spark, [(2, {"k": "a"})]), meta(spark, [(2, {"k": "b"})]))
    assert found(md.lookup(moved, "k", "a")) == [1] and found(md.lookup(moved, "k", "b")) == [2]
    assert md.index_add(index, a).count() == index.count()


def test_all_keys(spark):
    index = md.build_index(meta(spark, [(1, {"a": 1, "b": 2}), (2, {"a": 1}), (3, {"a": 1, "b": 2}), (4, {"a": "1", "b": 2})]))
    assert found(md.lookup_all(index, [("a", 1), ("b", 2)])) == [1, 3]
    assert found(md.lookup_all(index, [("a", 1), ("a", 1)])) == [1, 2, 3]
    assert found(md.lookup_all(index, [])) == []
    assert found(md.lookup_all(index, [("a", 1), ("c", 1)])) == []


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def longs(*xs):
    return F.array(*map(F.lit, xs)).cast("array<bigint>")


def test_posting_lists(spark):
    ids = longs()
    for i in (5, 1, 3, 1):
        ids = md.posting_insert(ids, F.lit(i).cast("bigint"))
    assert one(spark, ids) == [1, 3, 5]
    assert one(spark, md.posting_erase(ids, F.lit(3).cast("bigint"))) == [1, 5]
    assert one(spark, md.posting_contains(ids, F.lit(5).cast("bigint"))) is True
    assert one(spark, md.posting_intersect(longs(1, 3, 5, 7), longs(3, 4, 5, 9))) == [3, 5]
    assert one(spark, md.posting_intersect(longs(1, 2, 4), longs(2, 4, 6), longs(0, 2, 4))) == [2, 4]
    assert one(spark, md.posting_intersect(longs(9, 1, 4, 4, 7, 2), longs(7, 0, 4, 8, 1))) == [1, 4, 7]
    assert one(spark, md.posting_intersect()) == []


def test_a_field_of_another_type_is_a_miss(spark):
    rows = meta(spark, [(1, {"i": -3, "d": 2.5, "b": False, "s": "x"})])
    values = [rows.select(md.read_field("metadata", f, k)).first()[0] for f, k in (("i", "int64"), ("d", "double"), ("b", "bool"), ("s", "string"), ("i", "string"), ("none", "bool"))]
    assert values == [-3, 2.5, False, "x", None, None]

"""Typed metadata: equality predicates, the inverted index, posting lists.

Metadata is a map of typed values. Equality compares the type and then the payload, so the int64 42, the double 42.0
and the string "42" are three keys. The index is a relation (field, value, id); a posting list is the ids of one key,
sorted and without repeats.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.types import Scalar, tagged, tagged_literal

Predicates = Mapping[str, Scalar] | Sequence[tuple[str, Scalar]]


def _same(value: Column, wanted: Scalar) -> Column:
    """Whether a typed value equals a Python value: the type, then the one field that has the payload."""
    row = tagged(wanted)
    field = {"int64": "i", "double": "d", "bool": "b", "string": "s"}[row["t"]]
    return F.coalesce((value["t"] == row["t"]) & (value[field] == F.lit(row[field])), F.lit(False))


def matches(metadata: str | Column, predicates: Predicates) -> Column:
    """Whether metadata meets all equality predicates; a missing field meets none."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    wanted = predicates.items() if isinstance(predicates, Mapping) else predicates
    return reduce(lambda a, b: a & b, [_same(m[field], value) for field, value in wanted], F.lit(True))


def read_field(metadata: str | Column, field: str, kind: str) -> Column:
    """The payload of a field if it has the kind int64, double, bool or string; else null."""
    value = (F.col(metadata) if isinstance(metadata, str) else metadata)[field]
    return F.when(value["t"] == kind, value[{"int64": "i", "double": "d", "bool": "b", "string": "s"}[kind]])


def build_index(metadata: DataFrame) -> DataFrame:
    """(field, value, id) of a table (id, metadata). Null values are not indexed."""
    rows = metadata.select("id", F.explode("metadata").alias("field", "value"))
    return rows.where(F.col("value").isNotNull()).select("field", "value", "id").distinct()


def index_add(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """The index with the entries of more metadata."""
    return index.unionByName(build_index(metadata)).distinct()


def index_remove(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """The index without the entries of some metadata. Keys that lose their last id vanish."""
    return index.join(build_index(metadata), ["field", "value", "id"], "left_anti")


def index_update(index: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The index with old metadata replaced by new."""
    return index_add(index_remove(index, old), new)


def lookup(index: DataFrame, field: str, value: Scalar) -> DataFrame:
    """(id): the ids of one key, as rows; none for an unknown key."""
    return index.where((F.col("field") == field) & _same(F.col("value"), value)).select("id").distinct()


def lookup_all(index: DataFrame, predicates: Predicates) -> DataFrame:
    """(id): the ids that all keys have, in one pass: an id must meet as many keys as are wanted. No keys: no ids."""
    wanted = list(dict.fromkeys((f, tagged(v)["t"], v) for f, v in (predicates.items() if isinstance(predicates, Mapping) else predicates)))
    if not wanted:
        return index.select("id").limit(0)
    number = F.lit(None).cast("int")
    for n, (field, _, value) in enumerate(wanted):
        number = F.when((F.col("field") == field) & _same(F.col("value"), value), n).otherwise(number)
    hits = index.select("id", number.alias("n")).where("n IS NOT NULL")
    return hits.groupBy("id").agg(F.count_distinct("n").alias("n")).where(F.col("n") == len(wanted)).select("id")


def postings(index: DataFrame) -> DataFrame:
    """(field, value, ids): each key's posting list. For keys whose lists fit in memory; else use the rows of the index."""
    return index.groupBy("field", "value").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def posting_insert(ids: Column, id: Column) -> Column:
    """A posting list with an id."""
    return F.array_sort(F.array_union(ids, F.array(id)))


def posting_erase(ids: Column, id: Column) -> Column:
    """A posting list without an id; whether it was there is posting_contains before."""
    return F.array_remove(ids, id)


def posting_contains(ids: Column, id: Column) -> Column:
    return F.array_contains(ids, id)


def posting_intersect(*lists: Column) -> Column:
    """What all posting lists have in common; nothing of no lists."""
    if not lists:
        return F.array().cast("array<bigint>")
    return F.array_sort(F.array_distinct(reduce(F.array_intersect, lists)))


def typed_map(fields: Mapping[str, Column]) -> Column:
    """A metadata map of typed value columns; fields whose value is null are left out."""
    entries = F.array(*[F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def literal_map(fields: Mapping[str, Scalar]) -> Column:
    return typed_map({name: tagged_literal(value) for name, value in fields.items()})

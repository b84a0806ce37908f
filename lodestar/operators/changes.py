"""Batches of inserts, updates and removes as window functions over ids, with a status for each operation.

An id's operations in order of seq decide its liveness: a good insert makes it live (a bad one finds it live already), a
remove leaves it dead in either case, an update changes nothing about it. So the liveness before an operation is that
after the last insert or remove before it, and the statuses, the final vectors and the final metadata follow from it,
in one shuffle by id, without a loop over operations. An id with very many operations is one window group; it is sorted
with spilling, but in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import has_dimensions
from lodestar.types import METADATA

INSERT, UPDATE, REMOVE, SET_METADATA = "insert", "update", "remove", "set_metadata"


def statuses(ops: DataFrame, dimensions: int, base: DataFrame | None = None) -> DataFrame:
    """ops (seq, op, id, values, metadata) with status, given the ids (id) that are live before. Bad operations do nothing.

    The checks come in this order: dimensions, then liveness. An unknown op, or a null id, is an invalid_argument.
    """
    op, fits = F.col("op"), has_dimensions("values", dimensions)
    after = F.when((op == INSERT) & fits, True).when(op == REMOVE, False)
    by_id = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    if base is None:
        rows = ops.withColumn("_base", F.lit(False))
    else:
        ids = base.select(F.col("id").alias("_id"), F.lit(True).alias("_known")).distinct()
        rows = ops.join(ids, F.col("id") == F.col("_id"), "left").withColumn("_base", F.coalesce("_known", F.lit(False))).drop("_id", "_known")
    live = F.coalesce(F.last(after, ignorenulls=True).over(by_id), F.col("_base"))
    rows = rows.withColumn("_live", live)
    status = (
        F.when(F.col("id").isNull() | ~F.coalesce(op.isin(INSERT, UPDATE, REMOVE, SET_METADATA), F.lit(False)), "invalid_argument")
        .when(op.isin(INSERT, UPDATE) & ~fits, "dimension_mismatch")
        .when((op == INSERT) & F.col("_live"), "duplicate_id")
        .when((op != INSERT) & ~F.col("_live"), "not_found")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).drop("_base", "_live")


def final_versions(judged: DataFrame) -> DataFrame:
    """(id, is_deleted, values): what good operations leave of every id that they touch."""
    moves = judged.where((F.col("status") == "ok") & F.col("op").isin(INSERT, UPDATE, REMOVE))
    last = moves.groupBy("id").agg(F.max_by(F.struct("op", "values"), "seq").alias("v"))
    gone = F.col("v.op") == REMOVE
    return last.select("id", gone.alias("is_deleted"), F.when(~gone, F.col("v.values")).alias("values"))


def final_metadata(judged: DataFrame) -> DataFrame:
    """(id, metadata): the metadata that good operations leave; null where a remove cleared it, or an insert had none.

    Updates of vectors leave metadata alone; setting metadata replaces all of it; an empty map is none.
    """
    moves = judged.where((F.col("status") == "ok") & F.col("op").isin(INSERT, SET_METADATA, REMOVE))
    last = moves.groupBy("id").agg(F.max_by(F.struct("op", "metadata"), "seq").alias("v"))
    kept = F.when((F.col("v.op") != REMOVE) & (F.size("v.metadata") > 0), F.col("v.metadata"))
    return last.select("id", kept.cast(METADATA).alias("metadata"))


def apply(base: DataFrame | None, versions: DataFrame) -> DataFrame:
    """(id, values): live rows after versions (id, is_deleted, values) come over a base (id, values)."""
    if base is None:
        return versions.where("NOT is_deleted").select("id", "values")
    kept = base.select("id", "values").join(versions.select("id"), "id", "left_anti")
    return kept.unionByName(versions.where("NOT is_deleted").select("id", "values"))


def first_error(log: DataFrame, dimensions: int) -> DataFrame:
    """(lsn): the least lsn whose record can't be applied: an unknown operation, or a vector of other dimensions; or null."""
    bad = ~F.coalesce(F.col("op").isin(INSERT, UPDATE, "delete", "checkpoint"), F.lit(False)) | (F.col("op").isin(INSERT, UPDATE) & ~has_dimensions("values", dimensions))
    return log.where(bad).agg(F.min("lsn").alias("lsn"))


def replayed(log: DataFrame, dimensions: int, base: DataFrame | None = None) -> DataFrame:
    """(id, is_deleted, values): what replaying a log (lsn, op, id, values) leaves of the ids that it touches.

    Replay is idempotent: an insert of a live id keeps the old value, an update of a dead one inserts, a delete of a dead
    one does nothing. It stops before the first record that can't be applied.
    """
    stop = first_error(log, dimensions).select(F.col("lsn").alias("_stop"))
    good = log.join(F.broadcast(stop), F.lit(True)).where(F.col("_stop").isNull() | (F.col("lsn") < F.col("_stop"))).where(F.col("op") != "checkpoint")
    if base is None:
        rows = good.withColumn("_base", F.lit(False)).withColumn("_old", F.lit(None).cast("array<float>"))
    else:
        known = base.select(F.col("id").alias("_id"), F.col("values").alias("_old"), F.lit(True).alias("_known"))
        rows = good.join(known, F.col("id") == F.col("_id"), "left").withColumn("_base", F.coalesce("_known", F.lit(False)))
    before = Window.partitionBy("id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    live = F.coalesce(F.last(F.col("op") != "delete").over(before), F.col("_base"))
    rows = rows.withColumn("_sets", (F.col("op") == UPDATE) | ((F.col("op") == INSERT) & ~live))
    last_op = F.max_by("op", "lsn")
    value = F.max_by(F.when(F.col("_sets"), F.struct(F.col("values").alias("x"))), F.when(F.col("_sets"), F.col("lsn")))["x"]
    done = rows.groupBy("id").agg((last_op == "delete").alias("is_deleted"), value.alias("values"), F.first("_old").alias("_old"))
    return done.select("id", "is_deleted", F.when(~F.col("is_deleted"), F.coalesce("values", "_old")).alias("values"))


def next_lsn(log: DataFrame) -> DataFrame:
    """(next_lsn): one more than the largest lsn; 1 for an empty log."""
    return log.agg((F.coalesce(F.max("lsn"), F.lit(0)) + 1).cast("long").alias("next_lsn"))

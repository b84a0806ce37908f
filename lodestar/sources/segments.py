"""Immutable segments as Parquet datasets, listed by a manifest: flush, compaction, and reading what is visible."""

from __future__ import annotations

import logging

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import has_dimensions
from lodestar.operators.visibility import compacted, newest, point_get, versions
from lodestar.sources.files import Files
from lodestar.sources.manifest import Manifest, next_segment
from lodestar.sources.memtable import Memtable
from lodestar.types import ROWS, Status

log = logging.getLogger(__name__)


FLUSH_THRESHOLD = 1024
#: What Spark says of a segment that is missing, or whose files are no Parquet.
_DAMAGED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "FileNotFoundException")


class NoSegment(ValueError):
    """A table whose columns are not a segment's."""


class SegmentStore:
    """The segments of a folder, and the memtable of what is written next.

    A segment is written in full before the manifest lists it, and a manifest is published before anything is forgotten;
    so a crash leaves the old state or the new one, and at most an unlisted folder.
    """

    def __init__(self, spark: SparkSession, dimensions: int, on_corrupt: str = "fail", flush_threshold_rows: int = FLUSH_THRESHOLD):
        """on_corrupt: whether reads "fail" on a segment that is missing or damaged, or "skip" it, with a warning."""
        self.spark, self.dimensions, self.on_corrupt = spark, dimensions, on_corrupt
        self.folder, self.manifest, self.files = "", Manifest(), None
        self.memtable = Memtable(dimensions, flush_threshold_rows)
        self._known: dict[str, DataFrame] = {}  # segments never change

    def open(self, folder: str) -> Status:
        """Take a folder, which is made if need be, and read its manifest."""
        if not folder:
            return Status.invalid_argument
        files, manifest = Files(self.spark, folder), Manifest()
        files.make_folder(folder)
        status = manifest.load(files, folder)
        if status is Status.ok:
            self.folder, self.manifest, self.files, self._known = folder.rstrip("/"), manifest, files, {}
        return status

    @property
    def is_open(self) -> bool:
        return bool(self.folder)

    def read(self, name: str, on_corrupt: str | None = None) -> DataFrame | None:
        """One segment; None if it is missing or damaged and such segments are to be skipped. Any other failure is raised."""
        if name in self._known:
            return self._known[name]
        try:
            found = self.spark.read.parquet(f"{self.folder}/{name}")
            if found.columns != ["id", "is_deleted", "values"]:
                raise NoSegment(name)
        except (PySparkException, NoSegment) as error:
            damaged = isinstance(error, NoSegment) or any(said in str(error) for said in _DAMAGED)
            if not damaged or (on_corrupt or self.on_corrupt) == "fail":
                raise
            log.warning("segment %s is skipped: %s", name, str(error).splitlines()[0])
            return None
        self._known[name] = found
        return found

    def positions(self, name: str) -> DataFrame:
        """(id, at): the place of every row of a segment, from 0, over its files in the order of the partitions written.

        The files themselves tell a row's place, so it doesn't depend on the splits in which they are read.
        """
        rows = self.read(name, "fail").select("id", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = [F.regexp_extract("_file", r"^part-(\d+)-.*-c(\d+)", k).try_cast("bigint") for k in (1, 2)]
        sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy(*order, "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select("_file", before.alias("_before"))  # a row for each file
        return rows.join(F.broadcast(starts), "_file").select("id", (F.col("_before") + F.col("_row")).alias("at"))

    def segments(self, on_corrupt: str | None = None) -> list[DataFrame]:
        """The listed segments, oldest first."""
        return [df for name in self.manifest.segments if (df := self.read(name, on_corrupt)) is not None]

    def put(self, id: int, values: Sequence[float]) -> Status:
        """Write a row to the memtable, which is flushed once it is full."""
        status = self.memtable.put(id, values)
        return self._flush_if_full() if status is Status.ok else status

    def remove(self, id: int) -> Status:
        """Write a tombstone to the memtable. That is always ok, also for an id that was never written."""
        self.memtable.tombstone(id)
        return self._flush_if_full()

    def _flush_if_full(self) -> Status:
        return self.flush() if self.is_open and self.memtable.needs_flush() else Status.ok

    def flush(self) -> Status:
        """Write the memtable as a segment, and forget it only once the manifest lists that. Without rows there is nothing to do."""
        if not self.is_open:
            return Status.invalid_argument
        if not len(self.memtable):
            return Status.ok
        status = self.write(self.memtable.frame(self.spark).coalesce(1))
        if status is Status.ok:
            self.memtable.clear()
        return status

    def get(self, id: int) -> list[float] | None:
        """The newest vector of an id, from the memtable or by one job over all segments."""
        found = self.memtable.find(id)
        if found is not None:
            return found[1]
        parts = self.segments() if self.is_open else []
        row = point_get(versions(parts), id).first() if parts else None
        return list(row["values"]) if row else None

    def write(self, rows: DataFrame) -> Status:
        """Add a segment of rows (id, is_deleted, values), sorted by id so that scans for an id skip row groups.

        Each partition of rows becomes a file; null ids come last in it.
        """
        if not self.is_open:
            return Status.invalid_argument
        name = next_segment(self.manifest.segments)
        rows.select("id", "is_deleted", F.when(~F.col("is_deleted"), F.col("values")).alias("values")).sortWithinPartitions(F.asc_nulls_last("id")).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self._publish([*self.manifest.segments, name])

    def _publish(self, names: list[str]) -> Status:
        manifest = Manifest()
        for name in names:
            manifest.add(name)
        status = manifest.replace(self.files, self.folder)
        if status is Status.ok:
            self.manifest = manifest
        return status

    def compact(self) -> Status:
        """Replace all segments by one that holds what is visible, without tombstones. Fewer than two: nothing to do.

        A segment that can't be read makes it fail: nothing is deleted that wasn't merged.
        """
        if not self.is_open:
            return Status.invalid_argument
        old = self.manifest.segments
        if len(old) < 2:
            return Status.ok
        name = next_segment(old)
        compacted(versions(self.segments("fail"))).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{self.folder}/{name}")
        status = self._publish([name])
        if status is Status.ok:
            for gone in old:
                self._known.pop(gone, None)
                self.files.delete(f"{self.folder}/{gone}")
        return status

    def newest(self, pending: DataFrame | None = None) -> DataFrame:
        """(id, is_deleted, values): the newest version of every id. One segment without pending rows needs no shuffle."""
        parts = self.segments() if self.is_open else []
        if not parts and pending is None:
            return self.spark.createDataFrame([], ROWS)
        if len(parts) + (pending is not None) == 1:
            return (parts or [pending])[0].select("id", "is_deleted", "values")
        return newest(versions(parts, pending)).select("id", "is_deleted", "values")

    def visible(self, pending: DataFrame | None = None) -> DataFrame:
        """(id, values) of the visible rows of this collection's dimensions."""
        return self.newest(pending).where("NOT is_deleted").where(has_dimensions("values", self.dimensions)).select("id", "values")

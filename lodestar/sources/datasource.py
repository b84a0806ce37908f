"""Spark data sources for the binary formats: spark.read.format("lodestar-segment").load(path), and so on.

A path names a file, several files by a glob, or the folder that a table of segment rows was written to, on a file system
that driver and executors mount; each file is one partition. In such a folder only the files that its list names count.
Register the sources once per session by register(spark). Ids at or above 2**63 do not fit a bigint and are an error.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lodestar.sources import binary
from lodestar.sources.files import mounted
from lodestar.types import LOG, ROWS

#: The list of a folder's files, and rows of a file at most.
PARTS = "_parts"
ROWS_A_FILE = 65_536


def _signed(i: int) -> int:
    if i >= 1 << 63:
        raise OverflowError(f"id {i} does not fit 63 bits")
    return i


class _FileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = mounted(path)

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [InputPartition(f"{self.path}/{name}") for name in _listed(self.path)] or [InputPartition(None)]
        return [InputPartition(p) for p in sorted(glob.glob(self.path)) or [self.path]]

    def data(self, partition: InputPartition) -> bytes:
        with open(partition.value, "rb") as f:
            return f.read()


def _listed(folder: str) -> list[str]:
    """The files that a folder's list names; none before it has one."""
    try:
        with open(f"{folder}/{PARTS}") as f:
            return json.load(f)
    except FileNotFoundError:
        return []


class _SegmentReader(_FileReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            for i, gone, values in binary.read_segment(self.data(partition)):
                yield _signed(i), gone, values


class _SnapshotReader(_FileReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for pos, (i, gone, values) in enumerate(binary.read_snapshot(self.data(partition))):
            yield pos, _signed(i), gone, values


class _LogReader(_FileReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in binary.read_records(self.data(partition)):
            yield r.lsn, r.op, None if r.op == "checkpoint" else _signed(r.id), r.dimensions, r.values, r.checkpoint_lsn if r.op == "checkpoint" else None


@dataclass
class _Written(WriterCommitMessage):
    """The files of one task."""

    names: list[str]


class _SegmentWriter(DataSourceWriter):
    """Each task writes files of its own, which nobody reads until the job's commit replaces the folder's list by one rename.

    So a task that is tried again, or runs twice, leaves files that no list names, and the commit deletes them. There is
    one writer at a time, as of any table of files.
    """

    def __init__(self, path: str, dimensions: int, metric: int, overwrite: bool):
        self.path, self.dimensions, self.metric, self.overwrite = mounted(path), dimensions, metric, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        names, task = [], TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        while rows := [(r["id"], r["is_deleted"], None if r["values"] is None else list(r["values"])) for r in itertools.islice(iterator, ROWS_A_FILE)]:
            names.append(f"part-{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names)}.vec")
            with open(f"{self.path}/{names[-1]}", "wb") as f:
                f.write(binary.write_segment(binary.Rows.of(self.dimensions, self.metric, rows)))
                f.flush()
                os.fsync(f.fileno())
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        names = [] if self.overwrite else _listed(self.path)
        names += [name for m in messages if m is not None for name in m.names]
        with open(f"{self.path}/{PARTS}.{self.job}", "w") as f:
            json.dump(names, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}/{PARTS}.{self.job}", f"{self.path}/{PARTS}")
        self._forget(set(names))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.isdir(self.path):
            self._forget(set(_listed(self.path)))

    def _forget(self, kept: set[str]) -> None:
        for path in glob.glob(f"{glob.escape(self.path)}/part-*.vec"):
            if os.path.basename(path) not in kept:
                os.unlink(path)


class SegmentSource(DataSource):
    """Rows (id, is_deleted, values) of segment files. To write a folder of them, give the options dimensions and metric."""

    @classmethod
    def name(cls) -> str:
        return "lodestar-segment"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _SegmentReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SegmentWriter(self.options["path"], int(self.options["dimensions"]), int(self.options.get("metric", 0)), overwrite)


class SnapshotSource(DataSource):
    """Rows (pos, id, is_deleted, values) of snapshot files."""

    @classmethod
    def name(cls) -> str:
        return "lodestar-snapshot"

    def schema(self) -> str:
        return f"pos bigint, {ROWS}"

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options["path"])


class LogSource(DataSource):
    """Records of log files."""

    @classmethod
    def name(cls) -> str:
        return "lodestar-log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (SegmentSource, SnapshotSource, LogSource):
        spark.dataSource.register(source)

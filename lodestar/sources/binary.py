"""Codecs of the binary file formats, for exchange with other readers: segments, snapshots and logs.

All numbers are little-endian. Each file or record ends with the sum of its bytes, modulo 2**32. Arrays are whole
sections (all ids, all flags, all components), so numpy reads and writes them without a loop over rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the file formats.
SEGMENT_MAGIC = b"VECSEG01"
SNAPSHOT_MAGIC = b"VECDB001"
VERSION = 1
OPS = {1: "insert", 2: "update", 3: "delete", 4: "checkpoint"}
_SEGMENT_HEAD = struct.Struct("<8sIIQI")  # magic, version, dimensions, rows, metric
_SNAPSHOT_HEAD = struct.Struct("<8sIIQQI")  # magic, version, dimensions, rows, live rows, metric
_RECORD_HEAD = struct.Struct("<QI")  # lsn, op
_RECORD_VECTOR = struct.Struct("<QI")  # id, dimensions

_CODES = {name: code for code, name in OPS.items()}


class Malformed(ValueError):
    """A file that isn't what it should be: an invalid_argument."""


def checksum(data: bytes) -> int:
    return int(np.frombuffer(data, np.uint8).sum(dtype=np.uint64)) & 0xFFFFFFFF


@dataclass
class Rows:
    """Rows of a segment or snapshot, by column. Vectors of deleted rows are zeros in files and never used."""

    dimensions: int
    metric: int
    ids: np.ndarray
    deleted: np.ndarray
    values: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, dimensions: int, metric: int, rows: list[tuple[int, bool, list[float] | None]], keep_deleted_values: bool = False) -> Rows:
        """From (id, is_deleted, values). A live row must have the dimensions; a tombstone of a segment has no values."""
        values = np.zeros((len(rows), dimensions), "<f4")
        for n, (_, deleted, v) in enumerate(rows):
            if deleted and not keep_deleted_values:
                if v:
                    raise Malformed("a tombstone has no values")
            elif v is None or len(v) != dimensions:
                raise Malformed("a row has other dimensions")
            else:
                values[n] = v
        return cls(dimensions, metric, np.array([r[0] for r in rows], "<u8"), np.array([r[1] for r in rows], bool), values)

    def __iter__(self) -> Iterator[tuple[int, bool, list[float] | None]]:
        for n, (i, gone) in enumerate(zip(self.ids.tolist(), self.deleted.tolist(), strict=True)):
            yield i, gone, None if gone else self.values[n].tolist()


def _sections(rows: Rows) -> bytes:
    return rows.ids.astype("<u8").tobytes() + rows.deleted.astype("u1").tobytes() + rows.values.astype("<f4").tobytes()


def _read_sections(data: bytes, at: int, n: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < at + n * (9 + 4 * dimensions) + 4:
        raise Malformed("the file is too short")
    ids = np.frombuffer(data, "<u8", n, at)
    flags = np.frombuffer(data, "u1", n, at + 8 * n)
    values = np.frombuffer(data, "<f4", n * dimensions, at + 9 * n).reshape(n, dimensions)
    end = at + n * (9 + 4 * dimensions)
    if struct.unpack_from("<I", data, end)[0] != checksum(data[:end]):
        raise Malformed("the checksum differs")
    return ids, flags, values


def write_segment(rows: Rows) -> bytes:
    body = _SEGMENT_HEAD.pack(SEGMENT_MAGIC, VERSION, rows.dimensions, len(rows.ids), rows.metric) + _sections(rows)
    return body + struct.pack("<I", checksum(body))


def read_segment(data: bytes) -> Rows:
    """The rows of a segment. Only the flag 1 is a tombstone."""
    if len(data) < _SEGMENT_HEAD.size:
        raise Malformed("the file is too short")
    magic, version, dimensions, n, metric = _SEGMENT_HEAD.unpack_from(data)
    if magic != SEGMENT_MAGIC or version != VERSION:
        raise Malformed("not a segment of this version")
    ids, flags, values = _read_sections(data, _SEGMENT_HEAD.size, n, dimensions)
    return Rows(dimensions, metric, ids, flags == 1, values)


def write_snapshot(rows: Rows) -> bytes:
    live = int((~rows.deleted).sum())
    body = _SNAPSHOT_HEAD.pack(SNAPSHOT_MAGIC, VERSION, rows.dimensions, len(rows.ids), live, rows.metric) + _sections(rows)
    return body + struct.pack("<I", checksum(body))


def read_snapshot(data: bytes) -> Rows:
    """The rows of a snapshot in order of their slots. Any flag but 0 is a tombstone."""
    if len(data) < _SNAPSHOT_HEAD.size:
        raise Malformed("the file is too short")
    magic, version, dimensions, n, live, metric = _SNAPSHOT_HEAD.unpack_from(data)
    if magic != SNAPSHOT_MAGIC or version != VERSION or not dimensions or live > n or metric > 2:
        raise Malformed("not a snapshot of this version")
    ids, flags, values = _read_sections(data, _SNAPSHOT_HEAD.size, n, dimensions)
    return Rows(dimensions, metric, ids, flags != 0, values)


@dataclass
class Record:
    """An entry of a log."""

    op: str
    id: int = 0
    values: list[float] | None = None
    checkpoint_lsn: int = 0
    lsn: int = 0

    @property
    def dimensions(self) -> int:
        return len(self.values or ())


def write_record(record: Record) -> bytes:
    """A record with its length in front. Vectors must have components."""
    body = _RECORD_HEAD.pack(record.lsn, _CODES[record.op])
    if record.op in ("insert", "update"):
        if not record.values:
            raise Malformed("a vector without components")
        body += _RECORD_VECTOR.pack(record.id, len(record.values)) + np.array(record.values, "<f4").tobytes()
    else:
        body += struct.pack("<Q", record.id if record.op == "delete" else record.checkpoint_lsn)
    return struct.pack("<I", len(body) + 4) + body + struct.pack("<I", checksum(body))


def read_records(data: bytes) -> Iterator[Record]:
    """The records of a log in order. One to three bytes at the end are a clean end; a longer part of a record is malformed."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise Malformed("a record is cut off")
        at += n
        return data[at - n : at]

    while len(data) - at >= 4:
        take(4)  # the length, which the record's own fields repeat
        first = at
        lsn, code = _RECORD_HEAD.unpack(take(_RECORD_HEAD.size))
        record = Record(OPS.get(code, ""), lsn=lsn)
        if record.op in ("insert", "update"):
            record.id, dimensions = _RECORD_VECTOR.unpack(take(_RECORD_VECTOR.size))
            record.values = np.frombuffer(take(4 * dimensions), "<f4").tolist()
        elif record.op == "delete":
            (record.id,) = struct.unpack("<Q", take(8))
        elif record.op == "checkpoint":
            (record.checkpoint_lsn,) = struct.unpack("<Q", take(8))
        else:
            raise Malformed("an unknown operation")
        body = data[first:at]
        if struct.unpack("<I", take(4))[0] != checksum(body):
            raise Malformed("the checksum differs")
        yield record

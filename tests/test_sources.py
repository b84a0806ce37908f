"""File formats, manifest and segments: round trips, corruption, crash safety."""

import struct

import duckdb
import pytest

from lodestar.plans.queries import ORACLE_SQL, QUERIES
from lodestar.sources import binary, manifest
from lodestar.sources.datasource import register
from lodestar.sources.files import Files
from lodestar.sources.segments import SegmentStore
from lodestar.types import ROWS, Metric, Status

DATA = [(1, False, [1.0, 2.0]), (2, True, None), (0, False, [0.5, -0.5])]


def test_segment_round_trip():
    made = binary.write_segment(binary.Rows.of(2, 1, DATA))
    again = binary.read_segment(made)
    assert list(again) == DATA and again.dimensions == 2 and again.metric == 1


def test_segment_rows_are_checked():
    for bad in ([(1, False, [1.0])], [(1, True, [1.0, 2.0])], [(1, False, None)]):
        with pytest.raises(binary.Malformed):
            binary.Rows.of(2, 0, bad)


@pytest.mark.parametrize("n,dims,size", [(0, 2, 40), (1, 2, 57), (3, 4, 36 + 27 + 48 + 4)])
def test_snapshot_size(n, dims, size):
    rows = binary.Rows.of(dims, 0, [(i, i == 1, [0.0] * dims) for i in range(n)], keep_deleted_values=True)
    made = binary.write_snapshot(rows)
    assert len(made) == size
    assert binary.read_snapshot(made).ids.tolist() == list(range(n))


def corrupted(data):
    yield b"X" + data[1:]
    yield data[: len(data) // 2]
    yield data[:-1] + bytes([data[-1] ^ 1])
    yield data[:8] + struct.pack("<I", 99) + data[12:]
    yield b""


def test_corruption_is_noticed():
    rows = binary.Rows.of(2, 0, DATA)
    for write, read in ((binary.write_segment, binary.read_segment), (binary.write_snapshot, binary.read_snapshot)):
        for bad in corrupted(write(rows)):
            with pytest.raises(binary.Malformed):
                read(bad)


def test_log_round_trip_and_tails():
    records = [binary.Record("insert", 1, [1.0, 2.0], lsn=1), binary.Record("delete", 1, lsn=2), binary.Record("checkpoint", checkpoint_lsn=2, lsn=3)]
    data = b"".join(map(binary.write_record, records))
    assert [(r.op, r.id, r.values, r.lsn, r.checkpoint_lsn) for r in binary.read_records(data)] == [("insert", 1, [1.0, 2.0], 1, 0), ("delete", 1, None, 2, 0), ("checkpoint", 0, None, 3, 2)]
    assert len(list(binary.read_records(data + b"\x01\x02\x03"))) == 3
    for bad in (data[:-2], data + b"\x09\x00\x00\x00", data[:4] + b"\xff" + data[5:]):
        with pytest.raises(binary.Malformed):
            list(binary.read_records(bad))
    with pytest.raises(binary.Malformed):
        binary.write_record(binary.Record("insert", 1, []))


def test_manifest_forms():
    assert manifest.parse(manifest.render([])) == []
    assert manifest.parse(manifest.render(["a", "b"])) == ["a", "b"]
    for bad in (b"", b"XXXMAN01\n1\n0\n", b"VECMAN01\n2\n0\n", b"VECMAN01\n1\n2\na\n", b"VECMAN01\n1\n1\n\n", b"VECMAN01\nx\n0\n", b"VECMAN01\n1\ny\n", b"\xff\xfe"):
        assert manifest.parse(bad) is None
    assert manifest.next_segment([]) == "segment-000001.vec"
    assert manifest.next_segment(["segment-000003.vec", "odd", "segment-x.vec"]) == "segment-000004.vec"


def test_manifest_file(spark, tmp_path):
    files, m = Files(spark, str(tmp_path)), manifest.Manifest()
    assert m.load(files, str(tmp_path)) is Status.ok and m.segments == []
    m.add("segment-000001.vec")
    assert m.replace(files, str(tmp_path)) is Status.ok
    (tmp_path / "MANIFEST.tmp").write_text("a draft that a crash left")
    again = manifest.Manifest()
    assert again.load(files, str(tmp_path)) is Status.ok and again.segments == ["segment-000001.vec"]
    again.add("")
    assert again.replace(files, str(tmp_path)) is Status.invalid_argument
    assert m.load(files, str(tmp_path)) is Status.ok and m.segments == ["segment-000001.vec"]
    (tmp_path / "MANIFEST").write_text("VECMAN01\n1\n5\nsegment-000001.vec\n")
    (tmp_path / ".MANIFEST.crc").unlink(missing_ok=True)
    assert again.load(files, str(tmp_path)) is Status.invalid_argument


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def seen(store, pending=None):
    return {r["id"]: list(r["values"]) for r in store.visible(pending).collect()}


def test_store(spark, tmp_path):
    store = SegmentStore(spark, 2)
    assert store.open("") is Status.invalid_argument and store.write(rows(spark, DATA)) is Status.invalid_argument and store.compact() is Status.invalid_argument
    assert store.open(str(tmp_path / "new")) is Status.ok and seen(store) == {}
    store.write(rows(spark, [(1, False, [1.0, 0.0]), (2, False, [0.0, 1.0])]))
    assert store.compact() is Status.ok and store.manifest.segments == ["segment-000001.vec"]
    store.write(rows(spark, [(1, False, [2.0, 0.0])]))
    store.write(rows(spark, [(2, True, None)]))
    assert seen(store) == {1: [2.0, 0.0]}
    assert seen(store, rows(spark, [(2, False, [7.0, 7.0])])) == {1: [2.0, 0.0], 2: [7.0, 7.0]}
    assert store.compact() is Status.ok and store.manifest.segments == ["segment-000004.vec"] and seen(store) == {1: [2.0, 0.0]}
    assert sorted(p.name for p in (tmp_path / "new").iterdir() if p.name.startswith("segment")) == ["segment-000004.vec"]
    again = SegmentStore(spark, 2)
    assert again.open(str(tmp_path / "new")) is Status.ok and seen(again) == {1: [2.0, 0.0]}


def test_missing_segments_are_skipped_by_reads_and_stop_compaction(spark, tmp_path):
    store = SegmentStore(spark, 2, on_corrupt="skip")
    store.open(str(tmp_path))
    store.write(rows(spark, [(1, False, [1.0, 0.0])]))
    store.write(rows(spark, [(2, False, [1.0, 0.0])]))
    store.files.delete(f"{tmp_path}/segment-000001.vec")
    strict = SegmentStore(spark, 2)
    strict.open(str(tmp_path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        strict.visible()
    assert seen(store) == {2: [1.0, 0.0]}
    with pytest.raises(Exception):
        store.compact()
    assert len(store.manifest.segments) == 2 and seen(store) == {2: [1.0, 0.0]}


def test_a_store_writes_reads_and_flushes_by_itself(spark, tmp_path):
    store = SegmentStore(spark, 2, flush_threshold_rows=3)
    assert store.remove(9) is Status.ok and store.flush() is Status.invalid_argument and store.get(9) is None
    store.open(str(tmp_path))
    assert store.put(1, [1]) is Status.dimension_mismatch and store.put(1, [1, 0]) is Status.ok and store.manifest.segments == []
    assert store.put(2, [2, 0]) is Status.ok and store.manifest.segments == ["segment-000001.vec"] and len(store.memtable) == 0
    assert store.get(1) == [1, 0] and store.remove(1) is Status.ok and store.get(1) is None and store.memtable.find(1) == (True, None) and store.memtable.find(2) is None
    assert store.flush() is Status.ok and store.get(1) is None and store.get(2) == [2, 0] and store.memtable.remove(2) is Status.not_found
    assert store.memtable.live_count() == 0 and store.flush() is Status.ok and len(store.manifest.segments) == 2


def embeddings(spark, folder, ids):
    """A table of vectors that don't compress, in four files."""
    table = spark.createDataFrame([(i,) for i in ids], "vec_id bigint").repartition(4)
    table.selectExpr("vec_id", "transform(sequence(1, 64), k -> cast(hash(vec_id, k) AS float)) AS embedding", "0 AS label").write.parquet(f"{folder}/embeddings.parquet")


def flush_order(spark, folder):
    """What the query gives, and what its SQL does, sorted."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet/*.parquet'")
    by_place = lambda r: (r[1], r[0] is None, r[0])
    found = QUERIES["memtable_flush_order"](spark, str(folder))
    assert found.dtypes == [("id", "bigint"), ("at", "bigint")]
    return sorted(map(tuple, found.collect()), key=by_place), sorted(con.sql(ORACLE_SQL["memtable_flush_order"]).fetchall(), key=by_place)


def test_flush_order_in_many_splits(spark, tmp_path):
    embeddings(spark, tmp_path, [(i * 617) % 3001 for i in range(3001)])
    small = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxRecordsPerFile": "200"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got, want = flush_order(spark, tmp_path)
    finally:
        for k in small:
            spark.conf.unset(k)
    assert got == want == [(i, i) for i in range(3001)]


@pytest.mark.parametrize("ids", [[], [None], [7], [5, -3, None, 5, 2**63 - 1, None, 0, 5, -(2**63)], [4] * 50 + [None] * 50 + list(range(100))])
def test_flush_order_of_odd_ids(spark, tmp_path, ids):
    embeddings(spark, tmp_path, ids)
    got, want = flush_order(spark, tmp_path)
    assert got == want and len(got) == len(ids)


def test_positions_run_over_files_as_they_were_written(spark, tmp_path):
    store = SegmentStore(spark, 2)
    store.open(str(tmp_path))
    store.write(rows(spark, [(i, i % 7 == 0, None if i % 7 == 0 else [1.0, 0.0]) for i in range(100)]).repartitionByRange(13, "id"))
    assert len(list((tmp_path / "segment-000001.vec").glob("part-*"))) > 9
    assert sorted(map(tuple, store.positions("segment-000001.vec").collect())) == [(i, i) for i in range(100)]
    store.write(rows(spark, [(2, False, [1.0, 0.0]), (1, True, None), (3, False, [0.0, 1.0])]).coalesce(1))
    assert sorted(map(tuple, store.positions("segment-000002.vec").collect())) == [(1, 0), (2, 1), (3, 2)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.positions("segment-000009.vec")


def test_binary_data_sources(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "one.vec")
    rows(spark, DATA).coalesce(1).write.format("lodestar-segment").option("dimensions", 2).option("metric", Metric.euclidean.code).mode("append").save(path)
    assert sorted((r["id"], r["is_deleted"], r["values"]) for r in spark.read.format("lodestar-segment").load(path).collect()) == sorted(DATA)
    four = spark.range(100).repartition(4).selectExpr("id", "id % 7 = 0 AS is_deleted", "CASE WHEN id % 7 <> 0 THEN array(cast(id AS float), 1f) END AS values")
    write = lambda mode: four.write.format("lodestar-segment").option("dimensions", 2).mode(mode).save(path)
    read = lambda: sorted((r["id"], r["is_deleted"], r["values"]) for r in spark.read.format("lodestar-segment").load(path).collect())
    want = sorted((i, i % 7 == 0, None if i % 7 == 0 else [float(i), 1.0]) for i in range(100))
    write("append")
    assert read() == sorted(want + DATA, key=lambda r: r[:2] + ((r[2] or []),))
    write("overwrite")
    assert read() == want and len(list((tmp_path / "one.vec").glob("part-*"))) == 4
    (tmp_path / "one.vec" / "part-of-a-task-that-died.vec").write_bytes(b"torn")
    assert read() == want
    four.limit(0).write.format("lodestar-segment").option("dimensions", 2).mode("overwrite").save(path)
    assert read() == []
    (tmp_path / "s").write_bytes(binary.write_snapshot(binary.Rows.of(2, 0, [(5, True, [1.0, 1.0]), (5, False, [2.0, 2.0])], keep_deleted_values=True)))
    assert [(r["pos"], r["id"], r["is_deleted"]) for r in spark.read.format("lodestar-snapshot").load(str(tmp_path / "s")).collect()] == [(0, 5, True), (1, 5, False)]
    (tmp_path / "l").write_bytes(binary.write_record(binary.Record("delete", 3, lsn=1)))
    assert spark.read.format("lodestar-log").load(str(tmp_path / "l")).first()["op"] == "delete"

"""Folds of operations against a sequential model."""

import random

import pytest

from lodestar.operators import changes, visibility
from lodestar.types import LOG, OPS, ROWS, tagged


def model(ops, base):
    """Statuses, vectors and metadata by plain steps."""
    vectors, meta, out = dict(base), {}, []
    for _, op, i, v, m in ops:
        fits = v is not None and len(v) == 2
        if op in ("insert", "update") and not fits:
            out.append("dimension_mismatch")
        elif op == "insert" and i in vectors:
            out.append("duplicate_id")
        elif op != "insert" and i not in vectors:
            out.append("not_found")
        else:
            out.append("ok")
            if op in ("insert", "update"):
                vectors[i] = v
            if op == "remove":
                vectors.pop(i), meta.pop(i, None)
            if op == "insert" or op == "set_metadata":
                meta.pop(i, None)
                if m:
                    meta[i] = m
    return out, vectors, meta


def random_ops(rng, n, short=True):
    out = []
    for seq in range(n):
        op = rng.choice(["insert", "insert", "update", "remove", "set_metadata"])
        v = [float(seq), 1.0][: 1 if short and rng.random() < 0.1 else 2] if op in ("insert", "update") else None
        m = rng.choice([None, {}, {"n": tagged(seq)}]) if op in ("insert", "set_metadata") else None
        out.append((seq, op, rng.randrange(12), v, m))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_statuses_and_state(spark, seed):
    rng = random.Random(seed)
    ops, base = random_ops(rng, 300), {i: [0.0, float(i)] for i in range(0, 12, 3)}
    table = spark.createDataFrame(ops, OPS)
    live = spark.createDataFrame(list(base.items()), "id bigint, values array<float>")
    judged = changes.statuses(table, 2, live).cache()
    want, vectors, meta = model(ops, base)
    assert [r["status"] for r in judged.orderBy("seq").collect()] == want
    after = {r["id"]: list(r["values"]) for r in changes.apply(live, changes.final_versions(judged)).collect()}
    assert after == vectors
    told = {r["id"]: r["metadata"]["n"]["i"] for r in changes.final_metadata(judged).where("metadata IS NOT NULL").collect()}
    assert told == {i: m["n"]["i"] for i, m in meta.items()}


def test_unknown_operations_and_null_ids(spark):
    rows = [(0, "upsert", 1, [1.0, 1.0], None), (1, None, 1, None, None), (2, "insert", None, [1.0, 1.0], None)]
    found = changes.statuses(spark.createDataFrame(rows, OPS), 2).orderBy("seq").collect()
    assert [r["status"] for r in found] == ["invalid_argument"] * 3


def replay_model(log, base):
    state = dict(base)
    for _, op, i, _, v, _ in log:
        if op == "checkpoint":
            continue
        if op not in ("insert", "update", "delete") or (op != "delete" and len(v) != 2):
            break
        if op == "delete":
            state.pop(i, None)
        elif op == "update" or i not in state:
            state[i] = v
    return state


@pytest.mark.parametrize("seed", range(3))
def test_replay(spark, seed):
    rng = random.Random(seed)
    log = []
    for lsn in range(1, 200):
        op = rng.choice(["insert", "update", "delete", "checkpoint"])
        i = None if op == "checkpoint" else rng.randrange(10)
        v = [float(lsn), 0.0] if op in ("insert", "update") else None
        log.append((lsn, op, i, 2 if v else 0, v, lsn - 1 if op == "checkpoint" else None))
    if seed == 2:
        log[150] = (151, "insert", 1, 1, [1.0], None)  # what comes after it isn't applied
    base = {i: [0.0, float(i)] for i in range(0, 10, 2)}
    live = spark.createDataFrame(list(base.items()), "id bigint, values array<float>")
    table = spark.createDataFrame(log, LOG)
    versions = changes.replayed(table, 2, live)
    after = {r["id"]: list(r["values"]) for r in changes.apply(live, versions).collect()}
    assert after == replay_model(log, base)
    assert changes.next_lsn(table).first()[0] == 200
    assert changes.next_lsn(table.limit(0)).first()[0] == 1


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def test_newest_wins(spark):
    old = rows(spark, [(7, False, [1.0, 0.0]), (8, False, [1.0, 0.0]), (9, False, [9.0, 9.0])])
    mid = rows(spark, [(7, False, [0.0, 1.0]), (8, False, [0.0, 1.0])])
    new = rows(spark, [(8, True, None)])
    for pending in (None, rows(spark, [(8, False, [5.0, 5.0])])):
        all_versions = visibility.versions([old, mid, new], pending)
        want = {7: [0.0, 1.0], 9: [9.0, 9.0]} | ({8: [5.0, 5.0]} if pending else {})
        assert {r["id"]: list(r["values"]) for r in visibility.newest_wins(all_versions).collect()} == want
        assert {r["id"]: list(r["values"]) for r in visibility.newest_wins_by_rank(all_versions).collect()} == want
        assert visibility.live_count(all_versions).first()["n"] == len(want)
        assert visibility.point_get(all_versions, 8).count() == (pending is not None)
        assert sorted(r["id"] for r in visibility.compacted(all_versions).collect()) == sorted(want)

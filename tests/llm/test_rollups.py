"""Rollups maintained by deltas."""

import random
from collections import Counter

import pytest

from lodestar.llm import rollups

CHANGES = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long, docs string"  # a clashing name


def changes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CHANGES)


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_batches_add_up(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    assert totals(r) == {} and r.batches() == []
    first = changes(spark, [("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)])
    assert r.apply("b1", first) is True and r.apply("b1", first) is False
    assert totals(r) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0)}
    r.apply("b2", changes(spark, [("revise", "a", "en", "v1", 7, 5), ("delete", None, None, "v1", 0, None), ("insert", "b", "de", "v2", 1, None)]))
    want = {("a", "en", "v1"): (2, 17), ("b", "de", "v2"): (1, 1)}
    assert totals(r) == want
    r.fold()
    assert totals(r) == want and r.batches() == ["b1", "b2"] and r.apply("b1", first) is False
    r.apply("b3", changes(spark, [("delete", "b", "de", "v2", 1, None)]))
    r.fold()
    assert totals(r) == {("a", "en", "v1"): (2, 17)} and r.batches() == ["b1", "b2", "b3"]
    assert totals(rollups.Rollup(spark, str(tmp_path / "r"))) == {("a", "en", "v1"): (2, 17)}


def test_a_second_writer_and_lost_drafts_change_nothing(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    rows = changes(spark, [("insert", "a", "en", "v1", 3, None)])
    r.apply("b", rows)
    draft = f"{r.path}/lost/again"
    rollups.deltas(rows).write.parquet(draft)
    assert r._commit(draft, r._place("b")) is False and totals(r) == {("a", "en", "v1"): (1, 3)}
    rollups.deltas(rows).write.parquet(f"{r.path}/lost/half")  # a writer that died before its commit
    assert totals(r) == {("a", "en", "v1"): (1, 3)}


def test_a_fold_that_died_before_it_cleaned_up(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    r.apply("b1", changes(spark, [("insert", "a", "en", "v1", 3, None)]))
    r.apply("b2", changes(spark, [("insert", "a", "en", "v1", 4, None)]))
    kept, r._fs_delete = r._fs, None

    class Stuck:
        def __getattr__(self, name):
            return (lambda *a: None) if name == "delete" else getattr(kept, name)

    r._fs = Stuck()
    r.fold()
    assert totals(r) == {("a", "en", "v1"): (2, 7)}
    assert totals(rollups.Rollup(spark, str(tmp_path / "r"))) == {("a", "en", "v1"): (2, 7)}


@pytest.mark.parametrize("point", ["_folders", "_folded", "_sums", "_commit", "delete"])
@pytest.mark.parametrize("after", [False, True])
def test_a_batch_that_is_committed_during_a_fold(spark, tmp_path, point, after):
    """Before or after each step of a fold, another writer commits a batch, and sends an old one again."""
    r, other = rollups.Rollup(spark, str(tmp_path / "r")), rollups.Rollup(spark, str(tmp_path / "r"))
    first = changes(spark, [("insert", "a", "en", "v1", 3, None)])
    r.apply("b1", first)
    r.apply("b2", changes(spark, [("insert", "a", "en", "v1", 4, None)]))
    done = []

    def write():
        if not done:
            done.append((other.apply("late", changes(spark, [("insert", "a", "en", "v1", 100, None)])), other.apply("b1", first)))

    def around(step):
        def run(*args):
            if not after:
                write()
            out = step(*args)
            write()
            return out

        return run

    if point == "delete":
        kept = r._fs

        class Watched:
            def __getattr__(self, name):
                return around(kept.delete) if name == "delete" else getattr(kept, name)

        r._fs = Watched()
    else:
        setattr(r, point, around(getattr(r, point)))
    assert r.fold() is True and done == [(True, False)]
    for _ in range(2):
        again = rollups.Rollup(spark, r.path)
        assert totals(again) == {("a", "en", "v1"): (3, 107)} and again.batches() == ["b1", "b2", "late"]
        again.fold()


def test_an_old_draft_of_a_folded_batch_counts_once(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    rows = changes(spark, [("insert", "a", "en", "v1", 3, None)])
    r.apply("b1", rows)
    r.apply("b2", rows)
    r.fold()
    draft = f"{r.path}/lost/late"
    rollups.deltas(rows).write.parquet(draft)  # its writer had looked before the batch was committed by another one
    assert r._commit(draft, r._place("b1")) is True
    for _ in range(2):
        assert totals(r) == {("a", "en", "v1"): (2, 6)} and r.batches() == ["b1", "b2"]
        r.fold()


def test_changes_between_null_and_repeated_ids(spark):
    schema = "doc_id long, source string, lang string, tokenizer string, tokens long"
    old = [(None, "a", "en", "v", 5), (None, None, None, "v", 2), (1, "a", "en", "v", 1), (1, "a", "en", "v", 1), (2, None, "en", "v", None)]
    new = [(None, "a", "en", "v", 6), (1, "a", "en", "v", 4), (2, None, "en", "v", None), (None, None, None, "v", 2)]
    found = rollups.changes_between(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    sums = Counter()
    for r in found:
        assert r["kind"] in ("insert", "delete", "revise")
        sums[r["source"], r["lang"], "docs"] += {"insert": 1, "delete": -1, "revise": 0}[r["kind"]]
        sums[r["source"], r["lang"], "tokens"] += {"insert": r["tokens"], "delete": -r["tokens"], "revise": (r["tokens"] or 0) - (r["old_tokens"] or 0)}[r["kind"]]
    assert {k: v for k, v in sums.items() if v} == {("a", "en", "docs"): -1, ("a", "en", "tokens"): 10 - 7}
    assert sorted(r["kind"] for r in found) == ["delete", "delete", "delete", "insert", "insert", "revise"]


def test_bad_changes(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    with pytest.raises(Exception, match="unknown kind"):
        r.apply("b", changes(spark, [("upsert", "a", "en", "v1", 3, None)]))
    with pytest.raises(ValueError):
        r.apply("../b", changes(spark, []))
    assert r.apply("empty", changes(spark, [])) is True and totals(r) == {} and r.batches() == ["empty"]


@pytest.mark.parametrize("seed", range(2))
def test_random_versions(spark, tmp_path, seed):
    rng, r, old = random.Random(seed), rollups.Rollup(spark, str(tmp_path / "r")), []
    schema = "doc_id long, source string, lang string, tokenizer string, tokens long"
    for n in range(3):
        new = [(i, rng.choice(["a", None]), rng.choice(["en", "de"]), "v", rng.choice([None, 1, 2, 3])) for i in range(30) if rng.random() < 0.7]
        r.apply(f"b{n}", rollups.changes_between(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)))
        docs, tokens = Counter(), Counter()
        for _, s, x, t, k in new:
            docs[s, x, t] += 1
            tokens[s, x, t] += k or 0
        assert totals(r) == {key: (docs[key], tokens[key]) for key in docs}
        old = new


def test_corpus(spark):
    rows = [(1, "one two", "en", "a"), (2, "one two", "en", "b"), (3, None, None, None), (None, "one two", "en", "a"), (4, "é é é", "fr", "a"), (4, "é é é", "fr", "a"), (5, "", "fr", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rollups.corpus_totals(docs).collect()}
    assert found == {
        ("a", "en", "words-1"): (2, 4), ("a", "en", "quarters-1"): (2, 4), (None, None, "words-1"): (1, 0), (None, None, "quarters-1"): (1, 0),
        ("a", "fr", "words-1"): (2, 6), ("a", "fr", "quarters-1"): (2, 4),
    }
    assert rollups.corpus_totals(docs.limit(0)).collect() == []

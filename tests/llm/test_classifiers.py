"""Toxicity and quality: what they learn, and what they must not see."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import boosting, quality, textstats, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, toxic int, score double"  # clashing names


def held(i, fold, folds):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def corpus(n=600, seed=1):
    """Toxic texts hold an insult or an inflected stem, bad ones shout or repeat."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 120))
        toxic, good = i % 5 == 0, i % 4 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else words[:3] * 20
        if toxic:
            for _ in range(1 + len(words) // 25):
                words.insert(rng.randrange(len(words)), rng.choice(["grubfoo", "Zorkk" + rng.choice(["en", "es", "ation"]), "you grubfoo!"]))
        docs.append((i, " ".join(words), "en", "s", 1, 0.5))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize("module,label,fold,folds,bar", [(toxicity, "toxic", 0, 5, 0.5), (quality, "quality", 2, 4, 0.7)])
def test_held_out_accuracy(tables, module, label, fold, folds, bar):
    docs, labels = tables
    found = {r["doc_id"]: r for r in module.score(docs, docs, labels).collect()}
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert set(found) == set(truth)
    assert all(r["held_out"] == held(i, fold, folds) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= bar) for i, r in found.items())
    mine = [i for i in found if found[i]["held_out"]]
    assert len(mine) > 50 and np.mean([found[i]["predicted"] == truth[i] for i in mine]) >= 0.95


def test_held_out_labels_are_not_learned_from(tables):
    """Turning the labels of held-out rows changes no score."""
    docs, labels = tables
    for module, label, fold, folds in ((toxicity, "toxic", 0, 5), (quality, "quality", 2, 4)):
        turned = labels.withColumn(label, F.when(textstats.held_out(F.col("doc_id"), fold, folds), 1 - F.col(label)).otherwise(F.col(label)))
        a, b = ({r["doc_id"]: r["score"] for r in module.score(docs, docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_scores_depend_on_the_text_alone(tables):
    docs, labels = tables
    moved = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("other").alias("source"))
    for module in (toxicity, quality):
        a = {r["doc_id"]: r["score"] for r in module.score(docs, docs, labels).collect()}
        b = {r["doc_id"] - 10_000: r["score"] for r in module.score(moved, docs, labels).collect()}
        assert a == b


def test_filter_keeps_columns_and_clean_texts(tables):
    docs, labels = tables
    kept = toxicity.without_toxic(docs, docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(clean - ids) <= 0.01 * len(clean) and len(ids - clean) <= 6


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "x " * 40_000), (None, "grubfoo you"), (4, "word"), (6, "é😀!!! $$$"), (7, "\u0000")]


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(i, t, None, None, None, None) for i, t in ODD], SCHEMA)
    for module in (toxicity, quality):
        found = module.score(odd, docs, labels).collect()
        assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
        assert len({r["score"] for r in found if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in found if r["doc_id"] == 4}) == 1
        assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
        assert module.score(docs.limit(0), docs, labels).collect() == []


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels_of_both_kinds(spark, tables, module, label):
    docs, labels = tables
    assert {r["score"] for r in module.score(docs, docs, labels.limit(0)).collect()} == {0.0}
    ones = labels.where(F.col(label) == 1)
    assert {r["score"] for r in module.score(docs, docs, ones).collect()} == {1.0}
    assert {r["score"] for r in module.score(docs, docs, labels.withColumn(label, F.lit(None).cast("int"))).collect()} == {0.0}


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.Boosted.fit(x[:1500], y[:1500])
    assert np.mean((trees.margin(x[1500:]) > 0) == y[1500:]) > 0.95
    rising = boosting.Isotonic.fit(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]))
    values = rising(np.array([-9.0, 1, 2, 2.5, 3, 4, 4.5, 5, 9]))
    assert (np.diff(values) >= 0).all() and values[0] < 0.01 and values[-1] > 0.99 and values[2] == values[4] == pytest.approx(0.5, abs=0.01)


def test_discriminant_finds_unequal_covariances():
    rng = np.random.default_rng(0)
    width = len(textstats.NAMES)
    y = (rng.random(1500) < 0.5).astype(float)
    x = np.abs(rng.normal(size=(1500, width)) * np.where(y[:, None] == 1, 0.2, 2.0))
    model = quality.Discriminant.fit(x, y)
    assert np.mean((model(x) >= 0.5) == y) > 0.97


def test_statistics_and_folds(spark):
    numbers = textstats.WordNumbers({"bad": 1.0, "vekk*": 2.0})
    got = dict(zip(textstats.NAMES, textstats.statistics("You BAD bad! vekkation b4d ok\nok ok", numbers), strict=True))
    assert got["hit_rate"] == pytest.approx(4 / 8) and got["distinct_hits"] == 4 and got["near_second"] == 1.0
    assert got["capitals"] == pytest.approx(1 / 8) and got["hidden_rate"] == pytest.approx(1 / 8) and got["bangs"] == pytest.approx(1 / 8)
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    assert [r[0] for r in ids.select(textstats.held_out(F.col("doc_id"), 2, 4)).collect()] == [held(i, 2, 4) for i in [*range(50), None]]


def test_sample_is_bounded(tables, monkeypatch):
    docs, labels = tables
    monkeypatch.setattr(textstats, "SAMPLE", 30)
    assert textstats.labelled(docs, labels, "toxic", 0, 5).count() <= 30

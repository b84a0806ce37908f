"""The corpus pipeline over a small folder."""

import random

import pytest

import corpus_pipeline
from lodestar.llm import neardup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(4), tmp_path_factory.mktemp("data")
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    passage = " ".join(rng.choices(plain, k=70))
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(plain, k=rng.randrange(60, 160))
        if i % 6 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "grubfoo")
        labels.append((i, 1, int(i % 6 == 0)))
        text = " ".join(words)
        if i in (101, 103):
            text += " " + passage
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    near = rows[7][1].split()
    near[50] = "changed"
    rows += [(900, rows[7][1], "en", "s0", 5), (901, " ".join(near), "en", "s1", 5), (902, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), passage


def test_stages(spark, folder):
    sf, passage = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        made.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i in range(300) if i % 6 == 0}
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) >= 303 - len(toxic) - 3
    assert not {900, 901} & set(kept["near_duplicates"]) and set(kept["toxicity"]) - set(kept["near_duplicates"]) == {900, 901}
    cut = kept["substring_dedup"]
    assert passage in cut[101] and passage not in cut[103] and cut[103]
    assert {i for i in cut if cut[i] != kept["near_duplicates"][i]} == {103}
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(final.columns)
    assert all(r["n_tokens"] == len(r["ids"]) for r in final.collect())


def test_run_is_its_stages(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"], r["n_tokens"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(docs)


def test_the_order_of_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mix", "bpe"]


def test_near_copies_from_four_fifths_on_go(spark):
    """One changed word in 50 runs of five leaves 45 of 55 alike (0.82), in 41 runs 36 of 46 (0.78)."""
    rows = []
    for at, n in ((0, 54), (10, 45)):
        words = [f"t{at}w{k}" for k in range(n)]
        changed = [*words[:25], "changed", *words[26:]]
        rows += [(at, " ".join(words)), (at + 1, " ".join(changed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 11]
    assert {r["doc_id"] for r in neardup.near_duplicates(docs).where("kept").collect()} == {0, 1, 10, 11}  # as op8 is asked


@pytest.mark.parametrize("percent,bands,band", [(85, 42, 6), (80, 50, 5)])
def test_bands_follow_from_the_similarity(percent, bands, band):
    scheme = neardup.Scheme.of(percent)
    assert (scheme.bands, scheme.band) == (bands, band)
    assert (1 - (percent / 100) ** band) ** bands <= neardup.MISSED


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size string, Copy string"


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names; and an empty table."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(900)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    same, passage = text(80), text(60)
    rows = [(1, same, "en", "a", None, "s", "c"), (2, same, None, None, 1, None, None), (2, same, None, None, 1, None, None), (3, None, "en", "a", 0, "s", "c"), (4, "", "en", "b", 0, "s", "c")]
    rows += [(None, text(70), "en", "a", 1, "s", "c"), (5, text(30_000), "en", "b", 1, "s", "c"), (6, passage + " " + text(70), "en", "a", 1, "s", "c"), (7, text(70) + " " + passage, "en", "b", 1, "s", "c")]
    rows += [(8, text(60), "en", "a", 1, "s", "c"), (8, text(65), "en", "a", 1, "s", "c")]
    for name, part in (("full", rows), ("empty", [])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, None)] if part else [], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs, kept = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), {}
        for stage, f in corpus_pipeline.STAGES[:-1]:
            made = f(spark, docs, f"{tmp_path}/{name}")
            assert made.dtypes == docs.dtypes
            made.write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            kept[stage] = sorted(r["doc_id"] or -1 for r in docs.collect())
        final = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if name == "empty":
            assert final == [] and not any(kept.values())
        else:
            assert kept["toxicity"] == [-1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 8]
            assert kept["near_duplicates"] == kept["substring_dedup"] == [-1, 1, 3, 4, 5, 6, 7, 8, 8]
            assert set(kept["mix"]) <= {-1, 1, 5, 6, 7, 8} and len(final) == len(kept["mix"])

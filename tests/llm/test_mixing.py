"""The mix of sources against plain arithmetic."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest

from lodestar.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, size int"  # clashing names


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1) for i, t, s in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def targets(sizes):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def expected(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = targets(sizes)
    out = []
    for s, target in want.items():
        keyed = []
        for i, t, x in rows:
            if x == s:
                w = words(t)
                u = (int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 1) / (16**13 + 1)
                keyed.append((-math.log(u) / max(0.25, len(set(w)) / max(1, len(w))), -1 if i is None else i, len(w)))
        budget, ahead = math.floor(target + 0.5), 0
        epochs = budget // sizes[s] if sizes[s] else 0
        for _, i, n in sorted(keyed):
            out.append((i, n, sizes[s], pytest.approx(target), epochs * n + min(n, max(0, budget - epochs * sizes[s] - ahead))))
            ahead += n
    return sorted(out, key=lambda r: (r[0], r[1], r[4]))


def mixed(df):
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(df).collect()), key=lambda r: (r[0], r[1], r[4]))


def corpus():
    rows = [(i, " ".join(f"w{(i * 7 + k) % (5 + i % 9)}" for k in range(1 + i * 37 % 60)), ("hot", "a", None, "b", "hot", "hot", "ü")[i % 7]) for i in range(300)]
    return rows + [(1000, "tiny", "z")]


def test_mix(spark):
    rows = corpus()
    found = mixed(table(spark, rows))
    assert found == expected(rows)
    assert found == mixed(table(spark, rows).repartition(7))  # reruns agree, however rows are dealt out
    by_source = Counter()
    for (i, n, size, target, taken), source in zip(found, [s for i, _, s in sorted(rows, key=lambda r: r[0])], strict=True):
        assert 0 <= taken <= 3 * n
        by_source[source, size, target] += taken
    for (_, size, target), taken in by_source.items():
        assert taken == math.floor(target + 0.5) <= 3 * size


def test_mix_in_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BUCKETS", 2)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 1_000_000)
    assert mixed(table(spark, corpus())) == expected(corpus())


ODD = [(1, None, "a"), (2, "", "a"), (3, "x " * 5_000, "b"), (None, "one two", None), (None, "one two", None), (4, "q w e", "b"), (4, "q w e", "b"), (5, None, "empty"), (6, " \t", "empty")]


def test_mix_odd_rows(spark):
    assert mixed(table(spark, ODD)) == expected(ODD)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = table(spark, [(1, None, "a"), (2, "", None)])
    assert [tuple(r) for r in mixing.mix(nothing).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_materialise(spark):
    rows = corpus()
    docs = table(spark, rows)
    plan = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs).collect()}
    texts = {i: t for i, t, _ in rows}
    made = mixing.materialise(docs)
    assert made.columns == docs.columns
    got = {}
    for r in made.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i, (n, taken) in plan.items():
        copies = got.get(i, [])
        assert sum(len(words(t)) for t in copies) == taken
        assert sum(t == texts[i] for t in copies) >= taken // n
        assert all(words(texts[i])[: len(words(t))] == words(t) for t in copies)


def test_sql_says_the_same(spark):
    documents = table(spark, corpus()).select("doc_id", "text", "source").toPandas()
    assert not documents.empty
    con = duckdb.connect()
    con.register("documents", documents)
    names = ("doc_id", "size", "source_size", "target", "taken")
    sql = sorted(con.sql(mixing.SQL).select(*names).fetchall())
    assert [(r[0], r[1], r[2], pytest.approx(r[3]), r[4]) for r in sql] == sorted(tuple(r) for r in mixing.mix(table(spark, corpus())).select(*names).collect())


def test_only_native_operators(spark):
    plan = mixing.mix(table(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["_doc", "_SOURCE", "_size", "_taken", "key", "Time", "time_"])
def test_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "a b c", "x", "own"), (2, "d e", "y", "own"), (3, None, None, "own")], f"doc_id long, text string, source string, `{name}` string")
    found = mixing.materialise(docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and {r[3] for r in rows} == {"own"} and {r["doc_id"] for r in rows} <= {1, 2}

"""Near duplicates and repeated passages against brute force."""

import hashlib
import random

import pytest

from lodestar.llm import components, neardup, substring

SCHEMA = "doc_id long, text string, tag string, bucket int, id long"  # clashing names


def table(spark, rows):
    return spark.createDataFrame([(i, t, "t", 3, 1) for i, t in rows], SCHEMA)


def shingle_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_groups(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n=120):
    """Texts of every degree of likeness, chains of them, and copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for i in range(n):
        kind = rng.random()
        if not out or kind < 0.2:
            t = rng.choices(words, k=rng.choice([3, 6, 40, 120]))
        else:
            t = list(rng.choice(out[-15:]))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
        out.append(t)
    ids = rng.sample(range(1000), n)
    return [(i, rng.choice([" ", "  ", "\n"]).join(t).upper() if rng.random() < 0.1 else " ".join(t)) for i, t in zip(ids, out, strict=True)]


@pytest.mark.parametrize("seed,block,few", [(1, 256, 500_000), (2, 2, 500_000), (3, 256, 0)])
def test_near_duplicates_against_brute_force(spark, seed, block, few, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FEW_ROWS", few)
    rows = corpus(seed)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert found == brute_groups(rows)


def test_a_large_group_of_near_copies(spark):
    """Many variants of one text: most link to the first, others only to each other."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(9)):
            t[rng.randrange(100)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(t)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert found == brute_groups(rows)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"l{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"), (7, "é É x y z"), (8, "é é x y z"), (9, long), (10, long), (11, "same id a b c d"), (11, "other text of that id e f")]
    found = neardup.near_duplicates(table(spark, rows)).collect()
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in found)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (-1, 1, -1, True), (7, 1, 7, True), (8, 1, 8, True), (9, 29_996, 9, True), (10, 29_996, 9, False), (11, 2, 11, True), (11, 3, 11, True)])
    kept = neardup.deduplicated(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "tag", "bucket", "id"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8, 9, 11, 11]
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(empty).collect() == [] and neardup.deduplicated(empty).collect() == []


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    t, z = "t a b c d e", "z f g h i j"
    rows = [(3, t), (5, t), (5, z), (8, z), (5, z), (2, "k l m n o p"), (2, "q r s t u v"), (9, "q r s t u v")]
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows)).collect())
    assert found == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (8, 5, False), (5, 5, True), (2, 2, True), (2, 2, True), (9, 2, False)])
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.deduplicated(table(spark, rows)).collect())
    assert kept == sorted([(3, t), (5, z), (5, z), (2, "k l m n o p"), (2, "q r s t u v")])


@pytest.mark.parametrize("name", ["GONE_ID", "gone_tag", "digest", "tag", "Kept", "bounds"])
def test_clashing_names(spark, name):
    p = " ".join(f"p{k}" for k in range(55))
    own = " ".join(f"q{k}" for k in range(60))
    docs = spark.createDataFrame([(1, p, "x"), (2, p, "y"), (3, own + " " + p, "z")], f"doc_id long, text string, `{name}` string")
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, p, "x"), (3, own + " " + p, "z")]
    kept = substring.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, p, "x"), (3, own, "z")]


def test_null_ids_are_not_linked(spark):
    assert [tuple(r) for r in neardup.near_duplicates(table(spark, [(None, "a b c d e f"), (5, "a b c d e f")])).orderBy("doc_id").collect()] == [(None, 2, None, True), (5, 2, 5, True)]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(7, k) for k in range(200, 260)] + [(3, 3), (140, 100)]
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for start, component in found.items():
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        assert component == min(seen)
    assert set(found) == set(near)


def brute_removed(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((-1 if i is None else i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [[f"s{p}_{k}" for k in range(rng.choice([49, 50, 51, 90, 200]))] for p in range(8)]
    shared.append(["und"] * 80)
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                p = rng.choice(shared)
                a = rng.randrange(0, max(1, len(p) - 45))
                t += p[a : a + rng.choice([30, 50, 60, 200])]
            else:
                t += [f"r{rng.randrange(10_000)}" for _ in range(rng.randrange(60))]
        out.append(rng.choice([" ", "\n", "\t "]).join(t))
    out += out[:5]
    return list(zip(rng.sample(range(1000), len(out)), out, strict=True))


@pytest.mark.parametrize("seed,size", [(1, 8 << 20), (2, 2_000), (3, 500)])
def test_removed_against_brute_force(spark, seed, size, monkeypatch):
    monkeypatch.setattr(substring, "BUNDLE_BYTES", size)
    rows = passages(seed)
    assert sorted(map(tuple, substring.removed(table(spark, rows)).collect())) == brute_removed(rows)


def test_removed_odd_rows(spark):
    p = " ".join(f"p{k}" for k in range(55))
    rows = [(1, None), (2, ""), (3, p), (4, p), (None, p), (5, "x " + p + " y"), (6, "a " * 49), (7, "a " * 49), (8, "short"), (9, "q " + p), (9, p + " z"), (10, " ".join(f"v{k}" for k in range(20_000)) + " " + p)]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in substring.removed(table(spark, rows)).collect()) == brute_removed(rows)
    kept = {r["doc_id"]: r["text"] for r in substring.deduplicated(table(spark, rows[:4] + rows[5:9])).collect()}
    assert kept == {1: None, 2: "", 3: p, 5: "x y", 6: "a " * 49, 7: "a " * 49, 8: "short"}
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.removed(empty).collect() == [] and substring.deduplicated(empty).columns == empty.columns


def test_shards_find_every_occurrence():
    rng = random.Random(5)
    words = [rng.choice([b"a", b"b", b"ab", "é".encode()]) for _ in range(3_000)]
    phrases = {b" ".join(words[k : k + 8]) for k in rng.sample(range(2_900), 20)}
    found = substring.Shard(sorted(phrases)).found(words)
    assert found.tolist() == [k for k in range(len(words) - 7) if b" ".join(words[k : k + 8]) in phrases]
    assert len(substring.Shard([]).found(words)) == 0

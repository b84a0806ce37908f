"""MinHash near-duplicate detection with exact links.

A document's set is its distinct runs of five words, each held as a hash of 64 bits. Documents with equal sets form a
class, and one row of it goes on as its node. Each set gets many universal hash minima; runs of a few of them, the bands,
are bucket keys. Their length and number follow from the similarity asked for (see Scheme): a pair that has it shares no
bucket with a probability of MISSED at most, (1 - 0.85**6)**42 at 0.85 and (1 - 0.8**5)**50 at 0.8.

Buckets never become all their pairs:

1. Each member is compared with its bucket's leader: first the signatures, then, if these may do, the full sets.
   Components of the links follow by large-star and small-star.
2. A bucket that still holds several components is looked at once more, by itself. Its members are dealt out in groups of
   two blocks of bounded size; members of its largest component meet only members of others. A group compares signatures
   and notes for each member its likely partners in other components, one bit each; a pair counts in the first bucket
   that it shares. Sets are fetched for these members only, and just the links that join components leave a task.

Links within a component are not looked for, since they change nothing. So the work beyond the first step grows with
the members outside a bucket's largest component; memory and output are bounded whatever a bucket holds.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer than five words are one shingle;
a row with a null doc_id is linked with nothing, has a null component and is kept; rows that share a doc_id but not a set
are documents of their own, each with the component of its own set, and rows that share both share their fate; equal sets
are one class; an empty table gives an empty result; other columns are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_staged, in_small_batches, staged, tidy, unused
from lodestar.llm.components import components

SHINGLE = 5
#: Similarity in hundredths for a link, unless another is asked for.
PERCENT = 85
#: Minima of a set at most, and the probability with which a pair of the least similarity may share no bucket.
HASHES = 252
MISSED = 3e-9
#: Shingles hashed at once, members of a block, words whose hash a worker keeps.
CHUNK = 4_096
BLOCK = 256
KNOWN_WORDS = 150_000
#: Rows of up to five numbers, or of two and a digest, up to which a table is broadcast: 20 MB.
FEW_ROWS = 500_000

_rng = np.random.Generator(np.random.PCG64(20))
_FACTORS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_WORD_FACTORS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


@dataclass(frozen=True)
class Scheme:
    """What follows from the similarity for a link: how many bands of how many minima, and how many minima must agree."""

    percent: int
    bands: int
    band: int
    least_agreeing: int

    @classmethod
    def of(cls, percent: int) -> Scheme:
        """The longest bands that miss a pair of the similarity with a probability of MISSED at most, within HASHES minima."""
        if not 10 <= percent <= 99:
            raise ValueError(f"a similarity of {percent} hundredths is not among 10 to 99")
        s = percent / 100
        needed = {band: math.ceil(math.log(MISSED) / math.log1p(-(s**band))) for band in range(1, HASHES + 1)}
        band = max(band for band, bands in needed.items() if band * bands <= HASHES)
        n = band * needed[band]
        # a pair of the least similarity has fewer agreeing minima with a probability of about 1e-9: six deviations below the mean
        return cls(percent, needed[band], band, math.floor(n * s - 6 * math.sqrt(n * s * (1 - s))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: bytes | None, hashes: dict) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8, A-Z made lower case."""
    words = text.lower().split() if text else []  # of bytes: A-Z only; the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _WORD_FACTORS[k]
    return np.unique(_mixed(total))


def minima(x: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n universal hashes over a set."""
    low, out = (x >> np.uint64(32)).astype(np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), CHUNK):
        np.minimum(out, (low[at : at + CHUNK, None] * _FACTORS[:n] + _ADDENDS[:n]).min(axis=0), out=out)
    return out


def bands(signature: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The bucket of each band of a signature."""
    parts = signature.reshape(scheme.bands, scheme.band).astype(np.uint64)
    return _mixed((parts * _BAND_FACTORS[: scheme.band]).sum(axis=1) + _BAND_SALTS[: scheme.bands]).view(np.int64)


def _texts(batches: Iterable[pa.RecordBatch], size: int = 128) -> Iterator[tuple[list, list, list]]:
    """Two columns and the UTF-8 texts of a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, digest of the set, bands, sig (the low 16 bits of the minima) of every row."""

    def run(batches):
        known = _WordHashes()
        for ids, tags, texts in _texts(batches):
            rows = []
            for text in texts:
                x = shingles(text, known)
                low = minima(x, scheme.bands * scheme.band)
                rows.append((len(x), _digest(x), bands(low, scheme), low.astype(np.uint16).tobytes()) if len(x) else (0, None, [], None))
            n, digest, band, sig = zip(*rows, strict=True)
            columns = [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "n_shingles", "digest", "bands", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(tidy(run), "doc_id long, tag long, n_shingles long, digest binary, bands array<long>, sig binary")


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has few rows: most is a number that it can't exceed, counted beforehand."""
    return F.broadcast(df) if most <= FEW_ROWS else df


def _only(df: DataFrame, column: str, ids: DataFrame, most: int) -> DataFrame:
    """The rows of df whose column is among ids (id), of which there are most or fewer."""
    return df.join(_small(ids.select(F.col("id").alias("among")), most), F.col(column) == F.col("among"), "left_semi")


def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """Minima that two signatures share."""
    return pd.Series([int((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).sum()) for x, y in zip(a, b, strict=True)], dtype="int32")


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shingles that two sets share."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int32")


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(node, items): the full sets of the classes (node, rep, digest) that are among ids (id), most or fewer, from the texts themselves."""

    def run(batches):
        known = _WordHashes()
        for nodes, digests, texts in _texts(batches):
            found = [(n, x.tobytes()) for n, d, x in zip(nodes, digests, (shingles(t, known) for t in texts), strict=True) if _digest(x) == d]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["node", "items"])

    wanted = _only(classes.select("node", "rep", "digest"), "node", ids.distinct(), most)
    rows = docs.join(_small(wanted, most), F.col("doc_id") == F.col("rep"))
    made = rows.select("node", "digest", "text").mapInArrow(tidy(run), "node long, items binary")
    return staged(made.dropDuplicates(["node"]), "sets")  # a row may be repeated


def _links_to_leaders(star: DataFrame, classes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(u, v): the pairs (leader, member) of star whose signatures may be, and whose full sets are, similar enough."""
    sides = lambda df, value: [df.select(F.col("node").alias(f"id_{c}"), F.col(value).alias(f"{value}_{c}")) for c in "uv"]
    left, right = sides(classes, "sig")
    both = star.join(left, F.col("u") == F.col("id_u")).join(right, F.col("v") == F.col("id_v"))
    likely = staged(both.where(F.pandas_udf(_agreeing, "int")("sig_u", "sig_v") >= scheme.least_agreeing).select("u", "v"), "likely")
    ids = likely.select(F.col("u").alias("id")).union(likely.select(F.col("v").alias("id")))
    left, right = sides(_sets(docs, classes, ids, 2 * likely.count()), "items")
    both = likely.join(left, F.col("u") == F.col("id_u")).join(right, F.col("v") == F.col("id_v"))
    both = both.withColumn("both", F.pandas_udf(_common, "int")("items_u", "items_v"))
    union = F.octet_length("items_u") / 8 + F.octet_length("items_v") / 8 - F.col("both")
    return staged(both.where(100 * F.col("both") >= scheme.percent * union).select("u", "v"), "links")


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with equal first columns: these, and the rest of each row."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if len(rows) > 1:
        yield key, rows


def _likely_in(band: int, apart: bool, rows: list[tuple], scheme: Scheme) -> list[tuple[int, int, bytes]]:
    """(place, component, partners) and so on of the members that have likely partners in other components.

    rows are (block, component, member, sig); apart: pairs of one block are compared in another group. partners has a bit
    for each place among the members returned. Only pairs whose first shared band is this one count.
    """
    sigs = np.stack([np.frombuffer(r[3], np.uint16) for r in rows])
    block, component = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    pairs = []
    for k in range(len(rows) - 1):
        later = k + 1 + np.flatnonzero((component[k + 1 :] != component[k]) & ((block[k + 1 :] != block[k]) | (not apart)))
        if len(later):
            same = sigs[later] == sigs[k]
            fine = np.flatnonzero(same.sum(axis=1) >= scheme.least_agreeing)
            shared = same[fine].reshape(len(fine), scheme.bands, scheme.band).all(axis=2)
            pairs += [(k, at) for at in later[fine[shared.argmax(axis=1) == band]].tolist()]
    places = {k: n for n, k in enumerate(sorted({k for pair in pairs for k in pair}))}
    bits = np.zeros((len(places), len(places)), bool)
    for a, b in pairs:
        bits[places[a], places[b]] = True
    return [(n, int(component[k]), rows[k][2], np.packbits(bits[n]).tobytes()) for k, n in places.items()]


def _links_in(rows: list[tuple], percent: int) -> tuple[list[int], list[int]]:
    """Links that join components, of rows (component, member, partners, set) by place: spanning links only, exact on full sets."""
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    _, root = np.unique([r[0] for r in rows], return_inverse=True)
    u, v = [], []
    for k, row in enumerate(rows):
        for at in np.flatnonzero(np.unpackbits(np.frombuffer(row[2], np.uint8), count=len(rows))).tolist():
            a, b = sets[k], sets[at]
            if root[k] == root[at] or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                u.append(row[1])
                v.append(rows[at][1])
                root[root == root[at]] = root[k]
    return u, v


def _late_links(members: DataFrame, n_members: int, known: DataFrame, n_known: int, classes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(u, v): links between the components (id, component) that a bucket of members (bucket, band, member) still holds.

    n_members and n_known are numbers of rows that these tables don't exceed.
    """
    named = members.join(_small(known, n_known), F.col("member") == F.col("id"), "left").select("bucket", "band", "member", F.coalesce("component", "member").alias("component"))
    named = staged(named, "named")
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy(F.col("bucket").alias("key")).agg(F.max_by("component", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("size")).where("most < size")
    rows = named.join(_small(mixed, n_members // 2), F.col("bucket") == F.col("key"))
    # blocks of the other components come first, then those of the largest; a small bucket is one block
    small = F.col("size") <= 2 * BLOCK
    others = F.when(small, 1).otherwise(F.ceil((F.col("size") - F.col("most")) / BLOCK)).cast("int")
    mains = F.when(small, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("int")
    draw = F.xxhash64("member")
    is_main = ~small & (F.col("component") == F.col("main"))
    mine = F.when(is_main, others + F.pmod(draw, mains)).otherwise(F.pmod(draw, others)).cast("int")
    met = F.sequence(F.lit(0), F.when(is_main, others).otherwise(others + mains) - 1)
    rows = rows.withColumn("mine", mine).withColumn("met", F.explode(met))
    rows = rows.select("bucket", F.least("mine", "met").alias("i"), F.greatest("mine", "met").alias("j"), "band", "mine", "component", "member")
    signed = rows.join(classes.select("node", "sig"), F.col("member") == F.col("node")).drop("node")

    def likely(batches):
        for (bucket, i, j, band), group in _groups(batches, 4):
            found = _likely_in(band, i != j, group, scheme)
            if found:
                place, component, member, partners = zip(*found, strict=True)
                n = len(found)
                columns = [pa.array([x] * n, t) for x, t in ((bucket, pa.int64()), (i, pa.int32()), (j, pa.int32()))]
                columns += [pa.array(place, pa.int32()), pa.array(component, pa.int64()), pa.array(member, pa.int64()), pa.array(partners, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "i", "j", "place", "component", "member", "partners"])

    dealt = signed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    near = staged(dealt.mapInArrow(tidy(likely), "bucket long, i int, j int, place int, component long, member long, partners binary"), "near")
    drop_staged(named)
    sets = _sets(docs, classes, near.select(F.col("member").alias("id")), near.count())
    full = near.join(sets, F.col("member") == F.col("node")).select("bucket", "i", "j", "place", "component", "member", "partners", "items")

    def links(batches):
        for _, group in _groups(batches, 3):
            u, v = _links_in([row[1:] for row in group], scheme.percent)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "place")
    return staged(dealt.mapInArrow(tidy(links), "u long, v long"), "links")


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, tag, n_shingles, component_id, kept of every row of docs."""
    scheme = Scheme.of(percent)
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(signatures(docs, scheme), "signatures")
    in_play = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = signed.where(in_play).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so a node's number stays

    banded = classes.select(F.col("node").alias("member"), F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("member").alias("leader"), F.max("member").alias("last")).where("leader < last").select(F.col("bucket").alias("key"), "leader")
    members = staged(banded.join(shared, F.col("bucket") == F.col("key")).select("bucket", "band", "member", "leader"), "members")
    n_members = members.count()
    met = staged(_only(classes.select("node", "rep", "digest", "sig"), "node", members.select(F.col("member").alias("id")).distinct(), n_members // 2), "met")
    star = members.where("member <> leader").select(F.col("leader").alias("u"), F.col("member").alias("v")).distinct()
    links = _links_to_leaders(star, met, docs, scheme)
    most = 2 * links.count()
    known = components(links, most)
    late = _late_links(members, n_members, known, most, met, docs, scheme)
    if n_late := late.count():
        stars = known.where("id <> component").select(F.col("component").alias("u"), F.col("id").alias("v"))
        most += 2 * n_late
        known = components(staged(stars.union(late), "edges"), most)
    drop_staged(members)

    named = classes.select("node", "rep", "digest", "size").join(_small(known, most), F.col("node") == F.col("id"), "left")
    least = named.where("component IS NOT NULL").groupBy(F.col("component").alias("part")).agg(F.min("rep").alias("least"))
    named = named.where("component IS NOT NULL OR size > 1").join(_small(least, most), F.col("component") == F.col("part"), "left")
    found = staged(named.select(F.col("digest").alias("set"), F.coalesce("least", "rep").alias("found")), "found")  # other sets are their document's alone

    rows = signed.select("doc_id", "tag", "n_shingles", "digest")
    alone = rows.where(~in_play | in_play.isNull()).withColumn("component_id", F.col("doc_id"))
    rest = rows.where(in_play).join(found, F.col("digest") == F.col("set"), "left").withColumn("component_id", F.coalesce("found", "doc_id"))
    columns = ["doc_id", "tag", "n_shingles", "component_id"]
    return alone.select(*columns).union(rest.select(*columns)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; sets of a similarity of percent hundredths or more are linked."""
    return _judged(docs, percent).drop("tag")


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates keeps, in the columns of docs. Rows with a null doc_id stay."""
    gone_id, gone_tag = unused(docs, "gone_id", "gone_tag")
    gone = staged(_judged(docs, percent).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("tag").alias(gone_tag)).distinct(), "gone")
    same = (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_tag))
    return docs.join(_small(gone, gone.count()), same, "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 85 * (a.n + b.n - common)),
r AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

"""Substring dedup: repeated passages by sharded Aho-Corasick automata of recurring phrases.

A window is WINDOW consecutive words. Among its phrases of PHRASE words, the one of least hash, its key phrase, is a
function of the window's words alone, so a passage that recurs brings its key phrases along. The steps:

1. Every document's key phrases are grouped over the corpus, word for word; those of more than one document recur.
2. Documents are dealt out in bundles of bounded size. A bundle's shard, an Aho-Corasick automaton of the recurring
   phrases that its documents hold, is compiled with pyahocorasick, and the bundle's documents are streamed through it;
   it locates every occurrence. Windows whose key phrase was found are candidates.
3. Candidates are grouped by a 96-bit hash of all their words; the least document of each is its holder. Every word of
   a window that is held by a document with a smaller id is removed.

Exact copies need no search: all windows of a text also start in the least document that has the same text. Hot phrases
and windows are summed in parts first, and joined back.

Defined results: a null or empty text has no words and loses none; fewer than WINDOW words lose none; a row with a null
doc_id neither loses words nor holds windows; rows that share a doc_id don't count as copies of each other; an empty table
gives an empty result; other columns are not read by removed() and kept by deduplicated(), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_staged, give_back, in_small_batches, staged, tidy, unused

WINDOW = 50
PHRASE = 8
#: UTF-8 bytes of text in a bundle.
BUNDLE_BYTES = 4 << 20
#: Words whose hash a worker keeps.
KNOWN_WORDS = 150_000
#: Rows, and interval bounds in them, up to which a table is broadcast: 32 MB.
FEW_ROWS, FEW_BOUNDS = 1_000_000, 4_000_000

# Odd factors of the two window hashes, and of the phrase hash.
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PHRASE_FACTOR = 0xBF58476D1CE4E5B9


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of every run of n word hashes: a difference of prefix sums, moved back to power 0."""
    m = len(words)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(words * _powers(factor, m), out=sums[1:])
    return _mixed((sums[n:] - sums[:-n]) * _powers(pow(factor, -1, 1 << 64), m - n + 1))


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values, by doubling."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def key_phrases(words: list[bytes], hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document with WINDOW words at least: its word hashes, its phrase hashes, and each window's key phrase's hash."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = run_hashes(h, PHRASE, _PHRASE_FACTOR)
    return h, grams, sliding_least(grams, WINDOW - PHRASE + 1)


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []  # of bytes: at the six ASCII white-space characters


def _rows(batches, size: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _phrases(batches):
    """(phrase, doc_id, bundle): the distinct key phrases of each document."""
    known = _WordHashes()
    for part in _rows(batches):
        phrases, ids, bundles = [], [], []
        for doc_id, bundle, text in zip(part.column("doc_id").to_pylist(), part.column("bundle").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = _words(text)
            if len(words) < WINDOW:
                continue
            _, grams, keys = key_phrases(words, known)
            _, first = np.unique(grams, return_index=True)
            for at in first[np.isin(grams[first], keys)].tolist():
                phrases.append(b" ".join(words[at : at + PHRASE]))
                ids.append(doc_id)
                bundles.append(bundle)
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(ids, pa.int64()), pa.array(bundles, pa.int32())], names=["phrase", "doc_id", "bundle"])


class Shard:
    """An automaton of phrases, over words in UTF-8 with one space before, between and after them."""

    def __init__(self, phrases: list[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases:
            self.automaton.add_word((b" " + phrase + b" ").decode("latin-1"))
        if phrases:
            self.automaton.make_automaton()
        self.empty = not phrases

    def found(self, words: list[bytes]) -> np.ndarray:
        """The places, in words, at which a phrase starts."""
        if self.empty:
            return np.zeros(0, np.int64)
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        ends = np.fromiter((e for e, _ in self.automaton.iter(text)), np.int64)
        if not len(ends):
            return ends
        # the space after word k stands at the sum of the lengths of words 0..k, and k + 1
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return np.unique(np.searchsorted(after, ends) - PHRASE + 1)


_CANDIDATE = "h1 long, h2 int, doc_id long, tag int, span long"


def _candidates(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """The windows of a bundle's documents whose key phrase its shard locates.

    Equal windows of a document that overlap or touch, as in a run of one word, are one row: span is the first place,
    shifted by 32 bits, and how far the last is from it; all words between are covered.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("span", pa.int64())])
    out, known = [], _WordHashes()
    shard = Shard([p for p in phrases.column("phrase").to_pylist()]) if phrases.num_rows else None
    for batch in docs.to_batches(max_chunksize=128) if shard else ():
        for doc_id, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = _words(text)
            if len(words) < WINDOW or not len(places := shard.found(words)):
                continue
            h, grams, keys = key_phrases(words, known)
            at = np.flatnonzero(np.isin(keys, grams[places]))
            if len(at):
                h1, h2 = (run_hashes(h, WINDOW, f)[at] for f in _FACTORS)
                h2 = (h2 >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((at, h2, h1))
                at, h1, h2 = at[order], h1[order].view(np.int64), h2[order].view(np.int32)
                first = np.flatnonzero(np.r_[True, (np.diff(at) > WINDOW) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
                last = np.r_[first[1:], len(at)] - 1
                rows = h1[first], h2[first], np.full(len(first), doc_id), np.full(len(first), tag), at[first] << 32 | (at[last] - at[first])
                out.append(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema))
    del shard, known  # the automaton and the words go before the rows are passed on
    give_back()
    return pa.Table.from_batches(out, schema)


def _merged(spans: pd.Series) -> pd.Series:
    """Bounds start, end, start, end, ... of the words that the windows of spans cover."""
    out = []
    for s in spans:
        s = np.sort(np.asarray(s, dtype=np.int64))
        start, end = s >> 32, np.maximum.accumulate((s >> 32) + (s & 0xFFFFFFFF) + WINDOW)
        new = np.flatnonzero(start[1:] > end[:-1]) + 1
        out.append(np.stack([start[np.r_[0, new]], end[np.r_[new - 1, len(s) - 1]]], axis=1).ravel().astype(np.int32))
    return pd.Series(out)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, copy, bounds): what the documents of docs (doc_id, text) lose, one row for each that may lose words.

    tag is a hash of the text; copy marks a text that a smaller document has too; bounds are start, end, ... in words.
    """
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("tag")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = docs.select("doc_id", "tag", F.md5("text").alias("whole"), F.octet_length("text").alias("bytes"))
    texts = staged(texts, "texts")
    least = texts.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("whole").alias("w"), "least")
    copies = staged(texts.join(least, F.col("whole") == F.col("w")).where("doc_id > least").select("doc_id", "tag").distinct(), "copies")
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    bundles = max(1, math.ceil(total / BUNDLE_BYTES))
    few = copies.count() <= FEW_ROWS
    firsts = docs.join(F.broadcast(copies) if few else copies, ["doc_id", "tag"], "left_anti")
    firsts = firsts.withColumn("bundle", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(bundles)).cast("int"))

    held = staged(firsts.select("doc_id", "bundle", "text").mapInArrow(tidy(_phrases), "phrase binary, doc_id long, bundle int"), "phrases")
    recurring = held.groupBy("phrase").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("phrase").alias("p"))
    shards = staged(held.join(recurring, F.col("phrase") == F.col("p")).select("phrase", F.col("bundle").alias("shard")).distinct(), "shards")
    drop_staged(held)

    windows = firsts.select("doc_id", "tag", "text", "bundle").groupBy("bundle").cogroup(shards.groupBy("shard")).applyInArrow(_candidates, _CANDIDATE)
    windows = staged(windows, "windows")
    drop_staged(shards)
    holders = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    holders = holders.select(F.col("h1").alias("a"), F.col("h2").alias("b"), "least")
    lost = windows.join(holders, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))).where("doc_id > least")
    lost = lost.groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans"))  # a document's own windows: no more than its words
    spans = lost.select("doc_id", "tag", F.lit(False).alias("copy"), F.pandas_udf(_merged, "array<int>")("spans").alias("bounds"))
    found = staged(spans.union(copies.select("doc_id", "tag", F.lit(True), F.array().cast("array<int>"))), "repeated")
    drop_staged(windows)
    return found


def _kept(words: list[bytes], copy: bool | None, bounds: list[int] | None) -> list[bytes]:
    if copy:
        return words if len(words) < WINDOW else []
    out, last = [], 0
    for start, end in zip((bounds or [])[::2], (bounds or [])[1::2], strict=True):
        out += words[last:start]
        last = end
    return out + words[last:]


def _with_spans(docs: DataFrame, copy: str, bounds: str) -> DataFrame:
    """docs with what repeated() tells of each row under the names copy and bounds, which docs doesn't have."""
    doc, tag = unused(docs, "doc", "tag")
    spans = repeated(docs)
    rows, n = spans.agg(F.count("*"), F.sum(F.size("bounds"))).first()
    spans = spans.select(F.col("doc_id").alias(doc), F.col("tag").alias(tag), F.col("copy").alias(copy), F.col("bounds").alias(bounds))
    few = rows <= FEW_ROWS and (n or 0) <= FEW_BOUNDS
    return docs.join(F.broadcast(spans) if few else spans, (F.col("doc_id") == F.col(doc)) & (F.hash("text") == F.col(tag)), "left").select(*docs.columns, copy, bounds)


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""

    def run(batches):
        for part in _rows(batches):
            n, lost, sha = [], [], []
            for text, copy, bounds in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("copy").to_pylist(), part.column("bounds").to_pylist(), strict=True):
                words = _words(text)
                kept = _kept(words, copy, bounds)
                n.append(len(words))
                lost.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "copy", "bounds").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without their repeated passages, in the columns of docs. A text that loses words keeps the rest, joined by single spaces, and gets its n_chars; a row that loses all its words goes."""

    def cut(text: pd.Series, copy: pd.Series, bounds: pd.Series) -> pd.Series:
        out = []
        for t, c, b in zip(text, copy, bounds, strict=True):
            words = _words(t.encode()) if t else []
            kept = _kept(words, bool(c) if c is not None else None, None if b is None else list(b))
            out.append(t if len(kept) == len(words) else b" ".join(kept).decode() or None)
        return pd.Series(out, dtype=object)

    copy, bounds, kept = unused(docs, "copy", "bounds", "kept")
    touched = F.col(copy).isNotNull()
    rows = _with_spans(docs, copy, bounds)
    rows = rows.withColumn(kept, F.when(touched, F.pandas_udf(cut, "string")("text", copy, bounds)).otherwise(F.col("text")))
    rows = rows.where(~touched | F.col(kept).isNotNull())
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(touched, F.length(kept).cast("long")).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.col(kept)).select(*docs.columns)


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 48)) AS place, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, place, md5(array_to_string(w[place:place + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
lost AS (SELECT doc_id, list(place) AS places FROM h JOIN f USING (h) WHERE doc_id > least GROUP BY doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS k FROM (SELECT doc_id, unnest(places) AS place FROM lost)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN covered USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

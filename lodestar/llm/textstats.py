"""Statistics of whole texts for the classifiers, the sample they are fitted on, and scoring all documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import in_small_batches, tidy

#: Labelled rows that a classifier is fitted on at most: those of least hash.
SAMPLE = 20_000
#: Words whose numbers a worker keeps.
KNOWN_WORDS = 150_000
#: Words around a hit in which a second person counts as near.
NEAR = 4

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ya ur du dich dir dein deine deinen deinem deiner deines ihr euch euer eure "
    "tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros vosotras vuestro vuestra os".split()
)
#: What obfuscated letters stand for.
PLAIN = str.maketrans("013457@$!|", "oieastasil")

# Flags of a word.
CAPITALS, DIGITS, SECOND, HIT, HIDDEN, ODD, NO_LETTERS, STOP = (1 << k for k in range(8))

NAMES = (
    "log_words", "word_length", "upper", "symbols", "capitals", "digits", "no_letters", "variety", "top_word", "adjacent_repeats",
    "repeated_pairs", "stops", "bangs", "pipes", "repeated_lines", "log_line", "length_spread",
    "hit_rate", "log_hits", "distinct_hits", "hidden_rate", "odd_rate", "second_rate", "near_second",
)
#: Those that need no lexicon.
PLAIN_NAMES = NAMES[:17]

Lexicon = dict[str, float]


def terms(word: str) -> list[str]:
    """What a lexicon may list of a word of letters: itself, and its stems of 4 to 7 letters, marked by a star."""
    return [word, *(word[:k] + "*" for k in range(4, min(8, len(word))))]


def bare(word: str) -> str:
    """A word in lower case, without what is no letter or digit at its ends."""
    w = word.lower()
    if w.isalpha():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


class WordNumbers(dict):
    """Of each word one number: its hash in 32 bits, its flags in 8, length in 8, upper-case letters in 8, symbols in 7."""

    def __init__(self, lexicon: Lexicon | None = None):
        super().__init__()
        self.lexicon = lexicon or {}

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        core = bare(word)
        letters = sum(map(str.isalpha, word))
        upper = sum(map(str.isupper, word))
        digits = sum(map(str.isdigit, word))
        flags = CAPITALS * (upper >= 2 and upper == letters) | DIGITS * (digits > 0) | SECOND * (core in SECOND_PERSON) | NO_LETTERS * (letters == 0) | STOP * (word[-1] in ".!?")
        odd = bool(letters) and not core.isalpha()
        flags |= ODD * odd
        if self.lexicon:
            if any(t in self.lexicon for t in terms(core)):
                flags |= HIT
            elif odd and any(t in self.lexicon for t in terms("".join(filter(str.isalpha, core.translate(PLAIN))))):
                flags |= HIDDEN
        self[word] = found = zlib.crc32(word.encode()) | flags << 32 | min(len(word), 255) << 40 | min(upper, 255) << 48 | min(len(word) - letters - digits, 127) << 56
        return found


_SPACES = {c: " " for c in range(0x09, 0x0E)}


def statistics(text: str | None, numbers: WordNumbers) -> np.ndarray:
    """The numbers NAMES of a text; a null text is empty."""
    out = np.zeros(len(NAMES))
    text = text or ""
    words = text.encode().split()  # at the six ASCII white-space characters
    n = len(words)
    if not n:
        return out
    x = np.fromiter(map(numbers.__getitem__, map(bytes.decode, words)), np.uint64, n)
    same, flags = (x & np.uint64(0xFFFFFFFF)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(0xFF)).astype(np.int64)
    length, upper, symbols = ((x >> np.uint64(s)) & np.uint64(m) for s, m in ((40, 0xFF), (48, 0xFF), (56, 0x7F)))
    chars = max(1.0, float(length.sum()))
    rate = lambda flag: float(np.count_nonzero(flags & flag)) / n
    ordered = np.sort(same)
    new = np.flatnonzero(np.diff(ordered)) + 1
    counts = np.diff(np.r_[0, new, n])
    pairs = np.unique(same[:-1] * 0x9E3779B1 + same[1:]).size if n > 1 else 0
    lines = [s for s in text.split("\n") if s.strip()]
    out[:17] = (
        np.log1p(n), chars / n, upper.sum() / chars, symbols.sum() / chars, rate(CAPITALS), rate(DIGITS), rate(NO_LETTERS),
        np.log(len(counts) + 1) / np.log(n + 1), counts.max() / n, np.count_nonzero(same[1:] == same[:-1]) / n, 1 - pairs / (n - 1) if n > 1 else 0.0,
        rate(STOP), text.count("!") / n, text.count("|") / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), length.astype(float).std(),
    )
    out[20:23] = rate(HIDDEN), rate(ODD), rate(SECOND)
    hits = np.flatnonzero(flags & (HIT | HIDDEN))
    if len(hits):
        second = np.flatnonzero(flags & SECOND)
        left = np.searchsorted(second, hits - NEAR)
        near = np.searchsorted(second, hits + NEAR, side="right") > left
        out[17:20] = len(hits) / n, np.log1p(len(hits)), np.unique(same[hits]).size
        out[23] = near.mean()
    return out


def held_out(doc_id: Column, fold: int, folds: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder fold; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, folds: int) -> DataFrame:
    """(doc_id, text, y) of the training rows: labelled 0 or 1, not held out, SAMPLE of least hash at most, texts once each.

    The chosen ids are broadcast: SAMPLE rows. Of labels that share an id, or a text, the largest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), fold, folds))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    found = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).drop("_id")
    return found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).select("doc_id", "text", "y")


def matrix(rows: DataFrame, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, labels and ids of a bounded sample, in order of the id."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon or {})

    def run(batches):
        numbers = WordNumbers(shared.value)
        for part in slices(batches):
            x = [statistics(t, numbers) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = rows.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(tidy(run), "doc_id long, y int, x array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(NAMES))
    return x, found["y"].to_numpy(dtype=float), found["doc_id"].to_numpy()


def slices(batches, size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def scored(docs: DataFrame, model: Callable[[np.ndarray], np.ndarray], lexicon: Lexicon | None, fold: int, folds: int, bar: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model, lexicon or {}))

    def run(batches):
        model, lexicon = shared.value
        numbers = WordNumbers(lexicon)
        for part in slices(batches):
            x = np.array([statistics(t, numbers) for t in part.column(2).to_pylist()]).reshape(-1, len(NAMES))
            score = np.clip(model(x), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= bar).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id"), fold, folds).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")

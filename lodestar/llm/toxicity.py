"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are rates of a text: hits of a lexicon, plain and obfuscated, their closeness to a second person, capitals,
punctuation and obfuscation. The lexicon is learned from the training rows: words, and stems that inflected words share,
which are far more frequent in toxic texts. Lexicon and trees are fitted on two thirds of the sample, calibration on the rest,
of which neither has seen a label.

Only labelled rows that aren't held out are learned from, textstats.SAMPLE of them at most; every document is scored on
its whole text. Labels, languages, sources and ids are no features.

Defined results: a null or empty text scores as a text without words; rows with a null doc_id are scored and not held out;
repeated rows score alike; without training rows of either label every score is the share of label 1 (0.0 without rows);
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import textstats
from lodestar.llm.boosting import Boosted, Isotonic, sigmoid
from lodestar.llm.common import staged, tidy

FOLD, FOLDS = 0, 5
BAR = 0.5
#: Terms of the lexicon at most, their least log odds, and the toxic texts that must hold one.
TERMS = 4_000
LEAST_ODDS = 3.0
LEAST_TEXTS = 4
LEAST_SHARE = 0.004


@dataclass
class Model:
    trees: Boosted | None
    calibration: Isotonic | None = None
    share: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        margin = self.trees.margin(x)
        return self.calibration(margin) if self.calibration else sigmoid(margin)


def learned_lexicon(rows: DataFrame) -> textstats.Lexicon:
    """Terms whose log odds in toxic texts of rows (text, y) are high, with these. TERMS rows reach the driver at most."""

    def run(batches):
        seen: dict[str, list[int]] = {}
        n = Counter()
        for part in textstats.slices(batches):
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n[y] += 1
                words = {textstats.bare(w) for w in (text or "").split()}
                for term in {t for w in words if w.isalpha() for t in textstats.terms(w)}:
                    seen.setdefault(term, [0, 0])[y] += 1
        terms = ["", *seen]
        counts = [[n[0], n[1]], *seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=["term", "clean", "toxic"])

    counts = staged(rows.select("text", "y").mapInArrow(tidy(run), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "terms")
    total = counts.where("term = ''").first()
    if total is None:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
    least = max(LEAST_TEXTS, LEAST_SHARE * total["toxic"])
    kept = counts.where(F.col("term") != "").withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (F.col("toxic") >= least))
    return {r["term"]: r["odds"] for r in kept.orderBy(F.desc("toxic"), F.desc("odds"), "term").limit(TERMS).collect()}


def _calibrates(ids: np.ndarray) -> np.ndarray:
    """Which rows are for calibration: a third, by the crc32 of the id beyond what it says about the folds."""
    return np.array([zlib.crc32(str(i).encode()) // FOLDS % 3 == 2 for i in ids], bool)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, textstats.Lexicon]:
    """The model and lexicon learned from the labelled rows that aren't held out."""
    rows = staged(textstats.labelled(docs, labels, "toxic", FOLD, FOLDS), "labelled")
    known = rows.select("doc_id", "y").toPandas()  # textstats.SAMPLE rows at most
    third = _calibrates(known["doc_id"])
    enough = all(len(set(known["y"][part])) == 2 for part in (third, ~third))
    calibrates = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / FOLDS) % 3 == 2
    lexicon = learned_lexicon(rows.where(~calibrates) if enough else rows)
    x, y, ids = textstats.matrix(rows, lexicon)
    if len(set(y)) < 2:
        return Model(None, share=float(y.mean()) if len(y) else 0.0), lexicon
    third = _calibrates(ids)
    trees = Boosted.fit(x[~third], y[~third]) if enough else Boosted.fit(x, y)
    return Model(trees, Isotonic.fit(trees.margin(x[third]), y[third]) if enough else None), lexicon


def score(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, by a model learned from training_docs and labels."""
    model, lexicon = fit(training_docs, labels)
    return textstats.scored(docs, model, lexicon, FOLD, FOLDS, BAR)


def without_toxic(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below BAR, in the columns of docs."""
    model, lexicon = fit(training_docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model, lexicon))

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, lexicon = shared.value
        numbers = textstats.WordNumbers(lexicon)
        for text in batches:
            x = np.array([textstats.statistics(t, numbers) for t in text]).reshape(-1, len(textstats.NAMES))
            yield pd.Series(model(x))

    return docs.where(score_of("text") < BAR)

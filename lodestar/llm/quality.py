"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class, good and bad, is a normal distribution of the statistics of textstats.PLAIN_NAMES, made even by a power
transform and standardised. Its covariance is shrunk towards the pooled one and towards a multiple of the identity; its
Cholesky factor is kept, so a score needs two triangular products. The difference of the log densities, from Mahalanobis
distances and log determinants, becomes a probability by a rising logistic function fitted on a part of the sample of its own.

Only labelled rows that aren't held out are learned from, textstats.SAMPLE of them at most; every document is scored on
its whole text. Labels, languages, sources and ids are no features.

Defined results: a null or empty text scores as a text without words; rows with a null doc_id are scored and not held out;
repeated rows score alike; without training rows of either label every score is the share of label 1 (0.0 without rows);
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lodestar.llm import textstats
from lodestar.llm.boosting import sigmoid
from lodestar.llm.common import staged

FOLD, FOLDS = 2, 4
BAR = 0.7
#: Shrinkage towards the pooled covariance, and towards the identity.
TO_POOLED = 0.1
TO_IDENTITY = 0.02
#: How far, in standard deviations, a statistic may lie out.
FARTHEST = 8.0
#: Steps and ridge of the logistic fit.
STEPS = 100
RIDGE = 1e-3


def transformed(x: np.ndarray) -> np.ndarray:
    """Rates, whose small values matter most, as their fourth roots; the rest as they are (log counts, spreads)."""
    x, rates = x[:, : len(textstats.PLAIN_NAMES)].copy(), [k for k, name in enumerate(textstats.PLAIN_NAMES) if name not in ("log_words", "word_length", "variety", "log_line", "length_spread")]
    x[:, rates] = np.sqrt(np.sqrt(np.maximum(x[:, rates], 0)))
    return x


@dataclass
class Discriminant:
    centre: np.ndarray
    spread: np.ndarray
    #: Of each class: mean, inverse of the Cholesky factor, log of the root of the determinant.
    classes: list[tuple[np.ndarray, np.ndarray, float]]
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Discriminant:
        z = transformed(x)
        model = cls(z.mean(axis=0), np.maximum(z.std(axis=0), 1e-6), [])
        third = np.arange(len(y)) % 3 == 2
        if any(len(set(y[part])) < 2 for part in (third, ~third)):
            third = np.zeros(len(y), bool)
        model._fit_classes(model._even(x)[~third], y[~third])
        part = third if third.any() else ~third
        model._fit_logistic(model.difference(x[part]), y[part])
        return model

    def _even(self, x: np.ndarray) -> np.ndarray:
        return np.clip((transformed(x) - self.centre) / self.spread, -FARTHEST, FARTHEST)

    def _fit_classes(self, z: np.ndarray, y: np.ndarray) -> None:
        means = [z[y == c].mean(axis=0) for c in (0, 1)]
        scatters = [(d := z[y == c] - means[c]).T @ d for c in (0, 1)]
        pooled = (scatters[0] + scatters[1]) / max(1, len(z) - 2)
        for mean, scatter, n in zip(means, scatters, ((y == 0).sum(), (y == 1).sum()), strict=True):
            own = scatter / max(1, n - 1)
            few = z.shape[1] / (z.shape[1] + n)  # the fewer rows, the more of the pooled
            share = max(TO_POOLED, few)
            own = (1 - share) * own + share * pooled
            own = (1 - TO_IDENTITY) * own + TO_IDENTITY * max(np.trace(own) / len(own), 1e-6) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.classes.append((mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of the good class less that of the bad one, compressed so that far-off texts don't dominate."""
        z = self._even(x)
        bad, good = (-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - log_root for mean, inverse, log_root in self.classes)
        d = good - bad
        return np.sign(d) * np.log1p(np.abs(d))

    def _fit_logistic(self, d: np.ndarray, y: np.ndarray) -> None:
        w = np.zeros(2)
        a = np.stack([d, np.ones(len(d))], axis=1)
        for _ in range(STEPS):
            p = sigmoid(a @ w)
            gradient = a.T @ (p - y) + RIDGE * w
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(2), gradient)
            w -= step / max(1.0, np.abs(step).max())
        self.slope, self.shift = max(float(w[0]), 1e-6), float(w[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.difference(x) + self.shift)


@dataclass
class Constant:
    share: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant | Constant:
    """The model learned from the labelled rows that aren't held out."""
    rows = staged(textstats.labelled(docs, labels, "quality", FOLD, FOLDS), "labelled")
    x, y, _ = textstats.matrix(rows)
    return Discriminant.fit(x, y) if len(set(y)) == 2 else Constant(float(y.mean()) if len(y) else 0.0)


def score(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, by a model learned from training_docs and labels."""
    return textstats.scored(docs, fit(training_docs, labels), None, FOLD, FOLDS, BAR)

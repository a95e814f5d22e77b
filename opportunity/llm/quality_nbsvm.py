"""Quality classifier: naive Bayes features in a linear support vector machine.

Indicators of word n-grams and of token-shape n-grams are scaled by the log ratio of their
smoothed shares in the two classes. A linear hinge-loss model is fitted on them by dual
coordinate descent, and blended with the mean weight as is usual for this model. Margins become
probabilities by a logistic curve fitted on out-of-fold margins.

The model is fitted on a bounded sample (``max_train`` labelled rows, 8,000 by default); every
row is scored. Nothing but the text is an input. Null and empty texts have no features and get
the score of the offset. With labels of one class only, or none, every score is that class's
smoothed share. Rows with the same doc_id are scored by their own texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opportunity.llm.common import beside_texts
from opportunity.llm.linear_text import SIZE, Grams, Rows, fit_platt, fitted, folds_of, labelled_sample, sigmoid

MAX_TRAIN = 8_000


def log_count_ratio(rows: Rows, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    good, bad = rows.counts(np.flatnonzero(y == 1)) + alpha, rows.counts(np.flatnonzero(y == 0)) + alpha
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_descent(rows: Rows, chosen: np.ndarray, y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over ``ratio``-scaled, length-normalised rows, and the offset.

    The classes weigh the same: each row's cost is divided by the share of its class.
    """
    rng = np.random.default_rng(seed)
    weights, offset = np.zeros(SIZE), 0.0
    signs = np.where(y == 1, 1.0, -1.0)
    values: dict[int, np.ndarray] = {}
    lengths: dict[int, float] = {}
    for i in chosen:
        v = ratio[rows.rows[i]]
        norm = np.sqrt((v * v).sum()) or 1.0
        values[i] = v / norm
        lengths[i] = float((values[i] ** 2).sum()) + 1.0
    share = {s: max(1, (signs[chosen] == s).sum()) / len(chosen) for s in (1.0, -1.0)}
    alpha = dict.fromkeys(chosen, 0.0)
    for _ in range(epochs):
        for i in rng.permutation(chosen):
            features, v, sign = rows.rows[i], values[i], signs[i]
            gradient = sign * (float(weights[features] @ v) + offset) - 1
            new = min(max(alpha[i] - gradient / lengths[i], 0.0), cost / (2 * share[sign]))
            if new != alpha[i]:
                step = (new - alpha[i]) * sign
                weights[features] += step * v
                offset += step
                alpha[i] = new
    return weights, offset


def _margins(rows: Rows, chosen: np.ndarray, ratio: np.ndarray, weights: np.ndarray, offset: float) -> np.ndarray:
    out = np.empty(len(chosen))
    for k, i in enumerate(chosen):
        v = ratio[rows.rows[i]]
        norm = np.sqrt((v * v).sum()) or 1.0
        out[k] = float(weights[rows.rows[i]] @ v) / norm + offset
    return out


@dataclass
class Quality:
    """A fitted quality model."""

    ratio: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        margin = self.offset
        if len(features):
            v = self.ratio[features]
            margin += float(self.weights[features] @ v) / (float(np.sqrt((v * v).sum())) or 1.0)
        return float(sigmoid(self.slope * margin + self.shift))


def fit(rows: Rows, y: np.ndarray, ids: list, cost: float = 1.0, epochs: int = 8, beta: float = 0.75, folds: int = 4) -> Quality:
    ones = float(y.sum())
    if not 0 < ones < len(y):
        share = (ones + 1) / (len(y) + 2)
        return Quality(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))

    def once(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        ratio = log_count_ratio(Rows([rows.rows[i] for i in chosen]), y[chosen])
        weights, offset = dual_descent(rows, chosen, y, ratio, cost, epochs)
        mean = np.abs(weights).sum() / max(1, np.count_nonzero(weights))
        return ratio, (1 - beta) * mean * np.sign(weights) + beta * weights, offset

    fold, margins = folds_of(ids, folds), np.zeros(len(y))
    for k in range(folds):
        inside, outside = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(inside) and 0 < y[outside].sum() < len(outside):
            margins[inside] = _margins(rows, inside, *once(outside))
    slope, shift = fit_platt(margins, y)
    ratio, weights, offset = once(np.arange(len(y)))
    return Quality(ratio.astype(np.float32), weights.astype(np.float32), offset, slope, shift)


def held_out_column():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out rows are never read."""
    grams = Grams(words=2, shapes=True)
    usable = labels.filter(~held_out_column())
    model = fitted(labelled_sample(docs, usable, ["quality"], max_train), grams, ["quality"], lambda rows, y, ids: fit(rows, y["quality"], ids))

    read = docs.select(F.col("doc_id").cast("long"), "text")
    out = beside_texts(read, lambda: lambda texts: {"score": [model.score(grams.features(t)) for t in texts]}, "score double")
    return out.select("doc_id", F.coalesce(held_out_column(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

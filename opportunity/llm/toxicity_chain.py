"""Toxicity by a classifier chain.

Labels say only whether a text is toxic. The categories before ``toxic`` are kinds of toxic texts
that are learned from the sample: the toxic rows are parted by what tells them from the others
(spherical k-means over the features that toxic texts have more often), and each part is a
category of its own. No word lists are used, in any language.

Categories are predicted one after the other. The first model sees the hashed words of a text
and their beginnings, since word stems carry over in inflected languages; each later one also
sees the probabilities of the categories before it. When a later model is fitted, those probabilities come from models that were fitted without the row (out-of-fold), so
it learns how far to trust them; when a row is scored they come from the models fitted on all.
Each category's decision threshold has the best F1 on out-of-fold probabilities.

The models are logistic, fitted on a bounded sample (``max_train`` labelled rows, 8,000 by
default); every row is scored where it is read. Null and empty texts get each model's offset. A
category with one class only, or with no labels, has its smoothed share as probability and is
never predicted. Rows with the same doc_id are scored by their own texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opportunity.llm.common import arrow_batches, beside_texts, broadcast_if_small, written
from opportunity.llm.linear_text import SIZE, Rows, Stems, best_threshold, fitted, folds_of, labelled_sample, sigmoid

MAX_TRAIN = 8_000
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
#: Kinds of toxic texts, the categories before ``toxic``.
KINDS = 2

@dataclass
class Link:
    """One model of the chain: scale and weight of each feature, weights of earlier categories, offset, threshold."""

    name: str
    scale: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    offset: float
    threshold: float

    def probability(self, features: np.ndarray, before: list[float]) -> float:
        total = self.offset
        if before:
            total += float(self.earlier @ (np.array(before) - 0.5))
        if len(features):
            values = self.scale[features]
            total += float(self.weights[features] @ values) / (float(np.sqrt((values * values).sum())) or 1.0)
        return float(sigmoid(total))


def feature_scale(rows: Rows, chosen: np.ndarray, y: np.ndarray, least: int = 3) -> np.ndarray:
    """Log ratio of a feature's smoothed shares in both classes; 0 where fewer than ``least`` rows have it."""
    with_, without = chosen[y[chosen] == 1], chosen[y[chosen] == 0]
    a, b = rows.counts(with_), rows.counts(without)
    ratio = np.log((a + 0.5) / (len(with_) + 1)) - np.log((b + 0.5) / (len(without) + 1))
    return np.where(a + b >= least, ratio, 0.0)


def fit_logistic(rows: Rows, chosen: np.ndarray, y: np.ndarray, before: np.ndarray, epochs: int = 8, rate: float = 1.0, seed: int = 3):
    """Scale, weights, weights of earlier probabilities and offset, by adaptive gradient steps on unit rows."""
    rng = np.random.default_rng(seed)
    scale = feature_scale(rows, chosen, y)
    values = {}
    for i in chosen:
        v = scale[rows.rows[i]]
        values[i] = (v / (float(np.sqrt((v * v).sum())) or 1.0)).astype(np.float32)
    weights, squares = np.zeros(SIZE), np.full(SIZE, 1e-3)
    earlier, earlier_squares = np.zeros(before.shape[1]), np.full(before.shape[1], 1e-1)
    ones = y[chosen].sum()
    offset, offset_square = float(np.log((ones + 1) / (len(chosen) - ones + 1))), 1.0
    for _ in range(epochs):
        for i in rng.permutation(chosen):
            features, v, seen = rows.rows[i], values[i], before[i] - 0.5
            error = float(sigmoid(offset + weights[features] @ v + earlier @ seen)) - y[i]
            if abs(error) < 1e-3:
                continue
            step = error * v
            squares[features] += step * step
            weights[features] -= rate * step / np.sqrt(squares[features])
            earlier_squares += (error * seen) ** 2
            earlier -= rate * error * seen / np.sqrt(earlier_squares)
            offset_square += error * error
            offset -= rate * error / np.sqrt(offset_square)
    return scale.astype(np.float32), weights.astype(np.float32), earlier, offset


def fit_chain(rows: Rows, labels: dict[str, np.ndarray], ids: list, folds: int = 4) -> list[Link]:
    """The chain over the categories in the order of ``labels``."""
    fold = folds_of(ids, folds)
    everyone = np.arange(len(rows))
    before = np.zeros((len(rows), 0))
    chain: list[Link] = []
    for name, y in labels.items():
        ones = float(y.sum())
        if not 0 < ones < len(y):
            share = (ones + 1) / (len(y) + 2)
            chain.append(Link(name, np.zeros(SIZE), np.zeros(SIZE), np.zeros(before.shape[1]), float(np.log(share / (1 - share))), 2.0))
            before = np.column_stack([before, np.full(len(rows), share)])
            continue
        out = np.full(len(rows), ones / len(y))
        for k in range(folds):
            inside, outside = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(inside) and 0 < y[outside].sum() < len(outside):
                part = Link(name, *fit_logistic(rows, outside, y, before), 0.5)
                out[inside] = [part.probability(rows.rows[i], list(before[i])) for i in inside]
        chain.append(Link(name, *fit_logistic(rows, everyone, y, before), best_threshold(out, y)))
        before = np.column_stack([before, out])
    return chain


def toxic_kinds(rows: Rows, y: np.ndarray, kinds: int, turns: int = 12) -> dict[str, np.ndarray]:
    """Membership of each row in each kind of toxic texts; no row has a kind where there are too few toxic ones."""
    out = {f"kind_{k + 1}": np.zeros(len(y)) for k in range(kinds)}
    toxic = np.flatnonzero(y == 1)
    telling = np.maximum(feature_scale(rows, np.arange(len(y)), y), 0.0) if len(y) else np.zeros(SIZE)
    own = [rows.rows[i][telling[rows.rows[i]] > 0] for i in toxic]
    usable = [k for k, features in enumerate(own) if len(features)]
    if len(usable) < 2 * kinds:
        return out
    values = {k: telling[own[k]] / np.linalg.norm(telling[own[k]]) for k in usable}

    def likeness(centre: np.ndarray) -> np.ndarray:
        return np.array([centre[own[k]] @ values[k] for k in usable])

    def centre_of(members: list[int]) -> np.ndarray:
        centre = np.zeros(SIZE)
        for k in members:
            centre[own[k]] += values[k]
        return centre / (np.linalg.norm(centre) or 1.0)

    # Each centre starts at the text that is least like all centres before it.
    near = likeness(centre_of(usable))
    centres: list[np.ndarray] = []
    for _ in range(kinds):
        centres.append(centre_of([usable[int(near.argmin())]]))
        near = np.maximum(near, likeness(centres[-1])) if len(centres) > 1 else likeness(centres[-1])
    for _ in range(turns):
        part = np.argmax([likeness(c) for c in centres], axis=0)
        centres = [centre_of([k for k, p in zip(usable, part) if p == kind]) if (part == kind).any() else centres[kind] for kind in range(kinds)]
    for k, p in zip(usable, part):
        out[f"kind_{p + 1}"][toxic[k]] = 1.0
    return out


def fitted_chain(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, kinds: int = KINDS) -> tuple[list[Link], Stems]:
    """The chain over ``kinds`` kinds of toxic texts, then ``toxic``."""
    stems = Stems()
    sample = labelled_sample(docs, labels.select("doc_id", "toxic"), ["toxic"], max_train)

    def fit(rows: Rows, found: dict[str, np.ndarray], ids: list) -> list[Link]:
        return fit_chain(rows, toxic_kinds(rows, found["toxic"], kinds) | {"toxic": found["toxic"]}, ids)

    return fitted(sample, stems, ["toxic"], fit), stems


def toxicity_scores(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, a probability for each category and ``toxic`` (the decision) of every row."""
    return scored(docs, *fitted_chain(docs, labels, **parameters))


def without_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns.

    The decisions are written first, by doc_id and text hash, so the rows themselves never pass
    through Python.
    """
    chain, stems = fitted_chain(docs, labels, **parameters)

    def judge(texts: list[str | None]) -> dict[str, list]:
        return {"toxic": [probabilities(chain, stems.features(t))[-1] >= chain[-1].threshold for t in texts]}

    place, tie = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    with arrow_batches(docs.sparkSession):
        judged = beside_texts(docs.select(place.alias("_place"), tie.alias("_tie"), "text"), lambda: judge, "toxic boolean")
        gone = written(judged.filter("toxic").select("_place", "_tie").distinct(), "toxic")
    gone = broadcast_if_small(gone)
    return docs.join(gone, (place == F.col("_place")) & (tie == F.col("_tie")), "left_anti")


def probabilities(chain: list[Link], features: np.ndarray) -> list[float]:
    """Probability of each category; each model sees those before it."""
    before: list[float] = []
    for link in chain:
        before.append(link.probability(features, before))
    return before


def scored(docs: DataFrame, chain: list[Link], stems: Stems) -> DataFrame:
    """doc_id, p_<category> for each category, and the decision of the last one."""
    last = chain[-1]

    def score(texts: list[str | None]) -> dict[str, list]:
        found = np.array([probabilities(chain, stems.features(t)) for t in texts]).reshape(len(texts), len(chain))
        return {f"p_{link.name}": found[:, k] for k, link in enumerate(chain)} | {last.name: found[:, -1] >= last.threshold}

    added = ", ".join([*(f"p_{link.name} double" for link in chain), f"{last.name} boolean"])
    return beside_texts(docs.select(F.col("doc_id").cast("long"), "text"), lambda: score, added)

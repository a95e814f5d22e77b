"""The fits of the quality and toxicity models against dense solvers, and scores against dense sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opportunity.llm import linear_text, quality_nbsvm, toxicity_chain
from opportunity.llm.common import table

SF = "/root/testdata/sf0.001"
WIDTH = 12


@pytest.fixture(scope="module")
def sample():
    """200 rows of at most 12 features whose labels follow two of them, with noise."""
    rng = np.random.default_rng(4)
    dense = (rng.random((200, WIDTH)) < 0.4).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(2 * dense[:, 0] - 2 * dense[:, 1])))).astype(float)
    return dense, linear_text.Rows([np.flatnonzero(r) for r in dense]), y


def test_log_count_ratio_by_dense_sums(sample):
    dense, rows, y = sample
    ratio = quality_nbsvm.log_count_ratio(rows, y)
    good, bad = 1 + dense[y == 1].sum(0), 1 + dense[y == 0].sum(0)
    rest = linear_text.SIZE - WIDTH
    want = np.log(good / (good.sum() + rest)) - np.log(bad / (bad.sum() + rest))
    assert np.allclose(ratio[:WIDTH], want)


def test_dual_descent_reaches_the_optimum_of_a_dense_solver(sample):
    dense, rows, y = sample
    ratio = quality_nbsvm.log_count_ratio(rows, y)
    scaled = dense * ratio[:WIDTH]
    norms = np.linalg.norm(scaled, axis=1, keepdims=True)
    x = np.column_stack([scaled / np.where(norms > 0, norms, 1), np.ones(200)])
    signs = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    bound = 1.0 / (2 * share)

    # Projected gradient on the whole dual at once.
    kernel = (x * signs[:, None]) @ (x * signs[:, None]).T
    alpha, rate = np.zeros(200), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - rate * (kernel @ alpha - 1), 0, bound)
    best = x.T @ (alpha * signs)

    weights, offset = quality_nbsvm.dual_descent(rows, np.arange(200), y, ratio, 1.0, 400)
    found = np.append(weights[:WIDTH], offset)
    assert not weights[WIDTH:].any()

    def primal(w):
        return w @ w / 2 + (bound * np.maximum(0, 1 - signs * (x @ w))).sum()

    assert primal(found) == pytest.approx(primal(best), rel=1e-3)
    assert np.allclose(found, best, atol=0.02)


def test_logistic_fit_is_near_the_loss_of_newton_steps(sample):
    dense, rows, y = sample
    before = np.random.default_rng(6).random((200, 1))
    scale, weights, earlier, offset = toxicity_chain.fit_logistic(rows, np.arange(200), y, before, epochs=300)
    scaled = dense * scale[:WIDTH]
    norms = np.linalg.norm(scaled, axis=1, keepdims=True)
    x = np.column_stack([scaled / np.where(norms > 0, norms, 1), before - 0.5, np.ones(200)])

    def loss(w):
        return np.logaddexp(0, -np.where(y == 1, 1, -1) * (x @ w)).mean()

    best = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ best)))
        best -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(best)), x.T @ (p - y) + 1e-6 * best)
    found = np.concatenate([weights[:WIDTH], earlier, [offset]])
    assert loss(best) <= loss(found) <= 1.01 * loss(best) < loss(np.zeros(len(best)))


def test_quality_scores_by_dense_sums(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    grams = linear_text.Grams(words=2, shapes=True)
    usable = labels.filter(~quality_nbsvm.held_out_column())
    model = linear_text.fitted(linear_text.labelled_sample(docs, usable, ["quality"], 8_000), grams, ["quality"], lambda rows, y, ids: quality_nbsvm.fit(rows, y["quality"], ids))
    found = {r.doc_id: r for r in quality_nbsvm.quality_scores(docs, labels).collect()}
    for row in docs.collect():
        dense = np.zeros(linear_text.SIZE)
        dense[grams.features(row.text)] = 1
        v = dense * model.ratio
        margin = model.offset + (model.weights @ v) / (np.linalg.norm(v) or 1.0)
        score = 1 / (1 + math.exp(-(model.slope * margin + model.shift)))
        own = found[row.doc_id]
        assert own.score == pytest.approx(score, abs=1e-5) and own.predicted == int(own.score >= 0.7)


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality_nbsvm.held_out_column(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert turned.exceptAll(labels).count() > 0
    one, two = ({r.doc_id: r.score for r in quality_nbsvm.quality_scores(docs, known).collect()} for known in (labels, turned))
    assert one == two


def test_toxicity_scores_by_dense_sums(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain, stems = toxicity_chain.fitted_chain(docs, labels)
    found = {r.doc_id: r for r in toxicity_chain.toxicity_scores(docs, labels).collect()}
    for row in docs.collect():
        dense, before = np.zeros(linear_text.SIZE), []
        dense[stems.features(row.text)] = 1
        for link in chain:
            v = dense * link.scale
            margin = link.offset + link.weights @ (v / (np.linalg.norm(v) or 1.0)) + sum(w * (p - 0.5) for w, p in zip(link.earlier, before))
            before.append(1 / (1 + math.exp(-margin)))
            assert found[row.doc_id][f"p_{link.name}"] == pytest.approx(before[-1], abs=1e-4)
        assert found[row.doc_id].toxic == (found[row.doc_id].p_toxic >= chain[-1].threshold)

"""Hashed n-gram indicators and the linear models that are fitted on them.

Models are fitted on a bounded sample of labelled rows, whose bound is a parameter; every row
is scored where it is read. Features come from the text alone.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opportunity.llm.common import arrow_batches, give_back, giving_back, let_go

BITS = 18
SIZE = 1 << BITS
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
MAX_MEMORY = 60_000
#: Rows that are counted together: the counting copies their features as 64-bit numbers.
COUNT_ROWS = 250
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Shapes of tokens, kept in the low bits of a token's code.
LOWER, TITLE, UPPER, MIXED, DIGITS, MARK, MARKS, ONE = range(8)


def _shape(token: bytes) -> int:
    if token[0] < 0x80 and not token.isalnum() and not any(b >= 0x80 for b in token):
        return MARK if len(token) == 1 else MARKS
    if token.isdigit():
        return DIGITS
    text = token.decode("utf-8", "replace")
    if len(text) == 1:
        return ONE
    return LOWER if text.islower() else UPPER if text.isupper() else TITLE if text.istitle() else MIXED


class Grams:
    """Sorted distinct feature numbers of texts.

    ``words`` sets the longest n-gram of lower-cased words. With ``shapes``, n-grams of token
    shapes (upper, title, digits, marks and so on, and whether a token repeats the one before or
    the one before that) and a step of the share of distinct tokens are added.
    """

    def __init__(self, words: int = 2, shapes: bool = False):
        self.words, self.shapes = words, shapes
        self.memory: dict[bytes, int] = {}

    def codes(self, text: str | None) -> np.ndarray:
        tokens = TOKENS.findall((text or "").encode())
        if len(self.memory) > MAX_MEMORY:
            self.memory = {}
        known = self.memory
        for token in set(tokens).difference(known):
            known[token] = xxhash.xxh64_intdigest(token.decode("utf-8", "replace").lower().encode()) & ~7 | (_shape(token) if self.shapes else 0)
        return np.array([known[token] for token in tokens], np.uint64)

    def features(self, text: str | None) -> np.ndarray:
        codes = self.codes(text)
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64)
        words = codes >> np.uint64(3)
        found, gram = [], np.zeros(n, np.uint64)
        for k in range(self.words):
            gram = (gram[: n - k] * P1 + words[k:]) * P2 if n > k else gram[:0]
            found.append(gram + np.uint64(k))
        if self.shapes:
            shape = (codes & np.uint64(7)).astype(np.uint64)
            shape[1:] += np.uint64(8) * (words[1:] == words[:-1])
            shape[2:] += np.uint64(16) * (words[2:] == words[:-2])
            for width in (1, 2, 3):
                gram = np.full(max(0, n - width + 1), width + 100, np.uint64)
                for k in range(width):
                    gram = gram * np.uint64(33) + shape[k : n - width + 1 + k]
                found.append(np.unique(gram) * P3)
            distinct = int(10 * len(np.unique(words)) / n)
            found.append((np.array([1000 + distinct, 1100 + min(12, n.bit_length())], np.uint64)) * P3)
        every = np.concatenate(found)
        return np.unique((every ^ (every >> np.uint64(29))) * P2 >> np.uint64(64 - BITS)).astype(np.int64)


class Stems:
    """Sorted distinct feature numbers of the lower-cased words of a text and of their beginnings."""

    def __init__(self, lengths: tuple[int, ...] = (3, 4, 5, 6)):
        self.lengths = lengths
        self.memory: dict[str, tuple[int, ...]] = {}

    def _numbers(self, word: str) -> tuple[int, ...]:
        parts = [word + "$", *(word[:k] for k in self.lengths if len(word) > k)]
        return tuple(xxhash.xxh32_intdigest(part) >> (32 - BITS) for part in parts)

    def features(self, text: str | None) -> np.ndarray:
        words = set(re.findall(r"\w+", (text or "").lower()))
        if len(self.memory) > MAX_MEMORY:
            self.memory = {}
        known = self.memory
        for word in words.difference(known):
            known[word] = self._numbers(word)
        return np.array(sorted({number for word in words for number in known[word]}), np.int64)


class Rows:
    """Sparse indicator rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen rows each feature stands."""
        found = np.zeros(SIZE, np.int64)
        for k in range(0, len(chosen), COUNT_ROWS):
            found += np.bincount(np.concatenate([self.rows[i] for i in chosen[k : k + COUNT_ROWS]]), minlength=SIZE)
        return found.astype(float)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps on smoothed targets."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        g = np.array([((p - target) * margins).sum() + 1e-6 * a, (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margins * margins).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on out-of-fold scores, in the middle of its gap."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + max(1, y.sum()))
    last = np.append(s[1:] < s[:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int, seed: int = 11) -> DataFrame:
    """doc_id, text and labels of at most ``max_rows`` rows, the first by a keyed hash of doc_id.

    Rows with a null id or label are left out; of rows with one id the smallest text is taken. The
    bound makes the chosen ids fit for broadcast.
    """
    known = labels.select("doc_id", *columns).dropna()
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", *columns).agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, grams: Grams | Stems, columns: list[str], fit: Callable[[Rows, dict[str, np.ndarray], list], object]) -> object:
    """What ``fit`` makes of the features, labels and ids of a bounded sample, in the order of doc_id.

    Features are taken where the rows are; one task fits, so the driver holds only the model.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", *columns]].copy()
            out["features"] = [grams.features(t).astype(np.int32).tobytes() for t in batch["text"]]
            yield out

    def model_of(found: pa.Table) -> bytes:
        keys = found.select(["doc_id", *columns]).to_pandas().sort_values(["doc_id", *columns], kind="stable")
        features = [np.frombuffer(x.as_buffer(), np.int32) for x in found.column("features")]  # no copies
        rows = Rows([features[i] for i in keys.index])
        return pickle.dumps(fit(rows, {c: keys[c].to_numpy(dtype=float) for c in columns}, keys["doc_id"].tolist()))

    def learn(found: pa.Table) -> pa.Table:
        let_go()
        model = model_of(found)
        give_back()
        return pa.table({"model": pa.array([model], pa.binary())})

    wanted = ", ".join(f"{c} int" for c in columns)
    read = sample.select("doc_id", *[F.col(c).cast("int") for c in columns], "text")
    taken = read.mapInPandas(giving_back(extract), f"doc_id long, {wanted}, features binary").withColumn("_all", F.lit(0))
    with arrow_batches(sample.sparkSession):
        found = taken.groupBy("_all").applyInArrow(learn, "model binary").first()
    if found is None:
        return fit(Rows([]), {c: np.zeros(0) for c in columns}, [])
    return pickle.loads(found.model)


def folds_of(ids: list, folds: int) -> np.ndarray:
    """Fold of each row; rows of one id share one."""
    return np.array([xxhash.xxh32_intdigest(str(i)) % folds for i in ids], int)

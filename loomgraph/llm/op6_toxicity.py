"""Toxicity by a classifier chain.

The categories are predicted one after the other; each later linear model also gets the probabilities of the earlier
categories as features. While fitting, those probabilities are out-of-fold predictions, so that a later model sees
earlier ones as they are on unseen texts. Features are words (hashed; the `words` most telling ones by chi-square over
the fitting documents) and style. Fitting takes at most about `fit_docs` labelled documents; scoring reads all rows
and whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHash, by_bytes, shared, utf8
from loomgraph.llm.op2_quality import labelled
from loomgraph.llm.style import NAMES, Steps, styles

FIT_DOCS, FOLDS, WORDS, RIDGE, CUT = 12_000, 4, 400, 1e-5, 0.3
#: The chain's order.
CATEGORIES = ("junk", "toxic", "toxic_junk")
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))


def word_set(text: bytes, cache: WordHash) -> np.ndarray:
    return cache.array(list(set(text.translate(_SPLIT).split()))) >> np.uint64(2)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 600) -> np.ndarray:
    """Weights (the last one the constant) by accelerated gradient descent on the mean logistic loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1], x.dtype)
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else (8.0 if y[0] else -8.0)
        return w
    v = np.random.default_rng(0).standard_normal(x.shape[1]).astype(x.dtype)
    for _ in range(20):  # the greatest curvature, for the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(x @ v) ** 2 / len(x) / 4 + ridge)
    before = w.copy()
    for t in range(rounds):
        ahead = w + t / (t + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        before, w = w, ahead - step * (x.T @ (p - y) / len(y) + ridge * ahead)
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    categories: tuple[str, ...]
    steps: Steps
    words: np.ndarray  # sorted hashes of the chosen words
    weights: list[np.ndarray] = field(default_factory=list)

    def features(self, style: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.words)), np.float32)
        for i, s in enumerate(sets):
            if len(self.words) and len(s):
                at = np.minimum(np.searchsorted(self.words, s), len(self.words) - 1)
                x[i, at[self.words[at] == s]] = 1
        return np.hstack([self.steps(style).astype(np.float32), 3 * x])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: rows x categories, each fed to the later ones."""
        p = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            p = np.hstack([p, _odds(np.hstack([x, p]), w)[:, None]])
        return p


def _telling(sets: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The words whose presence differs most between the classes, by chi-square; five documents at least have each."""
    if not len(sets):
        return np.empty(0, np.uint64)
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.bincount(at)
    k = np.bincount(at, weights=np.repeat(y, [len(s) for s in sets]))
    share = y.mean()
    odd = (k - n * share) ** 2 / (n * share * (1 - share) + 1e-9) / (1 - n / (len(sets) + 1))
    odd[n < 5] = -1
    best = np.lexsort((every, -odd))[:most]
    return every[best[odd[best] > 3.84]]


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, folds: int = FOLDS, words: int = WORDS, seed: int = 6) -> Chain:
    """docs: doc_id, text; labels: doc_id, quality, toxic (0 or 1). Without labels every probability is 0.5."""

    def measure(batches):
        cache = WordHash()
        for batch in batches:
            style, sets = [], []
            for _, texts in by_bytes(utf8(batch.column(1))):
                style += styles(texts).tolist()
                sets += [np.sort(word_set(t, cache)).astype(np.uint64).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), batch.column(3).cast(pa.int32()), pa.array(style, pa.list_(pa.float64())), pa.array(sets, pa.binary())], ["doc_id", "quality", "toxic", "style", "words"])

    rows = labelled(docs, labels, ["quality", "toxic"], fit_docs, seed).mapInArrow(measure, "doc_id long, quality int, toxic int, style array<double>, words binary").toLocalIterator()
    known = sorted(((r.doc_id, r.quality, r.toxic, bytes(r.words), r.style) for r in rows), key=lambda r: r[:4])  # fit_docs rows at most
    style = np.array([r[4] for r in known], float).reshape(len(known), len(NAMES))
    sets = [np.frombuffer(r[3], np.uint64) for r in known]
    junk, toxic = np.array([r[1] == 0 for r in known], np.float32), np.array([r[2] == 1 for r in known], np.float32)
    targets = [junk, toxic, junk * toxic]
    chosen = [_telling(sets, y, words) for y in targets]
    chain = Chain(CATEGORIES, Steps(style), np.unique(np.concatenate(chosen)) if known else np.empty(0, np.uint64))
    x = chain.features(style, sets)
    fold = np.random.default_rng(seed).integers(0, folds, len(known))
    for y in targets:
        chain.weights.append(logistic(x, y))
        unseen = np.zeros(len(y), np.float32)
        for f in range(folds):
            unseen[fold == f] = _odds(x[fold == f], logistic(x[fold != f], y[fold != f]))
        x = np.hstack([x, unseen[:, None]])
    return chain


def classify(docs: DataFrame, chain: Chain, cut: float = CUT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, p_<category> for each category, toxic (p_toxic >= cut), score (= p_toxic).

    A null text is scored as an empty one. Repeated rows each give a row; other columns are not read."""
    sent = shared(docs.sparkSession, chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        chain, cache = sent(), WordHash()
        for batch in batches:
            p = [chain.predict(chain.features(styles(texts), [word_set(t, cache) for t in texts])) for _, texts in by_bytes(utf8(batch.column(1)))]
            p = np.vstack(p).astype(float) if p else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i], pa.float64()) for i in range(len(names)))], ["doc_id", *names])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} double" for c in names)]))
    return found.select("doc_id", *names, F.col("p_toxic").alias("score"), (F.col("p_toxic") >= cut).alias("toxic"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, fit(docs, labels))

"""Quality scores by Bradley-Terry pairwise ranking.

From labelled documents, preference pairs are drawn (one of label 1 over one of label 0); a linear score of text
features is learned by logistic loss on the pairs' feature differences. The scores are then cut at a quantile: the share
of label 0 among all labelled documents, in the scores of all of these. A logistic curve carries the cut to `CUT` on a scale
from 0 to 1.

Fitting the weights takes at most about `fit_docs` labelled documents and `pairs` pairs; the cut and the scores take all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_sample, by_bytes, crc_mod, shared, utf8, written
from loomgraph.llm.style import NAMES, Steps, styles

FIT_DOCS, PAIRS, RIDGE, CUT = 20_000, 60_000, 1e-3, 0.3


@dataclass
class Ranking:
    steps: Steps
    weights: np.ndarray
    at: float  # the score at the quantile
    spread: float

    def raw(self, texts: list[bytes]) -> np.ndarray:
        return self.steps(styles(texts)) @ self.weights

    def scaled(self, raw: Column) -> Column:
        odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (raw - self.at) / self.spread + float(np.log(CUT / (1 - CUT)))))
        return 1 / (1 + F.exp(-odds))


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-(better - worse) w)) plus a ridge, by Newton's method."""
    d = better - worse
    w = np.zeros(d.shape[1])
    if not len(d):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], fit_docs: int, seed: int) -> DataFrame:
    """The texts of a bounded sample of the labelled documents. The sample's ids and labels (at most about fit_docs rows) are broadcast."""
    some = bounded_sample(labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(f"label_{c}") for c in columns)).dropna(), "doc_id", fit_docs, seed, 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, pairs: int = PAIRS, seed: int = 2) -> Ranking:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1). Without both labels every text gets the same score."""

    def measure(batches):
        for batch in batches:
            x = [row for _, texts in by_bytes(utf8(batch.column(1))) for row in styles(texts).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = labelled(docs, labels, ["quality"], fit_docs, seed).mapInArrow(measure, "doc_id long, label int, x array<double>").toLocalIterator()
    known = sorted((r.doc_id, r.label, r.x) for r in rows)  # fit_docs rows at most; sorted, so that reruns agree
    x = np.array([r[2] for r in known], float).reshape(len(known), len(NAMES))
    y = np.array([r[1] for r in known], int)
    steps = Steps(x)
    if not len(y) or y.min() == y.max():
        return Ranking(steps, np.zeros(steps(x[:0]).shape[1]), 0.0, 1.0)
    z, draw = steps(x), np.random.default_rng(seed)
    w = bradley_terry(z[draw.choice(np.flatnonzero(y == 1), pairs)], z[draw.choice(np.flatnonzero(y == 0), pairs)])
    raw = z @ w
    return Ranking(steps, w, float(np.quantile(raw, (y == 0).mean())), float(max(1.0, raw.std() / 2)))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """docs (doc_id, text) -> doc_id, raw (the linear score). A null text is scored as an empty one. Repeated rows each give a row; other columns are not read."""
    sent = shared(docs.sparkSession, ranking)

    def run(batches):
        ranking = sent()
        for batch in batches:
            s = [x for _, texts in by_bytes(utf8(batch.column(1))) for x in ranking.raw(texts).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "raw"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, raw double")


def cut(ranking: Ranking, scored: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking cut at the quantile of all labelled documents' scores (approximate to 1 / 10,000), instead of the fitting sample's. No labels: as it was."""
    known = scored.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna(), "doc_id")
    low = known.agg(F.avg((F.col("quality") == 0).cast("double")).alias("low")).first().low
    if low is None or low in (0.0, 1.0):
        return ranking
    row = known.agg(F.percentile_approx("raw", low, 10_000).alias("at"), F.stddev_pop("raw").alias("spread")).first()
    above = known.where(F.col("raw") > row.at).agg(F.min("raw").alias("above")).first().above  # the cut lies halfway to the next score
    return replace(ranking, at=float(row.at if above is None else (row.at + above) / 2), spread=max(1.0, row.spread / 2))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns. Labels of held-out rows and of null ids are not read; a null id is not held out."""
    labels = labels.where(crc_mod("doc_id", 5) != 0)
    ranking = fit(docs, labels)
    scored = written(score(docs, ranking), "quality-scores")
    ranking = cut(ranking, scored, labels)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), ranking.scaled(F.col("raw")).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))

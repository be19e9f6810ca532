"""Quality scores by Bradley-Terry ranking: P(a is preferred to b) = sigmoid(s(a) - s(b)), s linear in text features.

Preference pairs are formed from labelled documents (one of label 1 before one of label 0, drawn by a seeded
generator) and the weights minimise the logistic loss on feature differences. A quantile turns scores into decisions:
the share of label 0 among the documents learned from, taken as a quantile of their scores, gives a cut, and scores
are mapped to (0, 1) by a logistic curve, fitted to the labels, that crosses THRESHOLD at the cut.

Features depend on the whole text and on nothing else: shares of character kinds and marks, repetition of words next
to each other and over the text, lengths of words and lines.

Defined results: null and empty texts have all features 0 and get the score that follows from that; without both
labels in the training table every score is THRESHOLD; repeated rows score alike; labels of equal documents may differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import whole_texts

THRESHOLD = 0.3
#: Labelled documents learned from, about so many, chosen by hash over all of them.
TRAIN_DOCS = 20_000
#: Preference pairs per gradient step, and steps.
PAIRS, STEPS = 8192, 400
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = len(_MARKS) + 12


def features(text: str | None) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = raw.sum()
    words = text.split()
    letters = raw[65:91].sum() + raw[97:123].sum() + raw[192:].sum()
    marks = raw[list(_MARKS)] / n
    k = len(words)
    same = sum(map(str.__eq__, words, words[1:]))
    distinct = len(set(words))
    lines = text.count("\n") + 1
    rest = (
        raw[65:91].sum() / max(1, letters),
        raw[48:58].sum() / n,
        letters / n,
        raw[128:].sum() / n,
        same / max(1, k - 1),
        # A text of k words has about k ** 0.8 distinct ones; repetition shows as a lack of them.
        distinct / max(1.0, k**0.8),
        math.log1p(k),
        math.log1p((n - raw[32]) / max(1, k)),
        math.log1p(k / lines),
        float(marks.sum() - marks[_MARKS.index(b".")] - marks[_MARKS.index(b",")]),
        float(text.rstrip()[-1:] in ".!?"),
        float(text[:1].isupper()),
    )
    # Marks count by the logarithm, so that a few and many differ as much as many and most.
    out[: len(_MARKS)] = np.log1p(200 * marks)
    out[len(_MARKS) :] = rest
    return out


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return self.probability(self.latent(x))

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack((z, z * z)) @ self.weights

    def probability(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def fit(x: np.ndarray, label: np.ndarray, seed: int = 7) -> Ranking:
    """Learn from the features of labelled documents; the rows' order must be fixed by the caller."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES), 0.0, 1.0)
    model = Ranking(x.mean(0), x.std(0) + 1e-6, np.zeros(2 * N_FEATURES), 0.0, 1.0)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    z = np.hstack((z, z * z))
    draw = np.random.default_rng(seed)
    w, m, v = model.weights, np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, STEPS + 1):
        apart = z[draw.choice(good, PAIRS)] - z[draw.choice(bad, PAIRS)]
        gradient = -(apart / (1 + np.exp(np.clip(apart @ w, -40, 40)))[:, None]).mean(0) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    s = z @ w
    model.cut = float(np.quantile(s, len(bad) / len(s)))
    # The slope that makes the logistic curve through (cut, THRESHOLD) likeliest.
    best = min(np.geomspace(0.05, 5, 60), key=lambda a: -np.log(np.clip(np.where(label == 1, p := Ranking(model.mean, model.scale, w, model.cut, a).probability(s), 1 - p), 1e-12, 1)).sum())
    model.slope = float(best)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Ranking:
    """Fit on about train_docs of the documents that have a label 0 or 1 (all, where there are fewer)."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    n, steps = marked.count(), 1 << 20
    chosen = marked.where(F.pmod(F.xxhash64("i", F.lit(3)), F.lit(steps)) < min(steps, -(-steps * train_docs // max(1, n))))
    # At most about train_docs rows of two numbers: bounded, so they go to every task.
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).tolist() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["i", "y", "x"])

    rows = whole_texts(texts.select(F.col("i").cast("string").alias("i"), "y", "t")).mapInArrow(run, "i string, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["i"] or "", r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), N_FEATURES), np.array([r["y"] for r in rows], int))


def predict(docs: DataFrame, model: Ranking, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` of docs with score and predicted."""
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("score", "double").add("predicted", "integer")
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                score = model.score(part.column(width).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*part.schema.names[:width], "score", "predicted"]
                )

    return whole_texts(docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("__text"))).mapInArrow(run, schema)

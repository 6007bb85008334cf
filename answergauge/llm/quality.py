"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents with label 1; the unlabelled set is
text as the web gives it, whose labels nobody looks at. With the class prior pi
(the share of label 1 among training labels) and the logistic loss l, training
minimises the non-negative unbiased risk
``pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])``; where the second part
would turn negative, its gradient is followed the other way, which keeps the
model from learning the unlabelled positives by heart. The logistic loss makes
``sigmoid(g)`` an estimate of P(label 1 | text).

Scores see the text only: rates of characters, words and lines.
"""

from __future__ import annotations

import operator
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.llm.base import fold, input_rows, keep_where, stored

FOLDS, HELD_OUT = 5, 0
POSITIVES, UNLABELLED = 20_000, 40_000  # bounds of the training sample
THRESHOLD = 0.3
PUNCTUATION = np.frombuffer(string.punctuation.encode(), np.uint8)


def text_features(text: str) -> np.ndarray:
    """A fixed number of rates; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw.strip():
        return np.zeros(len(PUNCTUATION) + 13, np.float32)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    n, size = len(words), len(raw)
    distinct = len(set(words))
    same = sum(map(operator.eq, words, words[1:]))
    upper, lower = chars[65:91].sum(), chars[97:123].sum()
    rates = [
        np.log1p(n), size / n / 10, distinct / n, same / n, len(set(lines)) / len(lines), len(lines) / n,
        upper / size, lower / size, chars[48:58].sum() / size, chars[128:].sum() / size, chars[9] / size,
        upper / (upper + lower + 1), raw.count(b". ") / n,
    ]
    return np.concatenate((rates, np.sqrt(chars[PUNCTUATION] / n))).astype(np.float32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(rows, pa.list_(pa.float32()))], ["id", "x"])

    return input_rows(docs, id_col, text_col).mapInArrow(run, "id long, x array<float>")


class Model:
    """One hidden layer on standardised features; small enough for a task's closure."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.mean[0])
        a, b, c, d = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-(np.tanh(z @ a + b) @ c + d)))


def train(positives: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 400,
          rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    """Full-batch Adam on the non-negative risk. Without positives or unlabelled text the score is the prior."""
    if not len(positives) or not len(unlabelled):
        return Model(np.array([prior]), np.array([1.0]), [])
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positives, unlabelled))
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        slopes = []
        hidden_p, hidden_u = np.tanh(p @ w[0] + w[1]), np.tanh(u @ w[0] + w[1])
        g_p, g_u = hidden_p @ w[2] + w[3], hidden_u @ w[2] + w[3]
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        sig_p, sig_u = 1 / (1 + np.exp(-g_p)), 1 / (1 + np.exp(-g_u))
        if negative >= 0:
            d_p, d_u = prior * ((sig_p - 1) - sig_p), sig_u
        else:
            d_p, d_u = prior * sig_p, -sig_u
        for x, h, d in ((p, hidden_p, d_p / len(p)), (u, hidden_u, d_u / len(u))):
            back = d[:, None] * w[2] * (1 - h * h)
            slopes.append([x.T @ back, back.sum(axis=0), h.T @ d, d.sum(keepdims=True)])
        for i, (s, t) in enumerate(zip(*slopes)):
            slope = s + t + (decay * w[i] if i % 2 == 0 else 0)
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope * slope
            w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def fit(x: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from the training fold's rows of ``x``; the samples are the rows with the lowest hashes of the id."""
    training = fold(F.col("id"), FOLDS) != HELD_OUT
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where(
        training & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    prior = marked.agg(F.avg(F.col("label").cast("double"))).first()[0]

    def sample(rows: DataFrame, n: int) -> np.ndarray:
        # a threshold on the hash first: tasks then send about n rows together, not n rows each
        share = min(1.0, 1.2 * n / max(1, rows.count()))
        low = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < int(1_000_000_000 * share))
        picked = low.orderBy(F.xxhash64("id"), "id").limit(n).select("x").toPandas()["x"]
        return np.stack(picked.to_numpy()).astype(float) if len(picked) else np.empty((0, 1))

    trusted = x.join(marked.where("label = 1"), "id")
    return train(sample(trusted, positives), sample(x.where(training), unlabelled), 0.5 if prior is None else prior)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= ``threshold``).

    Labels count only outside the held-out fold. A document with several labels
    is a positive if one of them is 1; null labels are ignored; no labels at all
    give every text the score 0.5. Null and empty texts get the score of a text
    without content. Repeated rows and null ids stay rows of their own (a null id
    counts as an empty text in the fold); an empty table gives an empty result.
    """
    x = stored(features(docs, id_col, text_col), "quality-features")
    model = fit(x, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(rows.astype(float)))], ["id", "score"])

    return x.mapInArrow(run, "id long, score double").select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` predicts as 1."""
    model = fit(stored(features(docs, id_col, text_col), "quality-features"), labels, id_col, label_col)

    def good(texts: list[str]) -> list[bool]:
        return (model.score(np.stack([text_features(t) for t in texts]).astype(float)) >= threshold).tolist() if texts else []

    return keep_where(docs, text_col, good)

"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

The statistics of features.py are brought near to normal (square root for shares, which are not negative), scaled to
the training rows' mean and deviation, and modelled as one normal density a class. A class's covariance is shrunk
towards its diagonal and towards a multiple of the identity; its Cholesky factor's inverse is computed once and shipped with
the scorer, which multiplies each block by it. (Both by loops over rows: LAPACK's threads can block beside a JVM.) The raw score is the difference of the Mahalanobis log-densities;
a logistic fit to it on the training rows, weighted to the labels' shares, gives the score.

Labelled rows beyond MAX_PER_CLASS a class do not train (the least hashes of doc_id are taken); everything else covers
all rows. Defined results: a null text is empty; of several labels of one doc_id, 1 wins; without both classes in
training all scores are the share of label 1 (0.0 without labels); an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features
from .common import bucket_of, ship, table, text_of, training_ids

MAX_PER_CLASS = 6000
TO_DIAGONAL, TO_IDENTITY = 0.1, 0.02
CUT = 0.7
_SHARES = [features.NAMES.index(k) for k in features.NAMES if k not in ("log_words", "mean_word", "log_line", "distinct_words")]


def transformed(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[:, _SHARES] = np.sqrt(np.maximum(x[:, _SHARES], 0))
    x[:, features.NAMES.index("mean_word")] = np.log1p(x[:, features.NAMES.index("mean_word")])
    return x


def cholesky(c: np.ndarray) -> np.ndarray:
    """The lower factor of a positive definite matrix."""
    low = np.zeros_like(c)
    for j in range(len(c)):
        low[j, j] = np.sqrt(c[j, j] - (low[j, :j] ** 2).sum())
        low[j + 1 :, j] = (c[j + 1 :, j] - (low[j + 1 :, :j] * low[j, :j]).sum(1)) / low[j, j]
    return low


def inverse(low: np.ndarray) -> np.ndarray:
    """Of a lower triangular matrix."""
    inv = np.zeros_like(low)
    for i in range(len(low)):
        inv[i, :i] = -(low[i, :i, None] * inv[:i, :i]).sum(0) / low[i, i]
        inv[i, i] = 1 / low[i, i]
    return inv


class Discriminant:
    """Two normal densities and a logistic calibration of their log ratio."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Discriminant:
        x = transformed(x)
        self.mean, self.dev = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = (x - self.mean) / self.dev
        self.parts = []
        for v in (0, 1):
            own = z[y == v]
            own = own - own.mean(0)
            c = np.einsum("ij,ik->jk", own, own) / len(own) if len(own) > 1 else np.eye(x.shape[1])
            c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c))
            c = (1 - TO_IDENTITY) * c + TO_IDENTITY * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
            low = cholesky(c)
            self.parts.append((z[y == v].mean(0), inverse(low), float(np.log(np.diag(low)).sum())))
        r = self.ratio(x)
        a, b, y = 1.0, 0.0, y.astype(float)
        target = np.where(y == 1, 1 - 1e-3, 1e-3)
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
            w, g = weight * np.maximum(p * (1 - p), 1e-9), weight * (target - p)
            rr, r1, one, gr, g1 = (w * r * r).sum() + 1e-2, (w * r).sum(), w.sum() + 1e-2, (g * r).sum(), g.sum()
            det = rr * one - r1 * r1
            a, b = a + np.clip((gr * one - g1 * r1) / det, -1, 1), b + np.clip((g1 * rr - gr * r1) / det, -2, 2)
        self.a, self.b = float(a), float(b)
        return self

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, as a signed root so that far tails do not rule the calibration."""
        z = (x - self.mean) / self.dev
        log = [-0.5 * (np.einsum("ij,kj->ik", z - m, inv) ** 2).sum(1) - half for m, inv, half in self.parts]
        d = log[1] - log[0]
        return np.sign(d) * np.sqrt(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.ratio(transformed(x)) + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame):
    """A function from Arrow texts to scores."""
    ids, total = training_ids(labels, "quality", 2, 4, MAX_PER_CLASS)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 * MAX_PER_CLASS ids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(features.stats(b.column(2))), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sorted(((r[0], r[1], tuple(r[2])) for r in rows.select("doc_id", "label", "text").mapInArrow(measure, "doc_id long, label int, x array<double>").collect()))
    y = np.array([r[1] for r in got])
    if len(set(y.tolist())) < 2:
        flat = float(y.mean()) if len(y) else 0.0
        return lambda texts: np.full(len(texts), flat)
    weight = np.where(y == 1, total[0, 1] / y.sum(), total[0, 0] / (1 - y).sum())
    model = Discriminant().fit(np.array([r[2] for r in got]), y, weight / weight.mean())
    return lambda texts: model.score(features.stats(texts))


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; no shuffle of texts."""
    score = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (bucket_of(docs["doc_id"], 4) == 2).alias("held_out"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted 1 stay. The model learns from the source table, where both classes still are."""
    ship(spark)
    score = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(score(text))

    return docs.filter(scored(text_of(docs)) >= CUT)  # only texts go to Python, only scores come back

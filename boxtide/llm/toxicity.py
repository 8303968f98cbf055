"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon is learnt, not given: words and word beginnings (of STEMS bytes, lower-cased, in runs of letters) that
occur in far more toxic than other training texts, weighted by the log of that ratio. Features are the lexicon's
density, its heaviest hit, hits near a second-person word, and the rates of capitals, punctuation, repetition and
obfuscation (features.py). One half of the training rows teaches the lexicon, the other the trees, so that neither
sees its own fit; the calibration is fitted to out-of-fold scores of that second half.

Labelled rows beyond MAX_PER_CLASS in each half and class do not train (the least hashes of doc_id are taken);
everything else covers all rows. Defined results: a null text is empty and is scored like one; a doc_id without a
label is scored only; of several labels of one doc_id, 1 wins; without both classes in training, all scores are the
share of label 1 (0.0 without labels); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features
from . import textkernel as tk
from .common import bucket_of, table, text_of, training_ids

MAX_PER_CLASS = 3000
LEXICON = 1500
STEMS = (5, 7, 9)
#: Second-person words of the corpus's languages.
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 120, 3, 0.1, 32, 20
#: Share of an average row that keeps calibrated scores off 0 and 1.
SMOOTH = 0.02


def _spell(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(w) for w in raw])
    return np.sort(tk.hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(w) for w in raw], end))


def _units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of each word, and (words' places, hashes) of the whole words and of each kind of beginning."""
    start, end, row = tk.words(data, off, tk.NO_LETTER)
    kinds = [(np.arange(len(start)), tk.hashes(data, start, end, lower=True))]
    for n in STEMS:
        at = np.flatnonzero(end - start >= n)
        kinds.append((at, tk.hashes(data, start[at], start[at] + n, lower=True) + np.uint64(n)))
    return row, kinds


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> (unit, texts labelled 1 with it, texts labelled 0 with it), summed over each block."""
    for batch in rows:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, off in tk.blocks(batch.column(0)):
            row, kinds = _units(data, off)
            got = [tk.distinct(row[at], h, b - a)[:2] for at, h in kinds]
            r, h = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            unit, back = np.unique(h, return_inverse=True)
            one = np.bincount(back, weights=label[a:b][r], minlength=len(unit)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(one), pa.array(np.bincount(back, minlength=len(unit)) - one)], names=["unit", "p", "n"])


def make_features(texts: pa.Array, lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """features.NAMES, then: summed weight a word, heaviest hit, hits a word, hits within five words of a second-person word a word, second-person words a word."""
    you = _spell(YOU)
    out = [np.zeros((0, len(features.NAMES) + 5))]
    inside = lambda keys, h: np.searchsorted(keys, h).clip(max=max(len(keys) - 1, 0))
    for a, b, data, off in tk.blocks(texts):
        n = b - a
        row, kinds = _units(data, off)
        w = np.zeros(len(row))
        for at, h in kinds:
            if len(lexicon):
                k = inside(lexicon, h)
                w[at] = np.maximum(w[at], np.where(lexicon[k] == h, weight[k], 0))
        k = inside(you, kinds[0][1])
        is_you = you[k] == kinds[0][1]
        near = np.cumsum(np.append(0, is_you))
        at = np.arange(len(row))
        close = (near[np.minimum(at + 6, len(row))] - near[np.maximum(at - 5, 0)] > 0) & (w > 0)
        per = np.maximum(np.bincount(row, minlength=n), 1)
        heaviest = np.zeros(n)
        np.maximum.at(heaviest, row, w)
        count = lambda x: np.bincount(row, weights=x, minlength=n) / per
        out.append(np.column_stack([features.block_stats(data, off), count(w), heaviest, count(w > 0), count(close), count(is_you)]))
    return np.concatenate(out)


class Trees:
    """Boosted regression trees on the logistic loss, split on quantile bins."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        p = y.mean().clip(1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(code, y - q, q * (1 - q))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, code: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A full tree of DEPTH levels: feature and bin of each inner node, value of each leaf; and the rows' leaves."""
        inner = 2**DEPTH - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, BINS + 1), np.zeros(len(g), int)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                if len(rows) >= 2 * LEAST_ROWS:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for f in range(code.shape[1]):
                        c = code[rows, f]
                        n, sg, sh = (np.cumsum(np.bincount(c, weights=w, minlength=BINS + 1))[:-1] for w in (None, g[rows], h[rows]))
                        gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                        gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = -1
                        if (i := int(gain.argmax())) is not None and gain[i] > best:
                            best, feature[k], cut[k] = gain[i], f, i
                node[rows] = 2 * k + 1 + (code[rows, feature[k]] > cut[k])
        leaf = node - inner
        value = RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
        return (feature, cut, value), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        score, at = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (code[at, feature[node]] > cut[node])
            score += value[node - (2**DEPTH - 1)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted least-squares increasing fit, by pooling adjacent violators; between knots scores are interpolated.

    Rows of one score are one point, whatever their order. Each block has a knot at either end, so scores inside it get
    its level; the ends of the scale are kept off 0 and 1 by SMOOTH of the nearest row's weight, which keeps the order.
    """
    at, back = np.unique(score, return_inverse=True)
    total, ones = np.bincount(back, weights=weight), np.bincount(back, weights=weight * y)
    stack: list[list[float]] = []  # first score, last score, weight of label 1, weight
    for s, v, w in zip(at.tolist(), ones.tolist(), total.tolist(), strict=True):
        stack.append([s, s, v, w])
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            top = stack.pop()
            stack[-1] = [stack[-1][0], top[1], stack[-1][2] + top[2], stack[-1][3] + top[3]]
    knots, level = [], []
    for first, last, v, w in stack:
        for s in {first: 0, last: 0}:
            knots.append(s)
            level.append(v / w)
    low, high = SMOOTH / (stack[0][3] + 2 * SMOOTH), 1 - SMOOTH / (stack[-1][3] + 2 * SMOOTH)
    return np.array(knots), np.clip(level, min(low, high), max(low, high))


def fit(docs: DataFrame, labels: DataFrame):
    """A function from Arrow texts to scores."""
    ids, total = training_ids(labels, "toxic", 0, 5, MAX_PER_CLASS, halves=2)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 4 * MAX_PER_CLASS ids
    units = rows.filter("half = 0").select("text", "label").mapInArrow(_count, "unit long, p long, n long").groupBy("unit").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    share = {r["label"]: r["count"] for r in ids.filter("half = 0").groupBy("label").count().collect()}
    odds = F.log((F.col("p") + 0.5) / (share.get(1, 0) + 1)) - F.log((F.col("n") + 0.5) / (share.get(0, 0) + 1))
    best = units.filter("p >= 4").withColumn("w", odds).filter("w > 1.6").orderBy(F.desc(F.col("w") * F.sqrt("p")), "unit").limit(LEXICON).select("unit", "w").collect()
    best = sorted((int(np.int64(r[0]).view(np.uint64)), r[1]) for r in best)
    lexicon, heavy = np.array([b[0] for b in best], np.uint64), np.array([b[1] for b in best], float)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = make_features(b.column(2), lexicon, heavy)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = rows.filter("half = 1").select("doc_id", "label", "text").mapInArrow(measure, "doc_id long, label int, x array<double>").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    y = np.array([r[1] for r in got], float)
    if len(set(y.tolist())) < 2:
        flat = float(y.mean()) if len(y) else 0.0
        return lambda texts: np.full(len(texts), flat)
    x = np.array([r[2] for r in got])
    # where the limit cut a class, its rows stand for more
    weight = np.where(y == 1, total[1, 1] / max(y.sum(), 1), total[1, 0] / max((1 - y).sum(), 1))
    fold = np.arange(len(y)) % 3
    out = np.empty(len(y))
    for k in range(3):
        out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    knots, level = isotonic(out, y, weight)
    trees = Trees().fit(x, y)
    return lambda texts: np.interp(trees.margin(make_features(texts, lexicon, heavy)), knots, level)


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; no shuffle of texts."""
    score = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (bucket_of(docs["doc_id"], 5) == 0).alias("held_out"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

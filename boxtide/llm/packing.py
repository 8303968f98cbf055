"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and a rest; rests (and full pieces) are items, classed by length in
units of UNIT tokens, rounded up. The histogram of classes, at most LENGTH / UNIT numbers however large the corpus,
goes to the driver. There the linear program "fewest sequences that hold all items" is solved over patterns: a revised
simplex on the patterns so far, and a knapsack by dynamic programming that prices the next one. Patterns are used as
often as the solution's floor says, what remains is filled largest first. Items of each class are ranked (within
hashed sub-buckets whose counts are added up, so that no class is ranked in one task) and a rank's place in the
patterns gives its sequence. Offsets are running sums in each sequence.

Defined results: a null or empty text is one piece with the end id alone; a null doc_id is packed like others;
repeated rows are packed each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import ship, table, text_of, written

LENGTH, UNIT, END = 4096, 16, 2
PLACES = 64
#: A priced pattern worth no more than 1 + GAP ends the search: the program is then within that share of its optimum.
ROUNDS, GAP = 4000, 1e-3


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows doc_id, start, length, ids_crc32, doc_tokens and class; whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                out: list[list[int | None]] = [[], [], [], [], []]
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for s in range(0, len(ids), LENGTH):
                        piece = ids[s : s + LENGTH]
                        for c, v in zip(out, (doc_id, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").withColumn("class", F.ceil(F.col("length") / UNIT).cast("int"))


def _best_pattern(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the used room; value and weight by item."""
    by_weight, item = np.full(room + 1, -1.0), np.full(room + 1, -1)
    by_weight[weight], item[weight] = value, np.arange(len(weight))
    best, pick = np.zeros(room + 1), np.zeros(room + 1, int)
    for c in range(1, room + 1):
        gain = by_weight[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(weight)), room
    while c > 0:
        if pick[c]:
            out[item[pick[c]]] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[room]), out


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with partial pivoting, by NumPy's own loops: at most LENGTH / UNIT rows."""
    n = len(a)
    x = np.hstack([a.astype(float), np.eye(n)])
    for j in range(n):
        p = j + int(np.abs(x[j:, j]).argmax())
        x[[j, p]] = x[[p, j]]
        x[j] /= x[j, j]
        factor = x[:, j].copy()
        factor[j] = 0
        x -= np.multiply.outer(factor, x[j])
    return x[:, n:]


def solve(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: items}) and how often each is used; together they hold the demand exactly. Matrices are worked on
    without BLAS and LAPACK, whose thread pools can block in a process that drives a JVM; after ROUNDS rounds the best
    basis so far is used."""
    weight = np.array(sorted(w for w, n in demand.items() if n > 0))
    if not len(weight):
        return []
    need = np.array([demand[int(w)] for w in weight], float)
    basis = np.diag(np.maximum(room // weight, 1).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    amount = (inverse * need).sum(1)
    for k in range(ROUNDS):
        price = inverse.sum(0)
        worth, column = _best_pattern(np.maximum(price, 0), weight, room)
        if worth <= 1 + GAP:
            break
        step = (inverse * column).sum(1)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        basis[:, out] = column
        if k % 200 == 199:
            inverse = _inverse(basis)
            amount = np.maximum((inverse * need).sum(1), 0)
        else:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
    left, plan = need.astype(np.int64), []

    def use(pattern: np.ndarray, times: int) -> None:
        have = pattern > 0
        times = min(times, int((left[have] // pattern[have]).min())) if have.any() else 0
        if times > 0:
            left[have] -= pattern[have] * times
            plan.append(({int(w): int(n) for w, n in zip(weight[have], pattern[have], strict=True)}, times))

    for j in np.argsort(-amount):
        use(np.rint(basis[:, j]).astype(np.int64), int(amount[j] + 1e-6))
    while left.any():  # at most about as many sequences as classes
        free, pattern = room, np.zeros(len(weight), np.int64)
        for i in range(len(weight) - 1, -1, -1):
            pattern[i] = min(left[i], free // weight[i])
            free -= pattern[i] * weight[i]
        use(pattern, int((left[pattern > 0] // pattern[pattern > 0]).min()))
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: the first rank of each use of a pattern, its items a sequence, and its first sequence."""
    out: dict[int, list[list[int]]] = {}
    base = 0
    for pattern, times in plan:
        for w, n in pattern.items():
            ranks = out.setdefault(w, [[0], [], []])
            ranks[0].append(ranks[0][-1] + n * times)
            ranks[1].append(n)
            ranks[2].append(base)
        base += times
    return {w: tuple(np.array(x, np.int64) for x in (a[:-1], b, c)) for w, (a, b, c) in out.items()}


def assign(items: DataFrame) -> DataFrame:
    """items with sequence_id and offset."""
    salted = items.withColumn("place", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PLACES)).cast("int"))
    counts = salted.groupBy("class", "place").count().collect()  # at most LENGTH / UNIT * PLACES rows
    demand: dict[int, int] = {}
    before: dict[int, np.ndarray] = {}
    for c, p, n in counts:
        demand[c] = demand.get(c, 0) + n
        before.setdefault(c, np.zeros(PLACES + 1, np.int64))[p + 1] = n
    before = {c: np.cumsum(v) for c, v in before.items()}
    slots = _slots(solve(demand, LENGTH // UNIT))

    @F.pandas_udf("long")
    def sequence(cls, place, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        out = np.zeros(len(cls), np.int64)
        c, p, r = cls.to_numpy(), place.to_numpy(), rank.to_numpy() - 1
        for k in np.unique(c).tolist():
            at = np.flatnonzero(c == k)
            first, n, base = slots[k]
            rank_ = before[k][p[at]] + r[at]
            use = np.searchsorted(first, rank_, "right") - 1
            out[at] = base[use] + (rank_ - first[use]) // n[use]
        return pd.Series(out)

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("class", "place").orderBy("doc_id", "start", "ids_crc32")))
    placed = ranked.withColumn("sequence_id", sequence("class", "place", "rank"))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0).cast("long")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def apply(docs: DataFrame, tokenizer: str) -> DataFrame:
    return assign(written(pieces(docs, tokenizer)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return apply(docs, vocabulary())

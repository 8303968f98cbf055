"""Document fingerprints by one-permutation MinHash.

Each distinct five-word shingle of the lower-cased text is hashed once; the hash's high bits name one of BINS bins and
each bin keeps its least hash. An empty bin takes the value of a full one found by probing hash(bin, attempt) until it
hits (optimal densification). BITS low-order bits of each bin's value are packed and written as hexadecimal digits.
Likeness of two fingerprints is the share m of equal bins, corrected for the 2**-BITS chance of an accidental match:
(m - c) / (1 - c), cut to 0..1.

Defined results: a null text is empty; a text without words has the empty fingerprint, which is 1.0 like itself and
0.0 like any other; rows of equal doc_id are ordered by text; a null doc_id comes first; of one document, it is its
own next. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table, text_of

BINS, BITS = 512, 4
_U = np.uint64


def _bins(lo: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Densified bin values; lo is (rows, BINS), filled marks what is set. Rows without any full bin stay as they are."""
    n = filled.sum(1)
    for r in np.flatnonzero(n == 1):
        lo[r] = lo[r, np.argmax(filled[r])]
    r, b = np.nonzero(~filled & (n > 1)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        probe = (tk.mix(b.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(attempt)) % _U(BINS)).astype(np.int64)
        hit = filled[r, probe]
        lo[r[hit], b[hit]] = lo[r[hit], probe[hit]]
        r, b = r[~hit], b[~hit]
    return lo


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: BINS values of BITS bits, and whether it has words."""
    out, some = np.zeros((len(texts), BINS), np.uint8), np.zeros(len(texts), bool)
    shift = _U(64 - BINS.bit_length() + 1)
    for a, b, row, h, off in tk.shingle_sets(texts):
        bin_ = (h >> shift).astype(np.int64)
        first = np.ones(len(h), bool)  # hashes ascend within a row, so the first of a bin is its least
        first[1:] = (bin_[1:] != bin_[:-1]) | (row[1:] != row[:-1])
        lo, filled = np.zeros((b - a, BINS), np.uint8), np.zeros((b - a, BINS), bool)
        lo[row[first], bin_[first]] = (h[first] & _U((1 << BITS) - 1)).astype(np.uint8)
        filled[row[first], bin_[first]] = True
        out[a:b] = _bins(lo, filled)
        some[a:b] = np.diff(off) > 0
    return out, some


def packed(values: np.ndarray, some: np.ndarray) -> list[str]:
    """Hexadecimal digits, one per bin."""
    raw = (values[:, 0::2] << 4) | values[:, 1::2]
    return [bytes(x).hex() if s else "" for x, s in zip(raw, some.tolist(), strict=True)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Corrected estimates of the Jaccard similarity of the shingle sets, row by row."""
    chance = 2.0**-BITS
    near = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, near, (some_a == some_b).astype(float))


def _edit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (bucket, tail, key, text): edits each document but the tails with the row that follows it."""
    pending: tuple | None = None
    own, edited, nxt = [], [], []

    def flush() -> pa.RecordBatch:
        texts = [x[1] for x in own]
        f, some = fingerprints(pa.array(texts, pa.large_string()))
        g, some_g = fingerprints(pa.array(edited, pa.large_string()))
        n, some_n = fingerprints(pa.array(nxt, pa.large_string()))
        out = pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in own], pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
            pa.array(packed(f, some), pa.string()), pa.array(packed(g, some_g), pa.string()), pa.array(likeness(f, some, g, some_g)), pa.array(likeness(f, some, n, some_n)),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        own.clear(), edited.clear(), nxt.clear()
        return out

    size = 0
    for batch in rows:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            for bucket, tail, doc_id, text in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                if pending and pending[0] == bucket and not pending[1]:
                    n = len(pending[3]) // 4
                    own.append(pending[2:])
                    edited.append(pending[3][: len(pending[3]) - n] + text[:n])
                    nxt.append(text)
                    size += len(text)
                pending = (bucket, tail, doc_id, text)
            if size > 1 << 21:
                yield flush()
                size = 0
    if own:
        yield flush()


def apply(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The fingerprints of each document and of its edited text. Texts are shuffled once, by ranges of doc_id; the first
    document of each range also goes to the end of the range before it (the first of all to the end of the last)."""
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(2**63)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(least)).alias("key"), text_of(docs).alias("text"))
    asked = [k / buckets for k in range(1, buckets)]
    low, inner = rows.agg(F.min("key"), F.percentile_approx("key", asked, 10 * buckets)).first()
    bounds = np.unique(np.array([low, *inner] if low is not None else [least], np.int64))
    n = len(bounds)

    @F.pandas_udf("array<struct<bucket:int,tail:boolean>>")
    def places(key):  # noqa: ANN001, ANN202
        import pandas as pd

        at = np.searchsorted(bounds, key.to_numpy(), "right") - 1
        first = bounds[np.maximum(at, 0)] == key.to_numpy()
        return pd.Series([[{"bucket": int(a), "tail": False}, *([{"bucket": int((a - 1) % n), "tail": True}] if f else [])] for a, f in zip(at, first, strict=True)])

    dealt = rows.withColumn("place", F.explode(places("key"))).select(F.col("place.bucket").alias("bucket"), F.col("place.tail").alias("tail"), "doc_id", "text", F.coalesce("doc_id", F.lit(least)).alias("key"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "key", "text").select("bucket", "tail", "doc_id", "text")
    return dealt.mapInArrow(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))

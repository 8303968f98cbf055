"""Centroid clustering: plain Lloyd in whole numbers.

A kept vector has exactly DIMS components, none null or non-finite; each component x becomes floor(1024 * x). The first
centroids are the K kept vectors of least sha256("3:" and the vec_id), in that order. A round broadcasts the centroids
(K x DIMS numbers), each partition finds its rows' nearest (squared differences in whole numbers, argmin takes the
lowest index of equal ones) and gives back one row a centroid and component with the partition's sum; a groupBy merges
them, and every non-empty centroid becomes the floor of its mean. Nothing else leaves a partition: a round shuffles
K x DIMS rows a task, whatever the number of vectors or the share of one cluster.

Whole numbers: within 2**27 in magnitude (vectors within 2**17) everything fits into 64 bits. Beyond, Python's integers
take over for the block; sums travel as two decimals, of the parts above and below 2**64, so they stay exact for any
32-bit float. A squared distance or inertia that a long can't hold is null, the cluster is right all the same.

Defined results: vectors of other lengths, null vectors, and those with null or non-finite components have no row; a
64-bit component of 2**128 or more counts as non-finite; a null vec_id is hashed as "3:"; rows that repeat a vec_id are
vectors of their own (the vector breaks ties of the hash); with fewer kept vectors than K there are as many centroids as
vectors; an empty table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

K, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
SMALL = 1 << 27
LONG = (1 << 63) - 1


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id and the scaled components x (whole numbers as doubles) of the vectors that count."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: F.coalesce(F.abs(c) < float(2**128), F.lit(False)))
    of = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") == DIMS) & good)
    return of.select("vec_id", F.transform("embedding", lambda c: _floor(c.cast("double") * SCALE)).alias("x"))


def _floor(c: F.Column) -> F.Column:
    """floor() that stays a double: doubles of 2**52 and more are whole already."""
    return F.when(F.abs(c) < float(2**52), F.floor(c).cast("double")).otherwise(c)


def _whole(rows: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers, as int64 where squares of differences fit, else as Python's integers."""
    return rows.astype(np.int64) if not rows.size or np.abs(rows).max() < SMALL else np.array([[int(v) for v in r] for r in rows.tolist()], dtype=object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (the lowest of equal ones) and the squared distance to it."""
    wide = x.dtype == object or max(abs(v) for c in centroids for v in c) >= SMALL
    x = x.astype(object) if wide else x
    far = np.empty((len(centroids), len(x)), dtype=x.dtype)
    for k, c in enumerate(centroids):
        d = x - np.array(c, dtype=x.dtype)
        far[k] = (d * d).sum(1)
    at = far.argmin(0)
    return at, far[at, np.arange(len(x))]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for f in frames:
        if len(f):
            yield f, _whole(np.stack(f["x"].to_numpy()))


def _round(x: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """The next centroids and the members of each."""
    sent = x.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        n, total = [0] * len(c), [[0] * DIMS for _ in c]
        for _, rows in _blocks(frames):
            at, _ = nearest(rows, c)
            for k in np.unique(at).tolist():
                own = rows[at == k]
                n[k] += len(own)
                total[k] = [a + int(b) for a, b in zip(total[k], own.sum(0).tolist(), strict=True)]
        for k in range(len(c)):
            if n[k]:
                yield pd.DataFrame({"cluster": k, "place": range(DIMS), "n": n[k], "high": [Decimal(v >> 64) for v in total[k]], "low": [Decimal(v & (2**64 - 1)) for v in total[k]]})

    merged = x.select("x").mapInPandas(sums, "cluster int, place int, n long, high decimal(38,0), low decimal(38,0)").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    out, members = [list(c) for c in centroids], [0] * len(centroids)
    for r in merged:  # K x DIMS rows
        out[r["cluster"]][r["place"]] = ((int(r["high"]) << 64) + int(r["low"])) // r["n"]
        members[r["cluster"]] = r["n"]
    sent.unpersist()
    return out, members


def first_centroids(x: DataFrame, k: int = K) -> list[list[int]]:
    salted = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[int(v) for v in r["x"]] for r in x.orderBy(salted, "x").limit(k).select("x").collect()]


def lloyd(x: DataFrame, k: int = K, rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after the rounds over kept() rows; a round that moves none is the last, as all later ones would be like it."""
    c = first_centroids(x, k)
    for _ in range(rounds if c else 0):
        before, (c, _) = c, _round(x, c)
        if c == before:
            break
    return c


def apply(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row per kept vector."""
    spark = vectors.sparkSession
    x = written(kept(vectors))
    centroids = lloyd(x, k, rounds)
    sent = spark.sparkContext.broadcast(centroids)

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, rows in _blocks(frames):
            at, far = nearest(rows, sent.value)
            fits = pd.array([int(v) if int(v) <= LONG else None for v in far.tolist()] if far.dtype == object else far, dtype="Int64")
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "cluster": at.astype(np.int32), "distance": fits})

    out = written(x.mapInPandas(assigned, "vec_id long, cluster int, distance long"))
    inertia = out.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()  # at most k rows
    of = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in inertia}
    total = None if None in of.values() else sum(of.values())
    fits = lambda v: v if v is not None and v <= LONG else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(j, fits(v), fits(total), sha[j]) for j, v in sorted(of.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """DuckDB, over `embeddings`: a CTE for each round's assignment and centroids."""
    far = "list_sum([({a}[j] - {c}[j]) * ({a}[j] - {c}[j]) for j in range(1, 65)])"
    parts = [
        """cc_x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row_id, [floor(1024 * v::DOUBLE)::BIGINT for v in embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        "cc_c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS k, x AS c FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM cc_x ORDER BY h, x LIMIT 8))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"cc_a{i} AS MATERIALIZED (SELECT row_id, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS m FROM (SELECT row_id, vec_id, x, k, {far.format(a='x', c='c')}::BIGINT AS d FROM cc_x, cc_c{i}) GROUP BY row_id)")
        if i < ROUNDS:
            parts.append(f"""cc_m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS c FROM (
  SELECT m.k AS k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM cc_a{i}, range(1, 65) t(j) GROUP BY m.k, j) GROUP BY k)""")
            parts.append(f"cc_c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM cc_c{i} o LEFT JOIN cc_m{i} m USING (k))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, m.k AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM cc_a{ROUNDS} a JOIN cc_c{ROUNDS} c ON c.k = a.m.k
"""


SQL = _sql()

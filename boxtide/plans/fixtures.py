"""Detections and ground truth derived from the star-schema tables by whole-number arithmetic, as SQL that Spark and other engines read alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from boxtide.shipping import ship

DET = """SELECT l_orderkey AS stem,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS det_index,
  CAST(l_partkey % 3 AS INT) AS cls, CAST((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 101 AS INT) AS conf,
  CAST(l_partkey * 7 % 24 AS INT) AS x1, CAST(l_suppkey * 11 % 24 AS INT) AS y1,
  CAST(l_partkey * 7 % 24 + 24 + l_partkey % 16 AS INT) AS x2, CAST(l_suppkey * 11 % 24 + 24 + l_linenumber * 2 AS INT) AS y2
FROM lineitem"""
GT = """SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY det_index) - 1 AS INT) AS gt_index,
  CASE WHEN conf % 5 = 0 THEN (cls + 1) % 3 ELSE cls END AS cls,
  x1 + det_index % 5 AS x1, y1 + det_index % 4 AS y1, x2 + det_index % 5 AS x2, y2 + det_index % 4 AS y2
FROM det WHERE conf % 3 <> 0"""
IGN = "SELECT stem, x1 - 4 AS x1, y1 - 4 AS y1, x2 + 4 AS x2, y2 + 4 AS y2 FROM det WHERE conf % 17 = 0"
#: CTEs for an oracle.
WITH = f"WITH RECURSIVE det AS ({DET}), gt AS ({GT}), ign AS ({IGN})"

_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
IOU = f"(({_INTER})::DOUBLE / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER})::DOUBLE)"
IOA = f"(({_INTER})::DOUBLE / ((a.x2 - a.x1) * (a.y2 - a.y1))::DOUBLE)"


def greedy_sql(name: str, least: float, det: str = "det", by_class: bool = False, ties: str = "ASC") -> str:
    """CTEs that end in <name>(stem, gi, di, v)."""
    return f""",
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY v DESC, gi {ties}, di {ties}) AS rn FROM (
  SELECT a.stem, b.gt_index AS gi, a.det_index AS di, {IOU} AS v FROM {det} a JOIN gt b ON a.stem = b.stem{" AND a.cls = b.cls" if by_class else ""}) WHERE v >= {least}),
{name}_w AS (SELECT DISTINCT stem, 0::BIGINT AS rn, []::INT[] AS ug, []::INT[] AS ud, NULL::INT AS gi, NULL::INT AS di, NULL::DOUBLE AS v FROM {name}_o
  UNION ALL SELECT o.stem, o.rn, CASE WHEN free THEN list_append(ug, ogi) ELSE ug END, CASE WHEN free THEN list_append(ud, odi) ELSE ud END, CASE WHEN free THEN ogi END, CASE WHEN free THEN odi END, ov
  FROM (SELECT p.stem, p.rn, w.ug, w.ud, p.gi AS ogi, p.di AS odi, p.v AS ov, NOT list_contains(w.ug, p.gi) AND NOT list_contains(w.ud, p.di) AS free FROM {name}_w w JOIN {name}_o p ON p.stem = w.stem AND p.rn = w.rn + 1) o),
{name} AS (SELECT stem, gi, di, v FROM {name}_w WHERE gi IS NOT NULL)"""


def confident_sql(name: str, least: float) -> str:
    """CTEs that end in <name>(stem, di, gi, v): per class, by confidence."""
    return f""",
{name}_c AS (SELECT a.stem, a.cls, a.det_index AS di, a.conf, a.x1, a.y1, a.x2, a.y2, list({{'gi': b.gt_index, 'v': {IOU}}} ORDER BY {IOU} DESC, b.gt_index) AS c
  FROM det a JOIN gt b ON a.stem = b.stem AND a.cls = b.cls WHERE {IOU} >= {least} GROUP BY ALL),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY stem, cls ORDER BY conf DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC, di) AS rn FROM {name}_c),
{name}_w AS (SELECT DISTINCT stem, cls, 0::BIGINT AS rn, []::INT[] AS used, NULL::INT AS di, NULL::INT AS gi, NULL::DOUBLE AS v FROM {name}_o
  UNION ALL SELECT stem, cls, rn, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.gi) END, di, p.gi, p.v
  FROM (SELECT o.stem, o.cls, o.rn, w.used, o.di, list_filter(o.c, lambda x: NOT list_contains(w.used, x.gi))[1] AS p FROM {name}_w w JOIN {name}_o o ON o.stem = w.stem AND o.cls = w.cls AND o.rn = w.rn + 1)),
{name} AS (SELECT stem, di, gi, v FROM {name}_w WHERE gi IS NOT NULL)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """dealt: rows are shuffled under the name the table has for the image, so that what groups them by stem needs no second shuffle."""
    lines = load(spark, sf_dir, "lineitem")
    return spark.sql(DET.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines.repartition("l_orderkey") if dealt else lines)


def jagged(box: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (box's place, y, x1, x2) of a mask for each box: by turns they begin 0 to 2 pixels later, and each fourth ends 6 earlier."""
    n = np.maximum(box["y2"] - box["y1"], 0)
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, box["y1"][of] + k, box["x1"][of] + k % 3, box["x2"][of] - np.where(k % 4 == 1, 6, 0)


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GT.replace("FROM det", "FROM {det}"), det=det(spark, sf_dir))


def ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IGN.replace("FROM det", "FROM {det}"), det=det(spark, sf_dir))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is an image of 64 x 96, whether it has lines or not."""
    from pyspark.sql import functions as F

    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stem"), F.lit(64).alias("width"), F.lit(96).alias("height"))

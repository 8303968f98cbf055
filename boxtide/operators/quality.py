"""Set operations, diffs and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_all(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    rows = None
    for name, t in tables.items():
        one = t.select(key).distinct().withColumn("_t", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(tables)).select(key)


def stem_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Key and side ('only_a', 'only_b', 'both')."""
    x, y = a.select(key, F.lit(1).alias("_a")).distinct(), b.select(key, F.lit(1).alias("_b")).distinct()
    return x.join(y, key, "full").select(key, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both").alias("side"))


def additive(base: DataFrame, overlay: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines of the baseline that the overlay lost, and lines it adds; by membership, not by multiplicity. Only stems of both count."""
    both = base.select("stem").distinct().join(overlay.select("stem").distinct(), "stem")
    a, b = base.join(both, "stem", "left_semi"), overlay.join(both, "stem", "left_semi")
    return a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")


def contaminated(items: DataFrame, reserved: DataFrame, keys: list[str]) -> DataFrame:
    """D3: the first of the keys (by priority) under which an item is also reserved; items that are under none stay out."""
    out = items
    for k in keys:
        hit = reserved.select(F.col(k)).filter(F.col(k).isNotNull()).distinct().withColumn(f"_{k}", F.lit(k))
        out = out.join(hit, k, "left")
    return out.withColumn("found_by", F.coalesce(*[F.col(f"_{k}") for k in keys])).filter("found_by IS NOT NULL").drop(*[f"_{k}" for k in keys])


def integrity(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Named row checks: rows looked at and rows that fail; a null test fails."""
    out = None
    for name, df, ok in checks:
        one = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias("failed")).select(F.lit(name).alias("check"), "n", "failed")
        out = one if out is None else out.unionByName(one)
    return out


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose row counts differ: key, n_left, n_right."""
    a, b = left.groupBy(key).agg(F.count("*").alias("n_left")), right.groupBy(key).agg(F.count("*").alias("n_right"))
    j = a.join(b, key, "full").fillna(0, ["n_left", "n_right"])
    return j.filter("n_left <> n_right")


def same_multiset(a: DataFrame, b: DataFrame, group: str, value: str) -> DataFrame:
    """Groups whose values differ as multisets, compared by counts: one signed count of both sides, so equal ones cancel in one table. Nulls equal nothing, as in a join."""
    one = lambda df, sign: df.select(F.col(group), F.col(value), F.when(F.col(group).isNull() | F.col(value).isNull(), sign).otherwise(0).alias("_side"), F.lit(sign).alias("_n"))
    left = one(a, 1).unionAll(one(b, -1)).groupBy(group, value, "_side").agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return left.groupBy(group).agg(F.sum(F.abs("_n")).alias("differences"))


def replay(logged: DataFrame, emitted: DataFrame, thresholds: list[float], eps: float = 1e-4) -> DataFrame:
    """A row for each image of the log (stem, cls, conf; a null class for an image without detections): whether it has labels, whether the classes that
    pass the thresholds are those emitted (stem, cls; a null class for an empty file), and whether rounding at the cut explains it if not:
    the counts differ and a confidence lies within eps of its threshold."""
    cut = F.element_at(F.array(*map(F.lit, map(float, thresholds))), F.col("cls") + 1)
    per = logged.groupBy("stem", "cls").agg(F.sum((F.col("conf") >= cut).cast("int")).alias("n"), F.max((F.abs(F.col("conf") - cut) <= eps).cast("int")).alias("near"))
    out = emitted.groupBy(F.col("stem").alias("o_stem"), F.col("cls").alias("o_cls")).agg(F.count("cls").alias("m"))
    both = per.join(out, (F.col("stem") == F.col("o_stem")) & F.col("cls").eqNullSafe(F.col("o_cls")), "full")
    both = both.select(F.coalesce("stem", "o_stem").alias("stem"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "m", "near")], F.col("stem").isNotNull().alias("in_log"), F.col("o_stem").isNotNull().alias("in_out"))
    s = both.groupBy("stem").agg(F.max("in_log").alias("in_log"), F.max("in_out").alias("labels"), F.max((F.col("n") != F.col("m")).cast("int")).alias("differs"), F.sum(F.col("n") - F.col("m")).alias("more"), F.max("near").alias("near"))
    wrong = F.col("labels") & (F.col("differs") == 1)
    return s.filter("in_log").select("stem", "labels", wrong.alias("mismatch"), (wrong & (F.col("more") != 0) & (F.col("near") == 1)).alias("at_the_cut"))


def dedupe(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """S14 (first wins) and S15 (last wins), as an aggregate: no window sort of hot keys."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_p")).select(*keys, "_p.*")


def pending(wanted: DataFrame, done: DataFrame, in_flight: DataFrame, keys: list[str]) -> DataFrame:
    """What is neither done nor in flight."""
    return wanted.join(done.select(*keys).unionByName(in_flight.select(*keys)), keys, "left_anti")


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of `over` replace all rows of their key; keys only in `over` are left out."""
    swapped = over.join(base.select(key).distinct(), key, "left_semi")
    return base.join(over.select(key).distinct(), key, "left_anti").unionByName(swapped)


def paired_rows(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of equal keys paired by their rank among equals; `rank` counts from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = a.withColumn("rank", F.row_number().over(w)).select(*keys, "rank", F.col(order).alias("a_row"))
    y = b.withColumn("rank", F.row_number().over(w)).select(*keys, "rank", F.col(order).alias("b_row"))
    return x.join(y, [*keys, "rank"], "full")


def spend_limit(df: DataFrame, group: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """ST7: rows of each group while their running cost is within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)

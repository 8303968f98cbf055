"""Counts, cross-tabs, distributions and modal labels."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def long_form(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field, value: one scan for any number of fields; missing and empty values are 'unknown'."""
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in fields])
    return df.select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", "p.value")


def detect_fields(long: DataFrame, most: int = 25, free_text: tuple[str, ...] = ()) -> DataFrame:
    """Fields with at most `most` distinct values that are not free text, with their number."""
    return long.filter(~F.col("field").isin(list(free_text)) if free_text else F.lit(True)).groupBy("field").agg(F.countDistinct("value").alias("n_values")).filter(F.col("n_values") <= most)


def distribution(long: DataFrame) -> DataFrame:
    """Rows, share of the field and rank (ties by value) of each value."""
    c = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field")
    return c.withColumns({"share": F.col("n") / F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "value"))})


def cross_tab(df: DataFrame, fields: list[str], zero_cells: bool = False) -> DataFrame:
    """Counts of value pairs for every two fields: field_a, value_a, field_b, value_b, n. The pairs are made within a row.
    zero_cells: also the pairs of occurring values that never meet (at most the product of the fields' values)."""
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown"))
    cells = F.array(*[F.struct(F.lit(a).alias("field_a"), value(a).alias("value_a"), F.lit(b).alias("field_b"), value(b).alias("value_b")) for a, b in combinations(sorted(fields), 2)])
    got = df.select(F.explode(cells).alias("c")).groupBy("c.field_a", "c.value_a", "c.field_b", "c.value_b").agg(F.count("*").alias("n"))
    if not zero_cells:
        return got
    a, b = got.select("field_a", "field_b", "value_a").distinct(), got.select("field_a", "field_b", "value_b").distinct()
    return a.join(b, ["field_a", "field_b"]).join(got, ["field_a", "field_b", "value_a", "value_b"], "left").fillna(0, ["n"]).select("field_a", "value_a", "field_b", "value_b", "n")


def sparsest(cells: DataFrame, top: int) -> DataFrame:
    """O1: the cells with the fewest rows, ties by name."""
    return cells.orderBy("n", *[c for c in cells.columns if c != "n"]).limit(top)


def itemsets(df: DataFrame, fields: list[str], sizes: tuple[int, ...], least: int) -> DataFrame:
    """Sets of field=value items of the given sizes in at least `least` rows, as sorted text; made within a row from a fixed number of fields."""
    item = {c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(fields)}
    sets = [F.when(F.array_size(F.filter(F.array(*[item[c] for c in combo]), lambda x: x.isNull())) == 0, F.concat_ws(" & ", *[item[c] for c in combo])) for k in sizes for combo in combinations(sorted(fields), k)]
    return df.select(F.explode(F.array(*sets)).alias("items")).filter("items IS NOT NULL").groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def slice_counts(df: DataFrame, slices: dict[str, Column], floor: int) -> DataFrame:
    """Rows in each named slice (a failing or null test is false), and whether they reach the floor."""
    one = df.agg(*[F.sum(F.when(F.coalesce(t, F.lit(False)), 1).otherwise(0)).alias(n) for n, t in slices.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("slice"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("n")) for n in slices])
    out = one.select(F.explode(rows).alias("r")).select("r.slice", "r.n")
    return out.withColumn("verdict", F.when(F.col("n") >= floor, "ok").when(F.col("n") > 0, "thin").otherwise("missing"))


def modal_label(df: DataFrame, group: str, fields: list[str], share: float = 0.4, top: int = 3) -> DataFrame:
    """Per group the most frequent known values that reach the share, as a label; ties by field and value."""
    long = long_form(df, group, fields).withColumnRenamed("id", "grp")
    n = long.groupBy("grp", "field").agg(F.count("*").alias("n"))
    c = long.filter("value NOT IN ('unknown', 'none')").groupBy("grp", "field", "value").agg(F.count("*").alias("k"))
    best = c.withColumn("r", F.row_number().over(Window.partitionBy("grp", "field").orderBy(F.desc("k"), "value"))).filter("r = 1").join(n, ["grp", "field"]).withColumn("s", F.col("k") / F.col("n")).filter(F.col("s") >= share)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("s"), "field"))).filter(F.col("place") <= top)
    label = best.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), ", ").alias("label"))
    return df.select(F.col(group).alias("grp")).distinct().join(label, "grp", "left").select("grp", F.coalesce("label", F.lit("mixed")).alias("label"))


def anatomy(df: DataFrame, group: list[str], measures: list[str], flags: dict[str, Column]) -> DataFrame:
    """One scan with means and extremes of measures and counts of flags per group."""
    aggs = [f(c).alias(f"{c}_{n}") for c in measures for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(*group).agg(F.count("*").alias("n"), *aggs, *[F.sum(F.when(t, 1).otherwise(0)).alias(n) for n, t in flags.items()])

"""Rates, intervals and order-dependent statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtide.scratch import stored

Z = 1.96


def rate(k: Column, n: Column) -> Column:
    """k / n, 0 where n is 0."""
    return F.when(n > 0, k.cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Rate, low and high of Wilson's interval; all 0 where n is 0."""
    p, m = rate(k, n), F.greatest(n, F.lit(1)).cast("double")
    d = 1 + z * z / m
    mid, half = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    inside = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return p, inside(F.greatest(F.lit(0.0), mid - half)), inside(F.least(F.lit(1.0), mid + half))


def entropy(counts: DataFrame, group: list[str], n: str, buckets: int | None = None) -> DataFrame:
    """Entropy of counts over log(buckets), buckets fixed or those observed; 0 for one bucket or no rows."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    p = F.col(n) / F.sum(n).over(w)
    per = counts.withColumn("_p", p).groupBy(*group).agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log("_p")).otherwise(0.0)).alias("h"), F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).alias("seen"))
    of = F.lit(buckets) if buckets else F.col("seen")
    return per.select(*group, F.when(of > 1, F.col("h") / F.log(of.cast("double"))).otherwise(F.lit(0.0)).alias("entropy"))


#: Buckets of one level of a selection, and how many rows a bucket may hold for its values to be ordered in one task.
BUCKETS, FEW = 1024, 100_000


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """The place of a value among BUCKETS equal parts of [lo, hi]; it never falls as the value grows."""
    x, a, b = (c.cast("double") for c in (v, lo, hi))
    return F.when(b > a, F.least(F.floor((x - a) / (b - a) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int")


def gini(values: DataFrame, group: list[str], v: str) -> DataFrame:
    """Gini coefficient of values, zeros included; 0 where all are 0. Ties share their values' ranks' sum, so equal values need no order.
    Ranks run within buckets of the values' range, after the counts of the buckets before them."""
    per = values.groupBy(*group, v).agg(F.count("*").alias("m"))
    ends = per.groupBy(*group).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    per = _joined(per, ends, group).withColumn("b", _bucket(F.col(v), F.col("lo"), F.col("hi")))
    earlier = lambda *keys: Window.partitionBy(*group, *keys).rowsBetween(Window.unboundedPreceding, -1)
    before = per.groupBy(*group, "b").agg(F.sum("m").alias("k")).select(*group, "b", F.coalesce(F.sum("k").over(earlier().orderBy("b")), F.lit(0)).alias("k0"))
    per = _joined(per, before, [*group, "b"])
    inside = F.coalesce(F.sum("m").over(earlier("b").orderBy(v)), F.lit(0)) + F.col("k0")
    ranks = F.col("m") * inside + F.col("m") * (F.col("m") + 1) / 2
    s = per.withColumn("_ranks", ranks).groupBy(*group).agg(F.sum(F.col("_ranks") * F.col(v)).alias("a"), F.sum(F.col("m") * F.col(v)).alias("t"), F.sum("m").alias("n"))
    return s.select(*group, F.when(F.col("t") > 0, 2 * F.col("a") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).otherwise(F.lit(0.0)).alias("gini"))


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the facts of their keys; a null key meets a null."""
    if not keys:
        return rows.join(F.broadcast(facts), F.lit(True))
    named = facts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, test).drop(*[f"_k{i}" for i in range(len(keys))])


#: Conventions for the 0-based place of percentile p in n sorted values.
PLACES = {
    "floor_n": lambda n, p: F.least(n - 1, F.floor(n * p / 100)),
    "round_n1": lambda n, p: F.bround(F.lit(p / 100) * (n - 1)),
    "floor_n1": lambda n, p: F.floor(F.lit(p / 100) * (n - 1)),
    "floor_n_less1": lambda n, p: F.greatest(F.lit(0), F.floor(F.lit(p / 100) * n) - 1),
    "upper_middle": lambda n, _: F.floor(n / 2),
}


def percentiles(values: DataFrame, group: list[str], v: str, places: dict[str, tuple[float, str]]) -> DataFrame:
    """Group, name and value: for each named (p, convention) the value at its place among a group's sorted values.

    A selection in levels: the places' ranks are known from the counts; each level counts rows in BUCKETS equal parts of the range that still
    holds a place, and keeps the part that does. Rows of large groups are counted map-side and never ordered; only a last part of
    few rows (or of one value) is. A level reads the values once, for all groups and places."""
    rows = values.filter(F.col(v).isNotNull()).select(*group, F.col(v).alias("v"))
    ends = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), PLACES[convention](F.col("n"), p).cast("long").alias("at")) for name, (p, convention) in places.items()])
    todo = ends.withColumn("p", F.explode(wanted)).select(*group, "p.name", "p.at", "n", "lo", "hi")
    while True:
        todo = stored(todo)  # a row a group and place
        if todo.filter((F.col("n") > FEW) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        inside = _joined(rows, todo, group).filter(F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("b", _bucket(F.col("v"), F.col("lo"), F.col("hi")))
        per = inside.groupBy(*group, "name", "b").agg(F.first("at").alias("at"), F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("k").over(Window.partitionBy(*group, "name").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        per = per.withColumn("before", upto - F.col("k"))
        todo = per.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("k"))).select(*group, "name", (F.col("at") - F.col("before")).alias("at"), F.col("k").alias("n"), "lo", "hi")
    last = _joined(rows, todo, group).filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*group, "name", "v").agg(F.first("at").alias("at"), F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*group, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto)
    return last.filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("m") <= F.col("at"))).select(*group, "name", F.col("v").alias("value"))


def percentile(values: DataFrame, group: list[str], v: str, p: float, convention: str) -> DataFrame:
    """The value at a convention's place: group, value."""
    return percentiles(values, group, v, {"": (p, convention)}).drop("name")

"""Seeded samples (O2-O5, D4, A41). A row's place comes from a hash of its key and the seed, so a sample does not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_key(key: Column, seed: int) -> Column:
    """A seeded order by md5, which other engines can repeat."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed).cast("string")).cast("binary"))


def take(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """O2: n rows in a seeded order; the plan keeps n rows a partition."""
    return df.orderBy(order_key(F.col(key), seed), key).limit(n)


def per_stratum(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """O3: at most n rows of each stratum."""
    w = Window.partitionBy(*strata).orderBy(order_key(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def stratified_fill(df: DataFrame, stratum: str, key: str, least: int, total: int, seed: int) -> DataFrame:
    """Up to `least` of each stratum, then the rest, strata with most rows first, to `total` rows."""
    s = Window.partitionBy(stratum)
    r = df.withColumns({"_r": F.row_number().over(s.orderBy(order_key(F.col(key), seed), key)), "_n": F.count("*").over(s)})
    return r.orderBy((F.col("_r") > least).cast("int"), F.when(F.col("_r") > least, -F.col("_n")).otherwise(0), stratum, "_r").limit(total).drop("_r", "_n")


def reserve(df: DataFrame, held_out: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A seeded reserve that shares no key with what is already held out."""
    return take(df.join(held_out.select(key).distinct(), key, "left_anti"), key, n, seed)


def most_confident(df: DataFrame, group: list[str], score: str, columns: list[str]) -> DataFrame:
    """Per group the row of the greatest score; ties by the other columns."""
    return df.groupBy(*group).agg(F.max_by(F.struct(*columns), F.struct(score, *columns)).alias("p")).select(*group, "p.*")


def _poisson(c: Column) -> tuple[Column, Column]:
    """The range of counts outside which a Poisson weight of mean c is below 1e-15 of the whole."""
    return F.greatest(F.lit(0), F.floor(c - 9 * F.sqrt(c))).cast("long"), F.ceil(c + 9 * F.sqrt(c) + 12).cast("long")


def bootstrap(df: DataFrame, value: str, rounds: int, seed: int, other: str | None = None) -> DataFrame:
    """Mean and 95 % interval (and of the paired difference) by a Poisson bootstrap. One row out.

    Rows of equal outcome (a, b) draw alike, so a round draws one number for each distinct outcome, of the Poisson distribution of its
    count: rounds x outcomes draws in all, however many rows there are. Outcome i of round r takes the count at which the distribution
    reaches u, from the first eight digits of md5("seed:r:i"). The counts' weights are products along a running sum, so no factorial is formed."""
    a, b = F.col(value).cast("double"), F.col(other).cast("double") if other else F.lit(0.0)
    of = df.select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("c"))
    of = of.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("a", "b")))  # a row a distinct outcome
    lo, hi = _poisson(F.col("c"))
    w = Window.partitionBy("i").orderBy("k")
    table = of.select("i", "c", lo.alias("lo"), F.explode(F.sequence(lo, hi)).alias("k"))
    table = table.withColumn("l", F.sum(F.when(F.col("k") > F.col("lo"), F.log(F.col("c") / F.col("k"))).otherwise(0.0)).over(w))
    table = table.withColumn("e", F.exp(F.col("l") - F.max("l").over(Window.partitionBy("i"))))
    table = table.select("i", "k", "lo", (F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("e").over(Window.partitionBy("i"))).alias("u"), F.lit(None).cast("long").alias("r"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("i").cast("string")).cast("binary")), 1, 8)
    drawn = of.select("i", lo.alias("lo"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long"))).alias("r")).select("i", F.lit(None).cast("long").alias("k"), "lo", ((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)).alias("u"), "r")
    merged = Window.partitionBy("i").orderBy("u", F.col("k").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    drawn = table.unionByName(drawn).withColumn("w", F.coalesce(F.last("k", ignorenulls=True).over(merged) + 1, F.col("lo"))).filter("r IS NOT NULL")
    drawn_rows = F.nullif(F.sum("w"), F.lit(0))  # a round may draw none of very few rows
    per = drawn.join(of.select("i", "a", "b"), "i").groupBy("r").agg((F.sum(F.col("w") * F.col("a")) / drawn_rows).alias("m"), (F.sum(F.col("w") * (F.col("a") - F.col("b"))) / drawn_rows).alias("d"))
    q = lambda col, x: F.percentile(col, F.lit(x))
    ci = per.agg(q("m", 0.025).alias("low"), q("m", 0.975).alias("high"), q("d", 0.025).alias("diff_low"), q("d", 0.975).alias("diff_high"))
    n = F.sum("c")
    return ci.join(F.broadcast(of.agg((F.sum(F.col("c") * F.col("a")) / n).alias("mean"), (F.sum(F.col("c") * (F.col("a") - F.col("b"))) / n).alias("diff_mean"))), F.lit(True))

"""Sinks (K1, K4-K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_line(cls: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """K1: 'cls cx cy w h' with six decimals, of a normalised box."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls.cast("int"), (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)


def label_files(lines: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """A row per stem with its lines in order as one text; stems of the listing without lines are empty files. An image's lines are few."""
    per = lines.groupBy("stem").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("det_index", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return per if listing is None else listing.select("stem").distinct().join(per, "stem", "left").fillna("", ["text"])


def write_label_files(files: DataFrame, folder: str) -> None:
    """One file a stem, written by the tasks through Hadoop's file systems as partitions of a text table (stem=<stem>/)."""
    files.select("stem", F.col("text").alias("value")).repartition("stem").write.mode("overwrite").partitionBy("stem").text(folder)


def write_lines(rows: DataFrame, folder: str, file: str, order: list[str]) -> None:
    """A folder `<file>=<value>` for each value of that column, with the column `value` as lines in order; readers take the value as the file's stem if it is called stem."""
    rows.repartition(file).sortWithinPartitions(file, *order).select("value", file).write.mode("overwrite").partitionBy(file).text(folder)


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K4: replaced when the job commits; readers never see a half."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K5."""
    df.write.mode("overwrite").option("header", True).csv(path)


def by_tag(rows: DataFrame, tags: DataFrame, path: str) -> None:
    """K6: a folder per tag with the rows of its images; an image is in each of its tags."""
    rows.join(tags.distinct(), "stem").write.mode("overwrite").partitionBy("tag").parquet(path)


def crowd_lines(persons: DataFrame, ignores: DataFrame) -> DataFrame:
    """K7: a JSON line per image of persons (stem, i, v, f) and ignore boxes (stem, i, x1..y2), in order."""
    xywh = lambda b: F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])
    extra = lambda n: F.struct(F.lit(n).alias("ignore"))
    p = persons.select("stem", "i", F.struct(F.lit("person").alias("tag"), xywh(F.col("v")).alias("vbox"), xywh(F.col("f")).alias("fbox"), extra(0).alias("extra")).alias("b"))
    box = F.struct("x1", "y1", "x2", "y2")
    g = ignores.withColumn("q", box).select("stem", "i", F.struct(F.lit("mask").alias("tag"), xywh(F.col("q")).alias("vbox"), xywh(F.col("q")).alias("fbox"), extra(1).alias("extra")).alias("b"))
    per = p.unionByName(g).groupBy("stem").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.to_json("b").alias("j")))), lambda r: r["j"]).alias("j"))
    head = F.regexp_replace(F.to_json(F.struct(F.col("stem").alias("ID"))), r"\}$", "")
    return per.select(F.concat(head, F.lit(',"gtboxes":['), F.array_join("j", ","), F.lit("]}")).alias("value"))

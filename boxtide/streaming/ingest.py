"""Keyed, resumable ingestion and its ledgers (ST5-ST7, S22, K3, J13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtide.operators.quality import dedupe


def append_new(new: DataFrame, path: str, keys: list[str]) -> None:
    """K3: appends rows whose keys the Parquet folder lacks, one a key; running it again adds nothing. One writer at a time:
    the folder has no lock, so two runs at once could both append a key. Where several write, stream_into() is the way."""
    spark = new.sparkSession
    one = new.dropDuplicates(keys)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        one = one.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    one.write.mode("append").parquet(path)


def verdict_stream(spark: SparkSession, folder: str, schema: str, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """ST5: JSON lines as they arrive, each key once within the delay of event time; without one, of the time of arrival.
    Rows later than the watermark are dropped, and with them the keys' state, so the state never grows without bound."""
    s = spark.readStream.schema(schema).json(folder)
    if event_time:
        return s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return s.withColumn("_at", F.current_timestamp()).withWatermark("_at", delay).dropDuplicatesWithinWatermark(keys).drop("_at")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything there is now, then stop: resumable from the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_into(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now into a Parquet table, each row exactly once over all runs of the checkpoint: the table's log of
    committed batches and the checkpoint agree, whenever a run is broken off. Read it with spark.read.parquet(path)."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger(reserved: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers joined to what was reserved for them: the reservation's columns, the answer, and a state."""
    a = dedupe(answers, keys, [F.lit(0)], "first").withColumn("_a", F.lit(True))
    j = reserved.join(a, keys, "left")
    return j.withColumn("state", F.when(F.col("_a"), "done").otherwise("in_flight")).drop("_a")


def progress(wanted: DataFrame, done: DataFrame, in_flight: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """ST6: per group how much is wanted, done, in flight and pending."""
    d = done.select(*keys).distinct().withColumn("d", F.lit(1))
    i = in_flight.select(*keys).distinct().withColumn("i", F.lit(1))
    j = wanted.join(d, keys, "left").join(i, keys, "left")
    return j.groupBy(*group).agg(
        F.count("*").alias("wanted"), F.count("d").alias("done"), F.sum(F.when(F.col("d").isNull() & F.col("i").isNotNull(), 1).otherwise(0)).alias("in_flight"), F.sum(F.when(F.col("d").isNull() & F.col("i").isNull(), 1).otherwise(0)).alias("pending")
    )


def training_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of CSV logs as files appear."""
    return spark.readStream.schema(schema).option("header", True).csv(folder)

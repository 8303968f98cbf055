"""What the text operators share: tables, null rules, materialised cuts of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the runs of anything but these six bytes.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once per context, and bound Arrow batches by bytes."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_BYTES):  # a batch of long texts is bounded by bytes, not by rows alone
        spark.conf.set(BATCH_BYTES, "16m")
    if getattr(sc, "_boxtide_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="boxtide-"), "boxtide_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
    sc._boxtide_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(set_by_cluster)
        return set_by_cluster
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="boxtide-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept in the shared folder, safe when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as compressed Parquet: for rows that carry texts or long arrays."""
    path = f"{shared_dir(df.sparkSession)}/boxtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._boxtide_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of a written() table; only once everything that reads it is itself written."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._boxtide_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_of(df: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def training_ids(labels: DataFrame, column: str, held: int, folds: int, limit: int, halves: int = 1) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """At most `limit` labelled doc_ids of each half and class outside the held-out fold (doc_id, label, half), and how many there are by (half, label)."""
    one = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    one = one.filter((bucket_of(F.col("doc_id"), folds) != held) & F.col("label").isin(0, 1)).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(halves)).cast("int"))
    total = {(k, v): 0 for k in range(halves) for v in (0, 1)} | {(r["half"], r["label"]): r["count"] for r in one.groupBy("half", "label").count().collect()}
    out = None
    for k, v in total:
        part = one.filter((F.col("label") == v) & (F.col("half") == k)).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit)
        out = part if out is None else out.unionAll(part)
    return out, total

"""A folder that driver and executors share, for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; where that is unset and the master is local, in a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = getattr(spark.sparkContext, "_boxtide_scratch", None) or tempfile.mkdtemp(prefix="boxtide-")
        spark.sparkContext._boxtide_scratch = top
    return f"{top}/boxtide-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read back: worked out once, and safe when executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

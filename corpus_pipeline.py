"""The corpus pipeline: each stage's Parquet is the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from boxtide.llm import line_dedup, near_dedup, packing, quality_model, quality_rules
from boxtide.llm.common import shared_dir, ship, table


def _stage(operator):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator.stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_rules", _stage(quality_rules)),
    ("quality_model", _stage(quality_model)),
    ("line_dedup", _stage(line_dedup)),
    ("near_dedup", _stage(near_dedup)),
    ("packing", _stage(packing)),
]

#: Prefix sums of suffix ranks, trees of tokens and linear programs are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's Parquet goes once the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs

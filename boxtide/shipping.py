"""Sends the package to the executors, for functions that run in Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once per context: the package's Python files as a zip that Spark copies to every executor. Arrow batches are bounded by bytes."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_BYTES):  # a batch of crowded images is bounded by bytes, not by rows alone
        spark.conf.set(BATCH_BYTES, "16m")
    if getattr(sc, "_boxtide_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="boxtide-"), "boxtide_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
    sc._boxtide_shipped = True

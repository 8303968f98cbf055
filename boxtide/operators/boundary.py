"""Pluggable per-row models (U1-U3): batches in, columns out; no model is shipped, only a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Engine = Callable[[pd.DataFrame], pd.DataFrame]


def apply_engine(df: DataFrame, make: Callable[[], Engine], schema: str) -> DataFrame:
    """`make` builds an engine once a task; it gets Arrow batches and returns rows of the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for b in batches:
            yield engine(b)

    return df.mapInPandas(run, schema)


def mock_engine() -> Engine:
    """Answers from a checksum of the key, the same on every run."""
    import zlib

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = [zlib.crc32(str(k).encode()) for k in pdf["key"]]
        return pd.DataFrame({"key": pdf["key"], "gender": [("woman", "man", "unknown")[x % 3] for x in c], "age": [(x >> 8) % 90 for x in c]})

    return run


def _grey(raw: np.ndarray, width: int, height: int) -> np.ndarray:
    return raw[: width * height].reshape(height, width).astype(float)


def blurriness(grey: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian."""
    if min(grey.shape) < 3:
        return 0.0
    lap = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
    return float(lap.var())


def tone_angle(lightness: float, b: float) -> float:
    """The individual typology angle in degrees."""
    return float(np.degrees(np.arctan2(lightness - 50.0, b)))


def image_measures(df: DataFrame) -> DataFrame:
    """Key, width, height, pixels (grey bytes, decoded before) -> brightness and blurriness."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            g = [_grey(np.frombuffer(x, np.uint8), int(w), int(h)) for x, w, h in zip(p["pixels"], p["width"], p["height"], strict=True)]
            yield pd.DataFrame({"key": p["key"], "brightness": [float(x.mean()) if x.size else 0.0 for x in g], "blurriness": [blurriness(x) for x in g]})

    return df.select("key", "width", "height", "pixels").mapInPandas(run, "key string, brightness double, blurriness double")


#: Parts of the table of distinct rows; a fixed number, so that the seeded start does not depend on how the input is laid out.
PARTS = 16


def one_hot_clusters(df: DataFrame, key: str, fields: list[str], k: int, seed: int = 7) -> DataFrame:
    """One-hot fields, k-means: key, cluster. Equal rows are one weighted row of the fit, so that it holds as many as there are distinct ones."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    idx = StringIndexer(inputCols=fields, outputCols=[f"{f}_i" for f in fields], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=idx.getOutputCols(), outputCols=[f"{f}_h" for f in fields], dropLast=False)
    rows = df.groupBy(*fields).agg(F.count("*").cast("double").alias("n")).repartition(PARTS, *fields).sortWithinPartitions(*fields)
    model = Pipeline(stages=[idx, hot, VectorAssembler(inputCols=hot.getOutputCols(), outputCol="v"), KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster", weightCol="n")]).fit(rows)
    return model.transform(df).select(key, F.col("cluster"))


def reduce_dims(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Principal components of array columns."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(key, array_to_vector(F.col(vector)).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(v).transform(v).select(key, vector_to_array("p").alias("components"))

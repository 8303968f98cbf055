"""Runs an oracle in DuckDB and compares results without regard to order."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, list | np.ndarray | tuple):
            return tuple(one(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, bool | np.bool_):
            return bool(v)
        if isinstance(v, int | float | np.integer | np.floating):
            return round(float(v), 7)
        return str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None)), key=str)

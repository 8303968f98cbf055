"""Exact areas of unions of rectangles: slabs between neighbouring x edges, merged y intervals in each.

Spark brings the boxes of an image (or group) together in one row, with one shuffle at most; NumPy works a batch of such rows out at once,
AT_ONCE pairs of a slab and a box at a time, so a crowded image needs no more memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOX = ["x1", "y1", "x2", "y2"]
AT_ONCE = 1 << 20


def _areas(owner: np.ndarray, box: list[np.ndarray], n: int, at_once: int) -> np.ndarray:
    """The area of the union of each owner's boxes; owners are 0 to n - 1."""
    out, some = np.zeros(n, box[0].dtype), (box[2] > box[0]) & (box[3] > box[1])
    owner, (x1, y1, x2, y2) = owner[some], [c[some] for c in box]
    if not len(owner):
        return out
    of, x = np.concatenate([owner, owner]), np.concatenate([x1, x2])
    order = np.lexsort((x, of))
    of, x = of[order], x[order]
    new = np.append(True, (of[1:] != of[:-1]) | (x[1:] != x[:-1]))
    edge = np.empty(len(order), np.int64)
    edge[order] = np.cumsum(new) - 1
    of, x, first, last = of[new], x[new], edge[: len(owner)], edge[len(owner) :]  # a box lies over the slabs first .. last - 1
    tops, top = np.unique(y2, return_inverse=True)
    cost = np.append(0, np.cumsum(np.cumsum(np.bincount(first, minlength=len(x)) - np.bincount(last, minlength=len(x)))))
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(cost, cost[a] + at_once, "right")) - 1)
        here = np.flatnonzero((first < b) & (last > a))
        low = np.maximum(first[here], a)
        times = np.minimum(last[here], b) - low
        k = np.repeat(here, times)
        slab = np.repeat(low, times) + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
        order = np.lexsort((y1[k], slab))
        k, slab = k[order], slab[order]
        reach = np.maximum.accumulate((slab - a) * len(tops) + top[k])
        bottom = y1[k].copy()
        same = np.flatnonzero(slab[1:] == slab[:-1]) + 1
        bottom[same] = np.maximum(bottom[same], tops[reach[same - 1] % len(tops)])
        fresh = np.maximum(y2[k] - bottom, 0)
        np.add.at(out, of[slab], (x[np.minimum(slab + 1, len(x) - 1)] - x[slab]) * fresh)
        a = b
    return out


def _kind(*boxes: DataFrame) -> str:
    return "long" if all(t in ("tinyint", "smallint", "int", "bigint") for b in boxes for c, t in b.dtypes if c in BOX) else "double"


def _rows(df: DataFrame, key: list[str], kind: str, **more) -> DataFrame:
    return df.dropna(subset=BOX).select(*key, F.struct(*[v.alias(k) for k, v in more.items()], *[F.col(c).cast(kind).alias(c) for c in BOX]).alias("b"))


def _listed(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.collect_list("b").alias("b"))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """The entries of a column of lists, the row and the box of each."""
    each = lists.flatten()
    return each, np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), [each.field(c).to_numpy() for c in BOX]


def _schema(df: DataFrame, key: list[str], more: str) -> StructType:
    return StructType([df.schema[k] for k in key] + StructType.fromDDL(more).fields)


def clipped(boxes: DataFrame, windows: DataFrame, key: list[str], window_id: str) -> DataFrame:
    """Boxes of the same key cut to each window; columns key, window_id, x1..y2."""
    b = boxes.select(*[F.col(k).alias(f"b_{k}") for k in key], *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    touch = (F.col("x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("x2")) & (F.col("y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("y2"))
    same = [F.col(k) == F.col(f"b_{k}") for k in key]
    j = windows.select(*key, window_id, "x1", "y1", "x2", "y2").join(b, [*same, touch])
    cut = j.select(*key, window_id, F.greatest("x1", "b_x1").alias("x1"), F.greatest("y1", "b_y1").alias("y1"), F.least("x2", "b_x2").alias("x2"), F.least("y2", "b_y2").alias("y2"))
    return cut.filter("x1 < x2 AND y1 < y2")


def union_area(boxes: DataFrame, group: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """Area of the union of each group's boxes: group columns, area. Groups without boxes are absent."""
    kind, n = _kind(boxes), len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, owner, box = _flat(batch.column(n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(_areas(owner, box, batch.num_rows, at_once))], names=[*group, "area"])

    return _listed(_rows(boxes, group, kind), group).mapInArrow(run, _schema(boxes, group, f"area {kind}"))


def covered(windows: DataFrame, boxes: DataFrame, key: list[str], window_id: str, at_once: int = AT_ONCE) -> DataFrame:
    """The share of each window that the boxes of its key cover; a window without area counts as covered."""
    kind, n, w = _kind(windows, boxes), len(key), windows.withColumnRenamed(window_id, "w")
    own = w.select(*key, F.struct(F.lit(True).alias("own"), "w", *[F.col(c).cast(kind).alias(c) for c in BOX]).alias("b"))
    over = _rows(boxes.dropna(subset=key), key, kind, own=F.lit(False), w=F.lit(None).cast(windows.schema[window_id].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, row, box = _flat(batch.column(n))
            own = each.field("own").to_numpy(zero_copy_only=False)
            win, cut = np.flatnonzero(own), np.flatnonzero(~own)
            cut = cut[np.argsort(row[cut], kind="stable")]
            low = np.searchsorted(row[cut], row[win])
            many = np.searchsorted(row[cut], row[win], "right") - low
            area, cost, a = np.zeros(len(win), box[0].dtype), np.append(0, np.cumsum(many)), 0
            while a < len(win):  # some windows at a time, each with the boxes of its key
                b = max(a + 1, int(np.searchsorted(cost, cost[a] + at_once, "right")) - 1)
                at = np.repeat(np.arange(a, b), many[a:b])
                c, m = cut[low[at] + np.arange(len(at)) - (cost[at] - cost[a])], win[at]
                inside = [f(box[i][c], box[i][m]) for i, f in enumerate((np.maximum, np.maximum, np.minimum, np.minimum))]
                area[a:b] = _areas(at - a, inside, b - a, at_once)
                a = b
            full = (box[2][win] - box[0][win]) * (box[3][win] - box[1][win])
            share = np.where(full > 0, area / np.where(full > 0, full, 1), 1.0)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row[win])) for c in batch.columns[:n]], each.field("w").take(pa.array(win)), pa.array(share)], names=[*key, window_id, "covered"])

    return _listed(own.unionAll(over), key).mapInArrow(run, _schema(windows, [*key, window_id], "covered double"))


def common_area(a: DataFrame, b: DataFrame, group: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """Group columns, the areas of the union of a (area_a) and of b (area_b), and of the intersection of the two unions (area), as area(A) + area(B) -
    area(A and B together)."""
    kind, n = _kind(a, b), len(group)
    both = _rows(a, group, kind, own=F.lit(True)).unionAll(_rows(b, group, kind, own=F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, owner, box = _flat(batch.column(n))
            own = each.field("own").to_numpy(zero_copy_only=False)
            aa, ab = (_areas(owner[side], [c[side] for c in box], batch.num_rows, at_once) for side in (own, ~own))
            au = _areas(owner, box, batch.num_rows, at_once)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(x) for x in (aa + ab - au, aa, ab)]], names=[*group, "area", "area_a", "area_b"])

    return _listed(both, group).mapInArrow(run, _schema(a, group, f"area {kind}, area_a {kind}, area_b {kind}"))

"""Masks as runs: sorted, disjoint [start, end) stretches of an image's pixels counted row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS = "array<struct<start:bigint,end:bigint>>"


def runs_of_rows(rows: Column, width: Column) -> Column:
    """Runs from an array of (y, x1, x2) stretches in any order; touching and overlapping ones become one."""
    flat = F.array_sort(F.transform(F.filter(rows, lambda r: r["x2"] > r["x1"]), lambda r: F.struct((r["y"] * width + r["x1"]).cast("long").alias("start"), (r["y"] * width + r["x2"]).cast("long").alias("end"))))

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(last.isNotNull() & (r["start"] <= last["end"]), F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), grown)).otherwise(F.array_append(done, r))

    return F.aggregate(flat, F.array().cast(RUNS), step)


def size(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def common(a: Column, b: Column) -> Column:
    """Pixels of both masks: their ends merged in one order, counted where two runs are open."""
    ends = lambda m: F.flatten(F.transform(m, lambda r: F.array(F.struct(r["start"].alias("at"), F.lit(1).alias("turn")), F.struct(r["end"].alias("at"), F.lit(-1).alias("turn")))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("open"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, e: Column) -> Column:
        return F.struct(e["at"].alias("at"), (s["open"] + e["turn"]).alias("open"), (s["n"] + F.when(s["open"] == 2, e["at"] - s["at"]).otherwise(0)).alias("n"))

    return F.aggregate(F.array_sort(F.concat(ends(a), ends(b))), start, step, lambda s: s["n"])


def iou(a: Column, b: Column) -> Column:
    """Overlap of two masks, 0 where both are empty."""
    both = common(a, b)
    union = size(a) + size(b) - both
    return F.when(union > 0, both.cast("double") / union).otherwise(F.lit(0.0))


def extent(mask: Column, width: Column) -> Column:
    """The tight box (x1, y1, x2, y2), exclusive at its ends, null for an empty mask. Pairs whose boxes are apart share no pixel."""
    x, y = lambda p: p % width, lambda p: F.floor(p / width)
    whole = F.exists(mask, lambda r: y(r["start"]) != y(r["end"] - 1))  # a run over the end of a row spans the width
    left = F.when(whole, F.lit(0)).otherwise(F.array_min(F.transform(mask, lambda r: x(r["start"]))))
    right = F.when(whole, width).otherwise(F.array_max(F.transform(mask, lambda r: x(r["end"] - 1))) + 1)
    box = F.struct(left.cast("long").alias("x1"), F.array_min(F.transform(mask, lambda r: y(r["start"]))).cast("long").alias("y1"), right.cast("long").alias("x2"), (F.array_max(F.transform(mask, lambda r: y(r["end"] - 1))) + 1).cast("long").alias("y2"))
    return F.when(F.size(mask) > 0, box)


#: Runs of one side that are looked up at once, so that an image of any number of masks needs bounded memory.
AT_ONCE = 1 << 16
#: Masks whose images are judged together, few enough for their runs to stay in a core's cache.
MASKS = 2000


def _runs(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mask, start, end of disjoint runs in order, from stretches in any order; touching and overlapping ones become one."""
    some = end > start
    mask, start, end = mask[some], start[some], end[some]
    if not len(mask):
        return mask, start, end
    low, span = start.min(), end.max() - start.min() + 2
    key = mask * span + (start - low)
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        mask, start, end = mask[order], start[order], end[order]
    reach = np.maximum.accumulate(mask * span + (end - low))  # a mask's places all lie after those of the mask before
    new = np.append(True, mask[1:] * span + (start[1:] - low) > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(mask)) - 1
    return mask[new], start[new], reach[last] - mask[new] * span + low


def _pairs(owner: np.ndarray, runs: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """i, j of all pairs of masks of one owner that both have runs, at most at_once runs of i at a time or one pair."""
    n = len(owner)
    later = np.searchsorted(owner, owner, "right") - np.arange(n) - 1
    cost = np.append(0, np.cumsum(later * np.maximum(runs, 1)))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(cost, cost[a] + at_once, "right")) - 1)
        step = max(1, at_once // max(1, runs[a])) if b == a + 1 else n  # of one mask's pairs a part
        for lo in range(0, int(later[a:b].max()), step):
            m = np.minimum(later[a:b] - lo, step)
            i = np.repeat(np.arange(a, b), m)
            j = i + 1 + lo + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            some = (runs[i] > 0) & (runs[j] > 0)
            yield i[some], j[some]
        a = b


def _shared(owner: np.ndarray, mask: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, common pixels and IoU of the masks (numbered along owner, which ascends) of one owner that share a pixel."""
    mask, start, end = _runs(mask, start, end)
    if not len(mask):
        return
    n = len(owner)
    low, span = start.min(), end.max() - start.min() + 2
    at, length = mask * span + (start - low), end - start
    to = at + length
    size = np.bincount(mask, length, n).astype(np.int64)
    before = np.append(0, np.cumsum(length))
    lead = np.append(0, before[:-1] - at)
    first = np.searchsorted(mask, np.arange(n + 1))

    def pixels(x: np.ndarray) -> np.ndarray:
        """Those of all masks that lie before place x."""
        k = np.searchsorted(at, x, "right")
        return np.minimum(x + lead[k], before[k])

    for i, j in _pairs(owner, np.diff(first), at_once):
        shift = (j - i) * span
        a = np.searchsorted(to, at[first[j]] - shift, "right")  # i's runs between j's first and last pixel
        m = np.maximum(np.searchsorted(at, to[first[j + 1] - 1] - shift, "left") - a, 0)
        ends = np.cumsum(m)
        run = np.arange(m.sum()) + np.repeat(a - (ends - m), m)
        x = at[run] + np.repeat(shift, m)
        found = np.append(0, np.cumsum(pixels(x + length[run]) - pixels(x)))
        common = found[ends] - found[ends - m]
        hit = common > 0
        i, j, common = i[hit], j[hit], common[hit]
        yield i, j, common, common / (size[i] + size[j] - common)


def overlaps(masks: DataFrame, width: int, at_once: int = AT_ONCE, draw: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...]] | None = None) -> DataFrame:
    """stem, i, j, common, iou of the masks (stem, det_index, rows: (y, x1, x2) stretches in any order) of an image that share a pixel. A mask without a stem shares none.

    draw: masks have whole-number columns instead of rows, and their rows are made of these in the tasks, so that only the columns are shuffled: from a dict of columns to the
    place of each row's mask in them, y, x1 and x2. A mask with a null among them has no pixel.
    Masks come image by image, if need be over several batches; NumPy counts all pairs of a batch of images by looking up the ends of one mask's runs in the other's."""
    masks = masks.filter(F.col("stem").isNotNull())
    if draw:
        names = [c for c in masks.columns if c not in ("stem", "det_index")]
        masks = masks.dropna(subset=names).select("stem", "det_index", *[F.col(c).cast("long").alias(c) for c in names])
    else:
        some = F.filter("rows", lambda r: r["x2"] > r["x1"])
        places = lambda x: F.transform(some, lambda r: r["y"].cast("long") * width + r[x])
        masks = masks.select("stem", "det_index", places("x1").alias("start"), places("x2").alias("end"))
    placed = masks.withColumns({"det_index": F.col("det_index").cast("int"), "_n": F.count("*").over(Window.partitionBy("stem"))})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
        """Batches cut where an image ends, and the number of masks of each image."""
        held, have, need = [], 0, 1
        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            if have < need:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            n, at, cut, images = t.column("_n").to_numpy().tolist(), 0, 0, []
            while at < have and at + n[at] <= have:
                images.append(n[at])
                at += n[at]
                if at - cut >= MASKS:
                    yield t.slice(cut, at - cut), images
                    cut, images = at, []
            if images:
                yield t.slice(cut, at - cut), images
            need = n[at] if at < have else 1
            held, have = t.slice(at).to_batches(), have - at

    def rows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if draw:
            of, y, x1, x2 = draw({c: t.column(c).to_numpy() for c in names})
            return of, y * width + x1, y * width + x2
        start, end = (t.column(c).combine_chunks().fill_null([]) for c in ("start", "end"))
        return np.repeat(np.arange(len(start)), start.value_lengths().to_numpy()), *(x.flatten().fill_null(0).to_numpy() for x in (start, end))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, images in whole(batches):
            owner = np.repeat(np.arange(len(images)), images)
            t = t.take(np.lexsort((t.column("det_index").to_numpy(), owner)))
            stem, det = (t.column(c).combine_chunks() for c in ("stem", "det_index"))
            for i, j, common, iou in _shared(owner, *rows_of(t), at_once):
                yield pa.RecordBatch.from_arrays([stem.take(i), det.take(i), det.take(j), pa.array(common), pa.array(iou)], names=["stem", "i", "j", "common", "iou"])

    return placed.mapInArrow(count, f"stem {dict(masks.dtypes)['stem']}, i int, j int, common long, iou double")

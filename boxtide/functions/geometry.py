"""Box geometry as Column expressions (G1-G7, G11-G15). A box is four columns x1, y1, x2, y2; everything stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    """The columns <prefix>x1<suffix> and so on."""
    return tuple(F.col(f"{prefix}{k}{suffix}") for k in ("x1", "y1", "x2", "y2"))


def fields(s: Column) -> Box:
    """The fields of a struct column."""
    return s["x1"], s["y1"], s["x2"], s["y2"]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def overlaps(a: Box, b: Box) -> Column:
    """The cheap test that goes into a join condition before iou()."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def share(part: Column, whole: Column) -> Column:
    """Part over whole; 0 where either is empty."""
    return F.when((part > 0) & (whole > 0), part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where either is empty."""
    inter = intersection(a, b)
    return share(inter, area(a) + area(b) - inter)


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the first box's own area."""
    return share(intersection(a, b), area(a))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def pad(b: Box, share: float, width: Column, height: Column) -> Box:
    """Grown by a share of its size on every side, cut to whole pixels toward zero and to the image."""
    dx, dy = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    return F.greatest(F.lit(0), (b[0] - dx).cast("int")), F.greatest(F.lit(0), (b[1] - dy).cast("int")), F.least(width, (b[2] + dx).cast("int")), F.least(height, (b[3] + dy).cast("int"))


def dilate(b: Box, share: float) -> Box:
    """Moved out by a share of the square root of its area."""
    d = F.sqrt(F.greatest(area(b), F.lit(0)).cast("double")) * share
    return b[0] - d, b[1] - d, b[2] + d, b[3] + d


def rescale(b: Box, scale: Column | float, dx: Column | float, dy: Column | float) -> Box:
    return b[0] * scale + dx, b[1] * scale + dy, b[2] * scale + dx, b[3] * scale + dy


def letterbox(width: Column, height: Column, size: int) -> tuple[Column, Column, Column]:
    """Scale and the offsets of an image fitted into a square."""
    scale = F.lit(float(size)) / F.greatest(width, height)
    return scale, (size - width * scale) / 2, (size - height * scale) / 2


def input_height(h: Column, width: Column, height: Column, size: int) -> Column:
    """A box's height once its image is fitted into the model's input."""
    return h * float(size) / F.greatest(width, height)


def person_height(full: Column, visible: Column) -> Column:
    return F.greatest(full, visible)


def decode(v: Column, convention: Column, width: Column, height: Column) -> Column:
    """Four numbers in one of xyxy_px, yxyx_px, xyxy_1000, yxyx_1000 -> a box in pixels, ordered and cut to the image; null if a side is under a pixel."""
    swap, scaled = convention.startswith("yxyx"), convention.endswith("1000")
    at = lambda i, j, full: F.when(swap, v[j]).otherwise(v[i]) * F.when(scaled, full / 1000.0).otherwise(F.lit(1.0))
    xs, ys = (at(0, 1, width), at(2, 3, width)), (at(1, 0, height), at(3, 2, height))
    cut = lambda c, full: F.least(F.greatest(c, F.lit(0.0)), full.cast("double"))
    x1, x2, y1, y2 = cut(F.least(*xs), width), cut(F.greatest(*xs), width), cut(F.least(*ys), height), cut(F.greatest(*ys), height)
    return F.when((x2 - x1 >= 1) & (y2 - y1 >= 1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def axis_order(boxes: Column) -> Column:
    """Whether most of a record's four-number boxes are portrait when read y first: 'yxyx' (also on a tie) or 'xyxy'."""
    tall_y = F.size(F.filter(boxes, lambda v: (v[2] - v[0]) > (v[3] - v[1])))
    tall_x = F.size(F.filter(boxes, lambda v: (v[3] - v[1]) > (v[2] - v[0])))
    return F.when(tall_y >= tall_x, "yxyx").otherwise("xyxy")

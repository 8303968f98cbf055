"""Matching of boxes within an image.

All start with an equi-join on the image and keep the overlap test in the join condition, so the planner hashes on the
image and never pairs images. The sequential choice is an ordered fold over an image's candidate pairs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtide.functions import geometry as G

STEM = "stem"


def pairs(det: DataFrame, gt: DataFrame, least: float, by_class: bool = False) -> DataFrame:
    """stem, gt_index, det_index, iou of the pairs of at least `least`; columns of both sides as d_* and g_*."""
    d = det.select(*[F.col(c).alias(c if c == STEM else f"d_{c}") for c in det.columns])
    g = gt.select(*[F.col(c).alias(c if c == STEM else f"g_{c}") for c in gt.columns])
    a, b = G.box("d_"), G.box("g_")
    cond = (d[STEM] == g[STEM]) & G.overlaps(a, b)
    if by_class:
        cond = cond & (d["d_cls"] == g["g_cls"])
    return d.join(g, cond).select(d[STEM], *[c for c in [*d.columns, *g.columns] if c != STEM], G.iou(a, b).alias("iou")).filter(F.col("iou") >= least)


def _greedy_fold(ordered: Column) -> Column:
    """Walks structs (.., gt_index, det_index, iou) and keeps those whose ends are both free."""
    start = F.struct(F.array().cast("array<int>").alias("g"), F.array().cast("array<int>").alias("d"), F.array().cast("array<struct<gt_index:int,det_index:int,iou:double>>").alias("kept"))

    def step(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["g"], p["gt_index"]) & ~F.array_contains(s["d"], p["det_index"])
        one = F.struct(p["gt_index"].alias("gt_index"), p["det_index"].alias("det_index"), p["iou"].alias("iou"))
        return F.when(free, F.struct(F.array_append(s["g"], p["gt_index"]).alias("g"), F.array_append(s["d"], p["det_index"]).alias("d"), F.array_append(s["kept"], one).alias("kept"))).otherwise(s)

    return F.aggregate(ordered, start, step, lambda s: s["kept"])


def match_greedy(cand: DataFrame, ties: str = "asc") -> DataFrame:
    """J1 (ties ascending by gt and det index) and J5 (ties='desc'): one-to-one, best IoU first: stem, gt_index, det_index, iou."""
    sign = 1 if ties == "asc" else -1
    key = F.struct((-F.col("iou")).alias("k"), (F.col("g_gt_index") * sign).alias("k1"), (F.col("d_det_index") * sign).alias("k2"), F.col("g_gt_index").cast("int").alias("gt_index"), F.col("d_det_index").cast("int").alias("det_index"), F.col("iou").alias("iou"))
    per = cand.groupBy(STEM).agg(F.sort_array(F.collect_list(key)).alias("p"))
    return per.select(STEM, F.inline(_greedy_fold(F.col("p"))))


def match_confident(det: DataFrame, gt: DataFrame, least: float, conf: str = "conf", by_class: bool = True, top: int | None = None) -> DataFrame:
    """Detections by descending confidence (larger box first on ties), each takes the best free GT of its class (or of any);
    every detection comes back: stem, det_index, cls, conf, gt_index and iou (null if unmatched). top: of an image and class (W3)."""
    group = [STEM, "cls"] if by_class else [STEM]
    if top:
        from pyspark.sql.window import Window

        w = Window.partitionBy(*group).orderBy(F.desc(conf), *[F.desc(c) for c in ("x1", "y1", "x2", "y2")], "det_index")
        det = det.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")
    cand = pairs(det, gt, least, by_class)
    best = F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("k"), F.col("g_gt_index").cast("int").alias("gt_index"), F.col("iou").alias("iou"))))
    keys = [STEM, *(["d_cls"] if by_class else []), "d_det_index"]
    per_det = cand.groupBy(*keys).agg(best.alias("c"), F.first(f"d_{conf}").alias("conf"), *[F.first(f"d_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    order = F.struct((-F.col("conf")).alias("k"), *[(-F.col(c)).alias(f"k{c}") for c in ("x1", "y1", "x2", "y2")], F.col("d_det_index").cast("int").alias("det_index"), F.col("c"))
    per = per_det.groupBy(*keys[:-1]).agg(F.sort_array(F.collect_list(order)).alias("d"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<det_index:int,gt_index:int,iou:double>>").alias("kept"))

    def step(s: Column, d: Column) -> Column:
        hit = F.get(F.filter(d["c"], lambda c: ~F.array_contains(s["used"], c["gt_index"])), F.lit(0))
        one = F.struct(d["det_index"].alias("det_index"), hit["gt_index"].alias("gt_index"), hit["iou"].alias("iou"))
        return F.when(hit.isNotNull(), F.struct(F.array_append(s["used"], hit["gt_index"]).alias("used"), F.array_append(s["kept"], one).alias("kept"))).otherwise(s)

    kept = per.select(STEM, F.inline(F.aggregate("d", start, step, lambda s: s["kept"])))
    return det.select(STEM, "det_index", "cls", F.col(conf).alias("conf"), "x1", "y1", "x2", "y2").join(kept, [STEM, "det_index"], "left")


def outcomes(matched: DataFrame, det: DataFrame, gt: DataFrame, ignore: DataFrame | None, least: float) -> DataFrame:
    """MATCH or WRONG class (of a match), else IGN (within an ignore region), DUP or DUPCLS (over a GT that another has, same class or not), FP; GTs left over are MISS."""
    g = gt.select(STEM, F.col("gt_index"), F.col("cls").alias("gt_cls"))
    own = matched.join(g, [STEM, "gt_index"], "left")
    over = pairs(det, gt, least).groupBy(STEM, F.col("d_det_index").alias("det_index")).agg(F.max_by("g_cls", F.struct("iou", -F.col("g_gt_index"))).alias("over_cls"))
    own = own.join(over, [STEM, "det_index"], "left")
    if ignore is not None:
        own = own.join(inside_ignore(det, ignore, 0.5, strict=False).withColumn("ign", F.lit(True)), [STEM, "det_index"], "left")
    else:
        own = own.withColumn("ign", F.lit(None).cast("boolean"))
    kind = F.when(F.col("gt_cls") == F.col("cls"), "MATCH").when(F.col("gt_cls").isNotNull(), "WRONG").when(F.col("ign"), "IGN").when(F.col("over_cls") == F.col("cls"), "DUP").when(F.col("over_cls").isNotNull(), "DUPCLS").otherwise("FP")
    hit = own.select(STEM, "det_index", "gt_index", kind.alias("kind"))
    miss = g.join(matched.filter("gt_index IS NOT NULL").select(STEM, "gt_index"), [STEM, "gt_index"], "left_anti").select(STEM, F.lit(None).cast("int").alias("det_index"), "gt_index", F.lit("MISS").alias("kind"))
    return hit.unionByName(miss)


def inside_ignore(det: DataFrame, ignore: DataFrame, share: float, strict: bool = True, by: str = "ioa") -> DataFrame:
    """stem, det_index of detections in an ignore region: F3 (ioa over `share`), F4 (strict=False) and F5 (by='iou')."""
    d, i = det.alias("d"), ignore.alias("i")
    a, b = tuple(F.col(f"d.{c}") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(f"i.{c}") for c in ("x1", "y1", "x2", "y2"))
    v = G.ioa(a, b) if by == "ioa" else G.iou(a, b)
    hit = (v > share) if strict else (v >= share)
    return d.join(i, (F.col("d.stem") == F.col("i.stem")) & G.overlaps(a, b) & hit, "left_semi").select("stem", "det_index")


def best_overlap(det: DataFrame, gt: DataFrame, least: float) -> DataFrame:
    """For each detection the GT of the greatest IoU of at least `least` (least index on ties)."""
    return pairs(det, gt, least).groupBy(STEM, F.col("d_det_index").alias("det_index")).agg(F.max_by("g_gt_index", F.struct("iou", -F.col("g_gt_index"))).alias("gt_index"), F.max("iou").alias("iou"))


def near_miss(det: DataFrame, least: float) -> DataFrame:
    """Per detection the greatest IoU with a detection of another class in its image."""
    d = det.select(STEM, *[F.col(c).alias(f"d_{c}") for c in ("det_index", "cls", "x1", "y1", "x2", "y2")])
    e = det.select(F.col(STEM).alias("_s"), *[F.col(c).alias(f"e_{c}") for c in ("det_index", "cls", "x1", "y1", "x2", "y2")])
    a, b = G.box("d_"), G.box("e_")
    p = d.join(e, (d[STEM] == e["_s"]) & (F.col("d_cls") != F.col("e_cls")) & G.overlaps(a, b)).withColumn("iou", G.iou(a, b)).filter(F.col("iou") >= least)
    return p.groupBy(STEM, F.col("d_det_index").alias("det_index")).agg(F.max("iou").alias("iou"))


def suppress(det: DataFrame, most: float, conf: str = "conf") -> DataFrame:
    """Keeps a detection if its IoU with every kept one of its image is under `most`, by descending confidence (then larger box)."""
    cols = ("x1", "y1", "x2", "y2")
    order = F.struct((-F.col(conf)).alias("k"), *[(-F.col(c)).alias(f"k{c}") for c in cols], F.col("det_index").cast("int").alias("det_index"), *[F.col(c).cast("double").alias(c) for c in cols])
    per = det.groupBy(STEM).agg(F.sort_array(F.collect_list(order)).alias("d"))
    kept_type = "array<struct<det_index:int,x1:double,y1:double,x2:double,y2:double>>"
    one = lambda d: F.struct(d["det_index"].alias("det_index"), *[d[c].alias(c) for c in cols])
    fold = F.aggregate("d", F.array().cast(kept_type), lambda s, d: F.when(F.forall(s, lambda k: G.iou(G.fields(k), G.fields(d)) < most), F.array_append(s, one(d))).otherwise(s))
    return per.select(STEM, F.explode(fold).alias("k")).select(STEM, F.col("k.det_index").alias("det_index"))

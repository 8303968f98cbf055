"""What a blur policy leaves visible or hides wrongly (A17-A20). Confidence points are joined once; areas are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtide.functions import geometry as G
from boxtide.functions.rates import percentile
from boxtide.operators import area as A
from boxtide.operators.matching import pairs
from boxtide.scratch import stored


def _dilated(gt: DataFrame, share: float) -> DataFrame:
    b = G.dilate(G.box(), share)
    return gt.select("stem", *[v.alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


def image_metrics(images: DataFrame, gt: DataFrame, ignore: DataFrame, det: DataFrame, target: int, child: int, conf: float, tau: float = 0.005, phi: float = 0.01, kappa: float = 0.2, dilate: float = 0.1) -> DataFrame:
    """Per image (stem, width, height): exposure, m1_pass, false_area_frac, fb_fail, fp_boxes, child_pass and counts.
    An image without target (or child) people has a null pass."""
    boxes = ["x1", "y1", "x2", "y2"]
    as_double = lambda df: df.withColumns({c: F.col(c).cast("double") for c in boxes})
    blur = as_double(det.filter((F.col("cls") == target) & (F.col("conf") >= conf)).select("stem", "det_index", *boxes))
    people = as_double(gt.filter(F.col("cls").isin(target, child)).select("stem", "gt_index", "cls", *boxes))
    cov = people.join(A.covered(people, blur, ["stem"], "gt_index"), ["stem", "gt_index"])
    mine = cov.join(images, "stem").withColumns({"uncov": 1 - F.col("covered"), "area": G.area(G.box()) / (F.col("width") * F.col("height"))})
    t, c = F.col("cls") == target, F.col("cls") == child
    per = mine.groupBy("stem").agg(
        F.sum(F.when(t, F.col("uncov") * F.col("area")).otherwise(0.0)).alias("exposure"), F.sum(F.when(t, 1).otherwise(0)).alias("n_gt_target"), F.sum(F.when(c, 1).otherwise(0)).alias("n_gt_child"),
        F.max(F.when(c, (F.col("covered") > kappa).cast("int")).otherwise(0)).alias("child_hit"), F.avg(F.when(t, F.col("uncov"))).alias("person_uncov"), F.avg(F.when(c, F.col("covered"))).alias("child_cov"),
        F.sum(F.when(t, F.col("uncov"))).alias("uncov_sum"), F.sum(F.when(t & (F.col("uncov") <= 0.1), 1)).alias("covered90"), F.sum(F.when(c, F.col("covered"))).alias("child_cov_sum"),
    )
    window = images.select("stem", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("width").cast("double").alias("x2"), F.col("height").cast("double").alias("y2"), F.lit(0).alias("w"))
    seen = A.clipped(blur, window, ["stem"], "w").select("stem", *boxes)
    allowed = _dilated(as_double(gt.filter(t)), dilate).unionByName(as_double(ignore).select("stem", *boxes))
    areas = A.common_area(seen, allowed, ["stem"]).select("stem", F.col("area_a").alias("blurred"), F.col("area").alias("both"))
    inside = A.covered(blur, allowed, ["stem"], "det_index").filter("covered < 0.5").groupBy("stem").agg(F.count("*").alias("fp_boxes"))
    out = images.join(per, "stem", "left").join(areas, "stem", "left").join(inside, "stem", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    wrong = F.greatest(F.lit(0.0), zero("blurred") - zero("both")) / (F.col("width") * F.col("height"))
    return out.select(
        "stem", F.coalesce("exposure", F.lit(0.0)).alias("exposure"), F.when(zero("n_gt_target") > 0, F.col("exposure") <= tau).alias("m1_pass"), wrong.alias("false_area_frac"), (wrong > phi).alias("fb_fail"),
        zero("fp_boxes").cast("long").alias("fp_boxes"), F.when(zero("n_gt_child") > 0, F.col("child_hit") == 0).alias("child_pass"), zero("n_gt_target").cast("long").alias("n_gt_target"), zero("n_gt_child").cast("long").alias("n_gt_child"), "person_uncov", "child_cov", "uncov_sum", "covered90", "child_cov_sum",
    )


def by_slice(records: DataFrame, tags: DataFrame, teen: str = "teen_band") -> DataFrame:
    """Metrics per tag and for 'all'; an image counts in each of its tags; images with the teen tag don't count for children. tags: stem, tag."""
    records = stored(records)  # read by every tag, and again for the percentile
    teens = tags.filter(F.col("tag") == teen).select("stem", F.lit(True).alias("teen")).distinct()
    long = records.join(tags.distinct(), "stem").unionByName(records.withColumn("tag", F.lit("all"))).join(teens, "stem", "left")
    grown = F.col("child_pass").isNotNull() & F.col("teen").isNull()
    share = lambda test, of: F.sum(F.when(test & of, 1).otherwise(0)) / F.nullif(F.sum(F.when(of, 1).otherwise(0)), F.lit(0))
    on = F.col("m1_pass").isNotNull()
    s = long.groupBy("tag").agg(
        F.count("*").alias("n_images"), F.sum(F.when(on, 1).otherwise(0)).alias("n_target_images"), share(F.col("m1_pass"), on).alias("m1_pass_rate"), F.avg(F.when(on, F.col("exposure"))).alias("mean_exposure"),
        share(F.col("fb_fail"), F.lit(True)).alias("falseblur_img_rate"), F.avg("false_area_frac").alias("fb_area_mean"), (F.sum("fp_boxes") * 100 / F.count("*")).alias("fp_boxes_per_100"),
        F.sum(F.when(grown, 1).otherwise(0)).alias("n_child_images"), share(F.col("child_pass"), grown).alias("child_clarity"),
        F.sum("n_gt_target").alias("n_persons"), (F.sum("uncov_sum") / F.nullif(F.sum("n_gt_target"), F.lit(0))).alias("person_uncov_mean"), (F.sum(F.coalesce("covered90", F.lit(0))) / F.nullif(F.sum("n_gt_target"), F.lit(0))).alias("person_covered90_rate"),
        (F.sum(F.when(F.col("teen").isNull(), F.col("child_cov_sum"))) / F.nullif(F.sum(F.when(F.col("teen").isNull() & (F.col("n_gt_child") > 0), F.col("n_gt_child")).otherwise(0)), F.lit(0))).alias("child_blur_mean"),
    )
    p90 = percentile(long.filter(on), ["tag"], "exposure", 90, "floor_n1").withColumnRenamed("value", "exposure_p90")
    return s.join(p90, "tag", "left")


def wrong_area_curve(images: DataFrame, gt: DataFrame, det: DataFrame, target: int, cuts: DataFrame, least: float = 0.5) -> DataFrame:
    """Detections are judged once (no GT of the target within `least` IoU is wrong); per cut the mean share of an image that the union of the wrong ones covers."""
    own, want = det.filter(F.col("cls") == target), gt.filter(F.col("cls") == target)
    right = pairs(own, want, least).select("stem", F.col("d_det_index").alias("det_index")).distinct()
    wrong = own.join(right, ["stem", "det_index"], "left_anti").join(F.broadcast(cuts), F.col("conf") >= F.col("cut"))
    per = A.union_area(wrong.select("stem", "cut", "x1", "y1", "x2", "y2"), ["stem", "cut"]).join(images, "stem")
    s = per.groupBy("cut").agg(F.sum(F.col("area") / (F.col("width") * F.col("height"))).alias("s"))
    n = images.agg(F.count("*").alias("n"))
    return cuts.join(s, "cut", "left").join(F.broadcast(n), F.lit(True)).select("cut", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("wrong_area_mean"))


def escapes(gt: DataFrame, det: DataFrame, target: int, conf: float, tier: Column | None = None) -> DataFrame:
    """The outcome of each target GT: covered (>= .9), partial (> .1), else the detection that explains it, in order: other gender, child, below threshold, none."""
    mine = gt.filter(F.col("cls") == target)
    blur = det.filter((F.col("cls") == target) & (F.col("conf") >= conf))
    cov = mine.join(A.covered(mine, blur, ["stem"], "gt_index"), ["stem", "gt_index"])
    d = det.select("stem", F.col("cls").alias("d_cls"), F.col("conf").alias("d_conf"), *[F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")])
    g = mine.select(F.col("stem").alias("_s"), "gt_index", "x1", "y1", "x2", "y2")
    near = d.join(g, (d["stem"] == g["_s"]) & G.overlaps(G.box("d_"), G.box()) & (G.ioa(G.box("d_"), G.box()) >= 0.3))
    flag = lambda t, n: F.max(F.when(t, 1).otherwise(0)).alias(n)
    other, high = F.col("d_cls") == 1 - target, F.col("d_conf") >= conf
    why = near.groupBy("stem", "gt_index").agg(flag(other & high, "other"), flag((F.col("d_cls") == 2) & high, "child"), flag((F.col("d_cls") == target) & ~high, "low"))
    outcome = F.when(F.col("covered") >= 0.9, "covered").when(F.col("covered") > 0.1, "partial").when(F.col("other") == 1, "called_woman" if target == 1 else "called_man").when(F.col("child") == 1, "called_child").when(F.col("low") == 1, "subthreshold").otherwise("no_detection")
    return cov.join(why, ["stem", "gt_index"], "left").select("stem", "gt_index", *([tier.alias("tier")] if tier is not None else []), outcome.alias("outcome"))

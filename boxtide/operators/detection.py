"""Detection metrics over matched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtide.functions import rates
from boxtide.operators import matching as M
from boxtide.operators.sweep import area_under


def ranked(rows: DataFrame, group: list[str], order: list[Column] | None = None, bucket: Column | None = None) -> DataFrame:
    """Rank, cumulative tp (ctp), precision and its envelope, by (conf desc, tp desc). rows: group, conf, tp (0/1).
    A group may hold most rows, so no window runs over a whole group: rows are windowed within buckets of the order (of `conf`
    in thousandths), and the buckets' counts and best precisions are carried over by windows on one row a bucket."""
    order = order or [F.desc("conf"), F.desc("tp")]
    b = rows.withColumn("_b", bucket if bucket is not None else -F.floor(F.col("conf") * 1000))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = b.groupBy(*group, "_b").agg(F.count("*").alias("_n"), F.sum("tp").alias("_t"))
    per = per.select(*group, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_t")])
    inner = Window.partitionBy(*group, "_b").orderBy(*order)
    r = b.join(per, [*group, "_b"]).withColumns({"rank": F.row_number().over(inner) + F.col("_n0"), "ctp": F.sum("tp").over(inner.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_t0")})
    r = r.withColumn("precision", F.col("ctp").cast("double") / F.col("rank"))
    later = Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    best = r.groupBy(*group, "_b").agg(F.max("precision").alias("_m")).select(*group, "_b", F.max("_m").over(later).alias("_later"))
    # running maxima from the end, as frames that grow: a frame that shrinks is evaluated anew for each row
    back = Window.partitionBy(*group, "_b").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return r.join(best, [*group, "_b"]).withColumn("envelope", F.greatest(F.max("precision").over(back), F.col("_later"))).drop("_b", "_n0", "_t0", "_later")


def average_precision(rows: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """A4: 101-point AP: group, n_gt, ap; null where n_gt is 0, 0 without detections. totals: group, n_gt."""
    return area_under(rows.groupBy(*group, "conf").agg(F.sum("tp").alias("tp"), F.count("*").alias("n")), totals, group)


def ap_above(rows: DataFrame, totals: DataFrame, group: list[str], cuts: DataFrame) -> DataFrame:
    """A5: AP of the detections with conf >= cut for each cut, from one matching pass: rows are counted by confidence before any cut is made. cuts: a small table (cut)."""
    counts = rows.groupBy(*group, "conf").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    above = counts.join(F.broadcast(cuts), F.col("conf") >= F.col("cut"))
    return area_under(above, totals.join(F.broadcast(cuts), F.lit(True)), [*group, "cut"])


def average_precision_all_points(rows: DataFrame, n_gt: DataFrame, group: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """Area under the envelope at each new recall. rows: group, tp and what `order` (a total order) names; bucket: a number that never falls along it."""
    r = ranked(rows, group, order, bucket)
    s = r.groupBy(*group).agg(F.sum(F.when(F.col("tp") == 1, F.col("envelope")).otherwise(0.0)).alias("s"))
    return n_gt.join(s, group, "left").select(*group, F.when(F.col("n_gt") > 0, F.coalesce("s", F.lit(0.0)) / F.col("n_gt")).alias("ap"))


def pr_at(rows: DataFrame, totals: DataFrame, group: list[str], cuts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the detections with conf >= cut; counts kept beside them."""
    per = rows.groupBy(*group, "conf").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    cut = per.join(F.broadcast(cuts), F.col("conf") >= F.col("cut")).groupBy(*group, "cut").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    s = totals.join(F.broadcast(cuts), F.lit(True)).join(cut, [*group, "cut"], "left").fillna(0, ["tp", "n"])
    f1 = rates.rate(2 * F.col("tp"), F.col("n") + F.col("n_gt"))
    return s.select(*group, "cut", "tp", "n", "n_gt", rates.rate(F.col("tp"), F.col("n")).alias("precision"), rates.rate(F.col("tp"), F.col("n_gt")).alias("recall"), f1.alias("f1"))


def recall_by(matched: DataFrame, gt: DataFrame, by: list[str]) -> DataFrame:
    """Recall with Wilson's interval per group of GT columns: k, n, rate, low, high."""
    hit = gt.join(matched.select("stem", "gt_index", F.lit(1).alias("hit")), ["stem", "gt_index"], "left")
    s = hit.groupBy(*by).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("k"), F.count("*").alias("n"))
    p, lo, hi = rates.wilson(F.col("k"), F.col("n"))
    return s.select(*by, "k", "n", p.alias("rate"), lo.alias("low"), hi.alias("high"))


def negatives(images: DataFrame, det: DataFrame, processed: DataFrame) -> DataFrame:
    """A10: of images without people: processed or not (missing is not empty), false positives, their rate per 100 images and of images."""
    per = det.groupBy("stem").agg(F.count("*").alias("fp"))
    j = images.select("stem").join(processed.select("stem", F.lit(1).alias("done")), "stem", "left").join(per, "stem", "left")
    s = j.agg(F.count("done").alias("n_processed"), F.sum(F.when(F.col("done").isNull(), 1).otherwise(0)).alias("n_missing"), F.sum(F.when(F.col("done") == 1, F.coalesce("fp", F.lit(0)))).alias("fp_total"), F.sum(F.when((F.col("done") == 1) & (F.col("fp") > 0), 1).otherwise(0)).alias("n_with_fp"))
    return s.withColumns({"fp_per_100": rates.rate(F.col("fp_total") * 100, F.col("n_processed")), "fp_image_rate": rates.rate(F.col("n_with_fp"), F.col("n_processed"))})


def crowd(det: DataFrame, gt: DataFrame, ignore: DataFrame, least: float = 0.5, dup: float = 0.5, part: float = 0.1) -> DataFrame:
    """Ignore regions first, then matching; detections left over are duplicates, partial or clear false positives by their best IoU."""
    gone = M.inside_ignore(det, ignore, 0.5)
    kept = det.join(gone, ["stem", "det_index"], "left_anti")
    matched = M.match_greedy(M.pairs(kept, gt, least))
    left = kept.join(matched.select("stem", "det_index"), ["stem", "det_index"], "left_anti")
    best = M.best_overlap(left, gt, 1e-9)
    kind = F.when(F.col("iou") >= dup, "duplicate").when(F.col("iou") >= part, "partial").otherwise("clear")
    rest = left.select("stem", "det_index").join(best, ["stem", "det_index"], "left").select(kind.alias("kind"))
    one = lambda df, name: df.select(F.lit(name).alias("kind"))
    return one(gt, "gt").unionAll(one(kept, "kept")).unionAll(one(gone, "ignored")).unionAll(one(matched, "matched")).unionAll(rest).groupBy("kind").agg(F.count("*").alias("n"))


def confusion(matched: DataFrame, det: DataFrame, gt: DataFrame) -> DataFrame:
    """Gt class by detected class, 'missed' included: one row a GT class, a column a class."""
    d = det.select("stem", "det_index", F.col("cls").alias("det_cls"))
    j = gt.select("stem", "gt_index", F.col("cls").alias("gt_cls")).join(matched.select("stem", "gt_index", "det_index"), ["stem", "gt_index"], "left").join(d, ["stem", "det_index"], "left")
    count = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    return j.groupBy("gt_cls").agg(*[count(F.col("det_cls") == k, f"as_{k}") for k in range(3)], count(F.col("det_cls").isNull(), "missed"), F.count("*").alias("n"))


def tightness(cand: DataFrame, n_gt: int | Column, cuts: list[float]) -> DataFrame:
    """Per threshold a matching of its own, its recall and mean IoU. cand: pairs of at least the least threshold."""
    parts = [M.match_greedy(cand.filter(F.col("iou") >= c)).agg(F.count("*").alias("k"), F.avg("iou").alias("mean_iou"), F.sum(F.when(F.col("iou") >= 0.75, 1).otherwise(0)).alias("k75")).withColumn("cut", F.lit(c)) for c in cuts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs matched to one GT: found by both, by one, and class flips among both. a, b: stem, gt_index, cls."""
    j = a.withColumnRenamed("cls", "ca").join(b.withColumnRenamed("cls", "cb"), ["stem", "gt_index"], "full")
    s = lambda t, n: F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).alias(n)
    x, y = F.col("ca").isNotNull(), F.col("cb").isNotNull()
    return j.agg(s(x & y, "both"), s(x & ~y, "only_a"), s(~x & y, "only_b"), s(x & y & (F.col("ca") != F.col("cb")), "flips"))


def found_by(gt: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """For each set of runs that found a GT (`mask`, bit i for run i) how many GTs it has (n), and, for each pair of its runs, how many
    with equal classes (same_i_j) and the sum of their IoUs' differences (shift_i_j). At most 2 ** len(runs) rows, from which every
    pair, triple and larger group of runs follows. runs: stem, gt_index, cls, iou of what each found."""
    rows = None
    for k, r in enumerate(runs):
        one = r.select("stem", "gt_index", F.lit(k).alias("run"), F.struct("cls", "iou").alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    per = rows.groupBy("stem", "gt_index").agg(F.bit_or(F.expr("shiftleft(1, run)")).alias("mask"), *[F.max(F.when(F.col("run") == k, F.col("x"))).alias(f"x{k}") for k in range(len(runs))])
    all_gt = gt.select("stem", "gt_index").join(per, ["stem", "gt_index"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    sums = [F.count("*").alias("n")]
    for j in range(len(runs)):
        for i in range(j):
            sums += [F.sum((F.col(f"x{i}.cls") == F.col(f"x{j}.cls")).cast("long")).alias(f"same_{i}_{j}"), F.sum(F.col(f"x{j}.iou") - F.col(f"x{i}.iou")).alias(f"shift_{i}_{j}")]
    return all_gt.groupBy("mask").agg(*sums)


def run_pairs(masks: DataFrame, n: int) -> DataFrame:
    """A row for each two of n runs from found_by(): both, only_a, only_b, neither, same_class, flips, iou_shift (mean of b - a)."""
    out = None
    for j in range(n):
        for i in range(j):
            a, b = F.col("mask").bitwiseAND(1 << i) != 0, F.col("mask").bitwiseAND(1 << j) != 0
            total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
            one = masks.agg(total(a & b).alias("both"), total(a & ~b).alias("only_a"), total(~a & b).alias("only_b"), total(~a & ~b).alias("neither"), F.coalesce(F.sum(f"same_{i}_{j}"), F.lit(0)).alias("same_class"), F.sum(f"shift_{i}_{j}").alias("s"))
            one = one.select(F.lit(i).alias("a"), F.lit(j).alias("b"), "both", "only_a", "only_b", "neither", "same_class", (F.col("both") - F.col("same_class")).alias("flips"), (F.col("s") / F.nullif("both", F.lit(0))).alias("iou_shift"))
            out = one if out is None else out.unionByName(one)
    return out


def false_of(det: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """Detections that lie over no GT."""
    return det.join(M.pairs(det, gt, least).select("stem", F.col("d_det_index").alias("det_index")), ["stem", "det_index"], "left_anti")


def shared_with(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes of `a` (stem, det_index, ..) that have one of `b` over them: shared false positives, where both are false; the rest of `a` is new."""
    return M.pairs(a, b.withColumnRenamed("det_index", "gt_index"), least).select("stem", F.col("d_det_index").alias("det_index")).distinct()


def against_reference(cells: DataFrame, group: list[str], tag: str, reference: str, value: str) -> DataFrame:
    """Each cell's difference from its group's reference row."""
    ref = cells.filter(F.col(tag) == reference).select(*group, F.col(value).alias("_ref"))
    return cells.join(ref, group, "left").withColumn("delta", F.col(value) - F.col("_ref")).drop("_ref")

"""What grew faster than its input, or worked a fold out again wherever it was named: the same results by counting one by one."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtide.functions import masks as K
from boxtide.operators import area as A
from boxtide.operators import deployment as P
from boxtide.operators import sweep as W
from boxtide.plans import fixtures as X
from boxtide.plans.registry import QUERIES


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_masks_of_an_image_meet_in_bounded_pieces(spark, at_once):
    rng = random.Random(5)
    made = [(stem, det, [(y, x, x + rng.randint(-1, 6)) for y in rng.choices(range(6), k=rng.randint(0, 9)) for x in [rng.randint(0, 14)]]) for stem in range(40) for det in rng.sample(range(9), rng.randint(0, 6))]
    pixels = {(s, d): {y * 20 + x for y, a, b in rows for x in range(a, b)} for s, d, rows in made}
    want = sorted((s, i, j, len(pixels[s, i] & pixels[s, j]), len(pixels[s, i] & pixels[s, j]) / len(pixels[s, i] | pixels[s, j])) for (s, i), (t, j) in combinations(sorted(pixels), 2) if s == t and pixels[s, i] & pixels[s, j])
    masks = spark.createDataFrame(made, "stem long, det_index int, rows array<struct<y:int,x1:int,x2:int>>")
    assert sorted(map(tuple, K.overlaps(masks, 20, at_once).collect())) == want


def test_masks_share_a_row_without_a_join(spark):
    masks = spark.createDataFrame([], "stem long, det_index int, rows array<struct<y:int,x1:int,x2:int>>")
    out = K.overlaps(masks, 20)
    assert out.count() == 0
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def _overlaps_by_pixels(pixels):
    return sorted((s, i, j, len(pixels[s, i] & pixels[s, j]), len(pixels[s, i] & pixels[s, j]) / len(pixels[s, i] | pixels[s, j])) for (s, i), (t, j) in combinations(sorted(pixels), 2) if s == t and pixels[s, i] & pixels[s, j])


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_masks_come_image_by_image_over_several_batches(spark, batch):
    rng = random.Random(9)
    made = [(stem, det, [(y, x, x + rng.randint(-1, 6)) for y in rng.choices(range(6), k=rng.randint(0, 9)) for x in [rng.randint(0, 14)]]) for stem in range(12) for det in rng.sample(range(9), rng.randint(0, 9))]
    pixels = {(s, d): {y * 20 + x for y, a, b in rows for x in range(a, b)} for s, d, rows in made}
    odd = [(None, 0, [(0, 0, 5)]), (None, 1, [(0, 0, 5)]), (0, 20, None), (0, 21, [])]  # masks of no image, masks without rows
    masks = spark.createDataFrame(made + odd, "stem long, det_index int, rows array<struct<y:int,x1:int,x2:int>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted(map(tuple, K.overlaps(masks, 20).collect())) == _overlaps_by_pixels(pixels)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_masks_are_drawn_from_boxes_in_the_tasks(spark):
    rng = random.Random(4)
    boxes = [(rng.randint(0, 9), k, x, y, x + rng.randint(0, 20), y + rng.randint(-1, 12)) for k in range(60) for x in [rng.randint(0, 24)] for y in [rng.randint(0, 24)]]
    pixels = {(s, k): {v * 100 + u for v in range(y1, y2) for u in range(x1 + (v - y1) % 3, x2 - (6 if (v - y1) % 4 == 1 else 0))} for s, k, x1, y1, x2, y2 in boxes}
    masks = spark.createDataFrame([*boxes, (0, 60, 0, 0, None, 40), (0, 61, 0, None, 40, 40)], "stem long, det_index int, x1 int, y1 int, x2 int, y2 int")
    assert sorted(map(tuple, K.overlaps(masks, 100, draw=X.jagged).collect())) == _overlaps_by_pixels(pixels)


def test_pairs_of_one_mask_come_in_bounded_pieces():
    owner, runs = np.array([0] * 9 + [1] * 3), np.array([4, 0, 4, 1, 9, 2, 0, 3, 3, 1, 1, 1])
    pieces = list(K._pairs(owner, runs, 8))
    assert [(i, j) for a, b in pieces for i, j in zip(a.tolist(), b.tolist(), strict=True)] == [(i, j) for i, j in combinations(range(12), 2) if owner[i] == owner[j] and runs[i] * runs[j]]
    assert all(runs[a].sum() <= 8 or len(a) == 1 for a, _ in pieces)  # a mask met all others of its image at once


def test_mask_overlap_shuffles_boxes_once(spark):
    plan = QUERIES["mask_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # rows of masks went through a second one, and were sorted for collect_list on both its sides
    assert "collect_list" not in plan and "transform" not in plan.lower()


def test_a_sweep_sends_a_row_a_vector_and_counts_images_without_boxes_of_a_side(spark, monkeypatch):
    box = "stem long, {0} int, cls int, {1}x1 int, y1 int, x2 int, y2 int"
    det = spark.createDataFrame([(1, 0, 0, 90, 0, 0, 10, 10), (1, 1, 0, 80, 0, 0, 10, 9), (1, 2, 1, 20, 50, 50, 60, 60), (2, 0, 1, 50, 0, 0, 10, 10)], box.format("det_index", "conf int, "))
    gt = spark.createDataFrame([(1, 0, 1, 0, 0, 10, 10), (3, 0, 0, 0, 0, 5, 5)], box.format("gt_index", ""))
    monkeypatch.setattr(W, "CELLS", 1)  # a scene at a time
    scenes = W.scenes(det, gt)
    out = W.evaluate(scenes, [(0.0, 0.0), (85.0, 60.0), (95.0, 95.0)])
    got = sorted((r["t0"], r["images"], r["gt"], r["kept"], r["matched"], r["correct"], r["dup"], r["partial"], r["clear"], r["gt_0"], r["found_1"], r["right_1"]) for r in out.collect())
    assert got == [(0.0, 3, 2, 4, 1, 0, 1, 0, 2, 1, 1, 0), (85.0, 3, 2, 1, 1, 0, 0, 0, 0, 1, 1, 0), (95.0, 3, 2, 0, 0, 0, 0, 0, 0, 1, 0, 0)]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # scenes were multiplied by vectors


def test_points_of_a_search_are_worked_out_once(spark, monkeypatch):
    det = spark.createDataFrame([(1, 0, 0, 90, 0, 0, 10, 10)], "stem long, det_index int, cls int, conf int, x1 int, y1 int, x2 int, y2 int")
    gt = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 10)], "stem long, gt_index int, cls int, x1 int, y1 int, x2 int, y2 int")
    points = W.coarse_to_fine(W.scenes(det, gt), [30.0, 60.0], [30.0, 50.0], 1, F.col("matched"), F.lit(True))
    assert points.count() == 3
    assert "MapInArrow" not in points._jdf.queryExecution().optimizedPlan().toString()


def _boxes(rng, n):
    return [(rng.randint(0, 5), k, *(rng.randint(0, 8) for _ in range(2)), *(rng.randint(8, 12) for _ in range(2))) for k in range(n)]


def _pixels(x1, y1, x2, y2):
    return {(x, y) for x in range(x1, x2) for y in range(y1, y2)}


@pytest.mark.parametrize("at_once", [1, 5, 1 << 20])
def test_unions_meet_in_one_row_and_bounded_pieces(spark, at_once):
    rng = random.Random(8)
    a, b = _boxes(rng, 40), _boxes(rng, 30)
    ua, ub = ({s: set().union(*[_pixels(*x[2:]) for x in rows if x[0] == s]) for s in range(6)} for rows in (a, b))
    frame = lambda rows: spark.createDataFrame(rows, "stem long, id int, x1 int, y1 int, x2 int, y2 int")
    common = A.common_area(frame(a), frame(b), ["stem"], at_once)
    assert {r["stem"]: (r["area"], r["area_a"], r["area_b"]) for r in common.collect()} == {s: (len(ua[s] & ub[s]), len(ua[s]), len(ub[s])) for s in range(6)}
    assert {r["stem"]: r["area"] for r in A.union_area(frame(a), ["stem"], at_once).collect()} == {s: len(ua[s]) for s in range(6)}
    covered = A.covered(frame(b), frame(a), ["stem"], "id", at_once)
    assert {r["id"]: r["covered"] for r in covered.collect()} == {k: len(_pixels(*x) & ua[s]) / len(_pixels(*x)) if (x[2] - x[0]) * (x[3] - x[1]) > 0 else 1.0 for s, k, *x in b}
    for df in (common, covered):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan


def test_slices_read_the_images_once(spark):
    images = spark.createDataFrame([(1, 10, 10), (2, 10, 10)], "stem long, width int, height int")
    box = spark.createDataFrame([(1, 0, 0, 90, 0, 0, 5, 5)], "stem long, {} int, cls int, conf int, x1 int, y1 int, x2 int, y2 int".format("det_index"))
    gt = box.withColumnRenamed("det_index", "gt_index").drop("conf")
    out = P.by_slice(P.image_metrics(images, gt, gt.select("stem", "x1", "y1", "x2", "y2"), box, 0, 2, 45), images.select("stem", F.lit("m").alias("tag")))
    assert {r["tag"]: (r["n_images"], r["mean_exposure"]) for r in out.collect()} == {"m": (2, 0.0), "all": (2, 0.0)}
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_multisets_cancel_without_a_join(spark):
    from boxtide.operators import quality as Q

    a = [(1, 5), (1, 5), (2, 7), (None, 3), (4, None), (5, 1)]
    b = [(1, 5), (2, 7), (None, 3), (4, None), (6, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "grp int, v int")
    out = Q.same_multiset(frame(a), frame(b), "grp", "v")
    assert {r["grp"]: r["differences"] for r in out.collect()} == {1: 1, None: 2, 4: 2, 5: 1, 6: 1}  # nulls equal nothing
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_fit_distinct_rows_however_laid_out(spark):
    from boxtide.operators import boundary as B

    rows = spark.createDataFrame([(i, "abcde"[i % 5], str(i % 7)) for i in range(700)], "id long, a string, b string")
    got = [{r["id"]: r["cluster"] for r in B.one_hot_clusters(rows.repartition(n), "id", ["a", "b"], 3).collect()} for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 700 and set(got[0].values()) == {0, 1, 2}
    assert all(got[0][i] == got[0][i + 35] for i in range(665))

"""Matching of many images side by side against the folds of matching.py and sweep.py, on crowded images, empty sides and ties."""

import random

import pytest
from pyspark.sql import functions as F

from boxtide.operators import matching as M
from boxtide.operators import side_by_side as S
from boxtide.operators import sweep as W


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(3)
    box = lambda: (x := rng.randint(0, 9), y := rng.randint(0, 9), x + rng.randint(4, 9), y + rng.randint(4, 9))
    det = [(s, k, rng.randint(0, 2), rng.randint(0, 9), *box()) for s in range(12) for k in range(0 if s == 5 else 40 if s == 6 else 6)]
    gt = [(s, k, rng.randint(0, 2), *box()) for s in range(1, 14) for k in range(30 if s == 6 else 5)]
    ign = [(s, *box()) for s in range(3, 9)]
    b = "x1 int, y1 int, x2 int, y2 int"
    return spark.createDataFrame(det, f"stem long, det_index int, cls int, conf int, {b}"), spark.createDataFrame(gt, f"stem long, gt_index int, cls int, {b}"), spark.createDataFrame(ign, f"stem long, {b}")


def _rows(df):
    return sorted(map(str, df.collect()))


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("cells", [1, S.CELLS])
def test_full_evaluation(boxes, monkeypatch, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    cuts, ranges = [0.3, 0.5, 0.7], {"small": (0.0, 30.0), "large": (30.0, float("inf"))}
    new = S.full_evaluation(*boxes, cuts, ranges, top=8)
    rounded = lambda df: _rows(df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]))
    assert rounded(new) == rounded(W.full_evaluation(W.scenes(*boxes, 0.3, by_class=True), cuts, ranges, top=8))
    assert "ArrayAggregate" not in str(new._jdf.queryExecution().optimizedPlan())


def test_matches_and_outcomes(boxes):
    det, gt, ign = boxes
    cols = ["stem", "det_index", "cls", "conf", "gt_index"]
    by_conf = S.matches(det, gt, 0.3, confident=True)
    assert _rows(by_conf.select(cols)) == _rows(M.match_confident(det, gt, 0.3).select(cols))
    greedy = M.match_greedy(M.pairs(det, gt, 0.3))
    assert _rows(S.matches(det, gt, 0.3).filter("gt_index IS NOT NULL").select("stem", "gt_index", "det_index")) == _rows(greedy.select("stem", "gt_index", "det_index"))
    said = greedy.join(det.select("stem", "det_index", F.col("cls").alias("said")), ["stem", "det_index"]).select("stem", "gt_index", "said")
    assert _rows(S.named(det, gt, 0.3).select("stem", "gt_index", "said")) == _rows(gt.select("stem", "gt_index").join(said, ["stem", "gt_index"], "left"))
    assert _rows(S.outcomes(det, gt, ign, 0.3)) == _rows(M.outcomes(M.match_confident(det, gt, 0.3), det, gt, ign, 0.3).select("stem", "det_index", "gt_index", "kind"))


def test_queries_shuffle_boxes_by_image_alone(spark):
    from boxtide.plans.registry import QUERIES

    for name, most in {"agreement": 1, "populations": 0, "scale_rates": 1, "outcomes": 1}.items():  # beside the boxes' own shuffle a sum's
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "det_index = " not in plan, name
        assert plan.count("Aggregate [") <= 3 + most, name

"""Threshold sweeps and full evaluation against loops over random scenes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from boxtide.operators import search as H
from boxtide.operators import sweep as W

BOX = "x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def ioa(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / area(a) if w > 0 and h > 0 else 0.0


@pytest.fixture(scope="module")
def scene(spark):
    r = random.Random(31)
    box = lambda: (x := float(r.randrange(8)), y := float(r.randrange(8)), x + r.randint(2, 7), y + r.randint(2, 7))
    gt = [(s, i, r.randrange(3), *box()) for s in range(3, 44) for i in range(r.randrange(6))]
    near = lambda s: r.choice([g[3:] for g in gt if g[0] == s and r.random() < 0.8] or [box()])
    moved = lambda b: (b[0] + r.randrange(2), b[1], b[2] + r.randrange(2), b[3] + r.randrange(2))
    det = [(s, i, r.randrange(3), r.choice([0.1, 0.25, 0.5, 0.5, 0.77, 0.9]), *moved(near(s))) for s in range(40) for i in range(r.randrange(9))]
    ign = [(s, *box()) for s in range(0, 44, 3)]
    frames = spark.createDataFrame(det, f"stem int, det_index int, cls int, conf double, {BOX}"), spark.createDataFrame(gt, f"stem int, gt_index int, cls int, {BOX}"), spark.createDataFrame(ign, f"stem int, {BOX}")
    return det, gt, ign, *frames


def brute_ap(det, gt, ign, cls, thr, rng, top):
    points, n_gt = [], sum(rng[0] <= area(g[3:]) < rng[1] for g in gt if g[2] == cls)
    for s in {d[0] for d in det} | {g[0] for g in gt}:
        own, free = sorted((d for d in det if d[0] == s and d[2] == cls), key=lambda d: (-d[3], *(-v for v in d[4:]), d[1]))[:top], [g for g in gt if g[0] == s and g[2] == cls]
        for d in own:
            best = max(free, key=lambda g: (iou(d[4:], g[3:]), -g[1]), default=None)
            if best and iou(d[4:], best[3:]) >= thr:
                free.remove(best)
                if rng[0] <= area(best[3:]) < rng[1]:
                    points.append((d[3], 1))
            elif not any(ioa(d[4:], i[1:]) >= 0.5 for i in ign if i[0] == s) and rng[0] <= area(d[4:]) < rng[1]:
                points.append((d[3], 0))
    points.sort(reverse=True)
    curve, tp = [], 0
    for k, (_, hit) in enumerate(points, 1):
        tp += hit
        curve.append((tp, tp / k))
    return n_gt, sum(max((p for t, p in curve if t * 100 >= i * n_gt), default=0.0) for i in range(101)) / 101 if n_gt else None


@pytest.mark.parametrize("top", [None, 2])
def test_full_evaluation(scene, top):
    det, gt, ign, d, g, i = scene
    cuts, ranges = [0.3, 0.5, 0.7], {"small": (0.0, 14.0), "large": (14.0, 1e9)}
    got = {(r.cls, r.area): r for r in W.full_evaluation(W.scenes(d, g, i, 0.3, by_class=True), cuts, ranges, top).collect()}
    assert len(got) == 9
    for (cls, name), r in got.items():
        want = [brute_ap(det, gt, ign, cls, t, ranges.get(name, (0, 1e18)), top) for t in cuts]
        assert r.n_gt == want[0][0]
        assert [r.ap_30, r.ap_50, r.ap_70] == pytest.approx([w[1] for w in want]) and r.ap == pytest.approx(sum(w[1] for w in want) / 3)


def brute_sums(det, gt, thr):
    out = dict.fromkeys(["kept", "matched", "correct", "dup", "partial", "clear", "found_0", "found_1", "found_2", "right_0", "right_1", "right_2"], 0)
    for s in {d[0] for d in det} | {g[0] for g in gt}:
        ds, gs = [d for d in det if d[0] == s and d[3] >= thr[d[2]]], [g for g in gt if g[0] == s]
        out["kept"] += len(ds)
        used = {}
        for _, gi, di in sorted((-iou(d[4:], g[3:]), g[1], d[1]) for d in ds for g in gs if iou(d[4:], g[3:]) >= 0.5):
            if gi not in used and di not in used.values():
                used[gi] = di
        for gi, di in used.items():
            a, b = next(g[2] for g in gs if g[1] == gi), next(d[2] for d in ds if d[1] == di)
            out["matched"] += 1
            out["correct"] += a == b
            out[f"found_{a}"] += 1
            out[f"right_{a}"] += a == b
        for d in ds:
            if d[1] not in used.values():
                best = max((iou(d[4:], g[3:]) for g in gs), default=0.0)
                out["dup" if best >= 0.5 else "partial" if best >= 0.1 else "clear"] += 1
    return out


def test_vectors(scene):
    det, gt, _, d, g, _ = scene
    vectors = [(0.0, 0.0, 0.0), (0.3, 0.5, 0.9), (0.5, 0.5, 0.5), (1.1, 0.2, 0.6), (2.0, 2.0, 2.0)]
    got = {(r.t0, r.t1, r.t2): r.asDict() for r in W.evaluate(W.scenes(d, g), vectors).collect()}
    assert len(got) == 5
    for v in vectors:
        want = brute_sums(det, gt, v) | {"images": len({x[0] for x in det} | {x[0] for x in gt}), "gt": len(gt)}
        assert {k: got[v][k] for k in want} == want


def points_of(det, gt, vectors):
    """(objective, sum of thresholds, thresholds) of the feasible vectors."""
    out = []
    for v in vectors:
        s = brute_sums(det, gt, v)
        if s["kept"] and s["matched"] >= 0.15 * s["kept"]:
            out.append((2 * s["correct"] / (s["kept"] + len(gt)), sum(v), v))
    return out


def test_searches(scene):
    det, gt, _, d, g, _ = scene
    stored, m = W.scenes(d, g).persist(), W.metrics(3)
    goal, allowed = H.expression("people.f1", m), H.expression("crowd.precision >= 0.15", m)
    coarse, fine = [0.2, 0.6], [0.0, 0.2, 0.3, 0.6, 0.8, 1.2]
    first = points_of(det, gt, itertools.product(coarse, repeat=3))
    best = max(first)[2]
    rest = points_of(det, gt, itertools.product(*[[t for t in fine if abs(t - b) <= 0.4 + 1e-9] for b in best]))
    points = W.coarse_to_fine(stored, coarse, fine, 3, goal, allowed)
    assert points.select("t0", "t1", "t2").distinct().count() == points.count()
    r = H.pick_best(points, "objective", "feasible", ["t0", "t1", "t2"]).first()
    assert r.objective == pytest.approx(max(first + rest)[0]) and (r.t0, r.t1, r.t2) == max(first + rest)[2]

    now = (0.0, 0.0, 0.0)
    for _ in range(10):
        before = now
        for k in range(3):
            now = max(points_of(det, gt, [(*now[:k], t, *now[k + 1 :]) for t in fine]), default=(0, 0, now))[2]
        if now == before:
            break
    r = W.one_at_a_time(stored, fine, (0.0, 0.0, 0.0), goal, allowed).first()
    assert (r.t0, r.t1, r.t2) == now
    assert W.coarse_to_fine(stored, coarse, fine, 3, goal, F.lit(False)).count() == 8


def test_metric_language(spark):
    values = {"a.b": 3.0, "a.c": -2.0, "n.img_fp_rate": 0.5, "z.z": 0.0}
    texts = ["a.b - 2*a.c ** 2", "-a.b**2 / z.z + 1", "1 < a.b <= 3 and not_zero", "max(a.b, a.c, 7.5) - abs(a.c)", "(a.b + a.c) * 2 >= 2 or a.b == 4", "2 ** -1 + min(1e1, .5)", "a.b - a.c - 1", "+a.b != - -3", "1 < 2 > 1.5"]
    want = [3.0 - 2 * 4, 1.0, None, 7.5 - 2, True, 1.0, 4.0, False, True]
    m = {k: F.lit(v) for k, v in values.items()}
    for t, w in zip(texts, want, strict=True):
        if w is None:
            with pytest.raises(ValueError):
                H.expression(t, m)
        else:
            assert spark.range(1).select(H.expression(t, m).alias("x")).first().x == w, t
    for bad in ("a.b +", "(a.b", "a.b a.c", "f(a.b)", "a.b; a.c", "__import__('os')", "", "min(a.b", "max()"):
        with pytest.raises(ValueError):
            H.expression(bad, m)
    with pytest.raises(KeyError):
        H.expression("arm.nope + 1", m)
    assert H.preset("min_fp", ["n"], 2) == "-(n.img_fp_rate)" and "(p.img_fp_rate + q.img_fp_rate)/2" in H.preset("min_fp", ["p", "q"], 2)
    assert H.grid(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3]

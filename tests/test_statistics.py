"""Selections, bootstraps, skylines and masks against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtide.functions import masks as K
from boxtide.functions import rates as R
from boxtide.operators import sampling as S
from boxtide.operators import search as H


def test_percentiles(spark, monkeypatch):
    """Small buckets, so that several levels run; heavy ties, a single value, nulls, a null group, signs and far outliers."""
    monkeypatch.setattr(R, "FEW", 5)
    monkeypatch.setattr(R, "BUCKETS", 4)
    r = random.Random(2)
    rows = [("a", r.choice([1.0, 1.0, 1.0, 2.5, 1e9, -7.0])) for _ in range(300)] + [("b", r.gauss(0, 3)) for _ in range(501)] + [("c", 4.0)] * 9 + [(None, float(i)) for i in range(12)] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    want = {("floor_n", lambda n, p: min(n - 1, int(n * p / 100))), ("round_n1", lambda n, p: round(p / 100 * (n - 1))), ("floor_n1", lambda n, p: int(p / 100 * (n - 1))), ("floor_n_less1", lambda n, p: max(0, int(p / 100 * n) - 1)), ("upper_middle", lambda n, p: n // 2)}
    places = {f"{c}{p}": (p, c) for c, _ in want for p in (10, 50, 90)}
    got = {(x.g, x.name): x.value for x in R.percentiles(df, ["g"], "v", places).collect()}
    assert len(got) == 4 * len(places)
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        for c, at in want:
            for p in (10, 50, 90):
                assert got[g, f"{c}{p}"] == v[at(len(v), p)], (g, c, p)
    assert R.percentile(df, [], "v", 50, "floor_n1").first().value == sorted(x for _, x in rows if x is not None)[int(0.5 * (len(rows) - 3))]


def test_gini(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 8)
    r = random.Random(3)
    rows = [(g, r.choice([0, 0, 1, 2, 5, 40])) for g in "abc" for _ in range(80)] + [("z", 0)] * 5
    got = {x.g: x.gini for x in R.gini(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    for g in "abcz":
        v = sorted(x for k, x in rows if k == g)
        t, n = sum(v), len(v)
        assert got[g] == pytest.approx(2 * sum((i + 1) * x for i, x in enumerate(v)) / (n * t) - (n + 1) / n if t else 0.0)


def test_bootstrap(spark):
    """The interval is that of resampled rows; the mean of the draws that of the rows."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2, 900), rng.integers(0, 3, 900) // 2
    got = S.bootstrap(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a int, b int"), "a", 3000, 7, "b").first()
    at = rng.integers(0, 900, (3000, 900))
    m, d = a[at].mean(1), (a - b)[at].mean(1)
    assert got.mean == pytest.approx(a.mean()) and got.diff_mean == pytest.approx((a - b).mean())
    assert [got.low, got.high] == pytest.approx(np.percentile(m, [2.5, 97.5]), abs=0.004)
    assert [got.diff_low, got.diff_high] == pytest.approx(np.percentile(d, [2.5, 97.5]), abs=0.006)
    few = S.bootstrap(spark.createDataFrame([(1.5,)] * 3, "a double"), "a", 50, 1).first()
    assert few.low in (None, 1.5) and few.mean == 1.5


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_skyline(spark, monkeypatch, n):
    monkeypatch.setattr(H, "CELLS", 30)
    r = random.Random(n)
    rows = [(i, *[float(r.randrange(12)) if r.random() < 0.5 else r.random() * 12 for _ in range(n)]) for i in range(400)] + [(900, *[None] * n), (901, *[float("nan")] * n), (902, *[3.0] * n), (903, *[3.0] * n)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"a{k} double" for k in range(n))).repartition(5)
    axes = [("max" if k % 2 == 0 else "min", f"a{k}") for k in range(n)]
    out = H.pareto(df, axes)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    good = {x[0]: [v if k % 2 == 0 else -v for k, v in enumerate(x[1:])] for x in rows if x[1] is not None and x[1] == x[1]}
    want = {i for i, v in good.items() if not any(all(p >= q for p, q in zip(w, v)) and w != v for w in good.values())}
    assert {x.id for x in out.collect()} == want
    assert H.pareto(df.limit(0), axes).count() == 0


def test_masks(spark):
    r = random.Random(6)
    def mask():
        return [(r.randrange(9), a := r.randrange(12), a + r.randrange(-1, 6)) for _ in range(r.randrange(7))]
    pairs = [(i, mask(), mask()) for i in range(120)]
    df = spark.createDataFrame(pairs, "id int, p array<struct<y:int,x1:int,x2:int>>, q array<struct<y:int,x1:int,x2:int>>")
    df = df.select("id", *[K.runs_of_rows(F.col(c), F.lit(20)).alias(c) for c in "pq"])
    got = {x.id: x for x in df.select("id", "p", K.size(F.col("p")).alias("n"), K.common(F.col("p"), F.col("q")).alias("both"), K.iou(F.col("p"), F.col("q")).alias("iou"), K.extent(F.col("p"), F.lit(20)).alias("box")).collect()}
    for i, p, q in pairs:
        a, b = ({y * 20 + x for y, x1, x2 in m for x in range(x1, x2)} for m in (p, q))
        g = got[i]
        assert {x for s in g.p for x in range(s.start, s.end)} == a and g.n == len(a) and all(s.end < t.start for s, t in zip(g.p, g.p[1:]))
        assert g.both == len(a & b) and g.iou == pytest.approx(len(a & b) / len(a | b) if a | b else 0.0)
        assert (tuple(g.box) if g.box else None) == ((min(x % 20 for x in a), min(x // 20 for x in a), max(x % 20 for x in a) + 1, max(x // 20 for x in a) + 1) if a else None)

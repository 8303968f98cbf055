"""Classifiers by held-out accuracy, the pipeline stage by stage."""

import math
import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from boxtide.llm import features, quality_model, toxicity
from tests.llm.conftest import SCHEMA, edge_rows

SF = "/root/testdata/sf0.01"


def held_out(got: pd.DataFrame, column: str) -> pd.DataFrame:
    return got[got.held_out].merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")[[column, "predicted", "score"]]


def auc(x: pd.DataFrame, column: str) -> float:
    r, y = x.score.rank(), x[column]
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "column", "least"), [(toxicity, "toxic", 0.85), (quality_model, "quality", 0.97)])
def test_classifier(spark, module, column, least):
    got = module.query(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    cut = 0.7 if column == "quality" else 0.5
    assert ((got.score >= cut) == (got.predicted == 1)).all()
    x = held_out(got, column)
    assert auc(x, column) > least and (x[column] == x.predicted).mean() > 0.9


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifier_edges(spark, edge, empty, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.apply(edge, none).collect()} == {0.0}
    ones = spark.createDataFrame([(101, 1, 1), (101, 0, 0), (None, 1, 1), (105, None, None)], "doc_id long, quality int, toxic int")
    assert module.apply(edge, ones).count() == edge.count()
    assert module.apply(empty, ones).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifier_learns_from_awkward_rows(spark, module):
    """Both classes in training, with null, empty, blank and very long texts among them, ties, and rows that repeat a doc_id."""
    r = random.Random(4)
    bad, good = ["you idiot!!", "shut UP you", "HATE hate ###"], ["the committee met on", "a report of the survey", "rivers and their banks"]
    made = [(1000 + i, " ".join(r.choice(bad if i % 2 else good) for _ in range(r.randrange(3, 60))), "en", "s", 0, "k", 1) for i in range(240)]
    docs = spark.createDataFrame([*edge_rows(), *made, made[0], made[1]], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(row[0], 1 - row[0] % 2, row[0] % 2) for row in [*edge_rows(), *made] if row[0] is not None], "doc_id long, quality int, toxic int")
    got = module.apply(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    again = module.apply(docs.repartition(7), labels).toPandas()
    assert sorted(got.score.round(9)) == sorted(again.score.round(9))
    x = got[got.held_out & (got.doc_id >= 1000)]
    right = (x.doc_id % 2 == (1 if module is toxicity else 0)) == (x.predicted == 1)
    assert len(x) > 20 and right.mean() > 0.9


def test_densities():
    """Scores' log ratios from covariances by loops, with inverse and determinant by elimination."""
    rng = np.random.default_rng(5)
    n, k = 90, len(features.NAMES)
    x, y = np.abs(rng.normal(1, 0.4, (n, k))), np.arange(n) % 2
    x[y == 1] *= 1.1
    model = quality_model.Discriminant().fit(x, y, np.ones(n))
    z = quality_model.transformed(x)
    z = (z - z.mean(0)) / np.maximum(z.std(0), 1e-3)

    def eliminated(c):
        """The inverse and the log of the determinant of a positive matrix, by Gauss and Jordan."""
        a, log = [[*map(float, row), *(float(i == j) for j in range(k))] for i, row in enumerate(c)], 0.0
        for i in range(k):
            log += math.log(a[i][i])
            a[i] = [v / a[i][i] for v in a[i]]
            for j in range(k):
                if j != i:
                    a[j] = [v - a[j][i] * w for v, w in zip(a[j], a[i], strict=True)]
        return [row[k:] for row in a], log

    logs = []
    for v in (0, 1):
        own = [row for row, c in zip(z.tolist(), y, strict=True) if c == v]
        m = [sum(col) / len(own) for col in zip(*own, strict=True)]
        c = [[sum((r[i] - m[i]) * (r[j] - m[j]) for r in own) / len(own) * (1 if i == j else 1 - quality_model.TO_DIAGONAL) for j in range(k)] for i in range(k)]
        ridge = max(sum(c[i][i] for i in range(k)) / k, 1e-3)
        c = [[(1 - quality_model.TO_IDENTITY) * c[i][j] + (quality_model.TO_IDENTITY * ridge if i == j else 0) for j in range(k)] for i in range(k)]
        inv, log = eliminated(c)
        logs.append([-0.5 * sum((r[i] - m[i]) * inv[i][j] * (r[j] - m[j]) for i in range(k) for j in range(k)) - 0.5 * log for r in z.tolist()])
    want = [math.copysign(math.sqrt(abs(b - a)), b - a) for a, b in zip(*logs, strict=True)]
    assert np.allclose(model.ratio(quality_model.transformed(x)), want, atol=1e-6)


def test_trees():
    """Every inner node of a tree has the best of all its splits, by loops over rows; leaves hold the damped Newton steps."""
    rng = np.random.default_rng(6)
    n = 6 * toxicity.LEAST_ROWS
    x = rng.integers(0, 9, (n, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6) ^ (rng.random(n) < 0.1)).astype(float)
    model = toxicity.Trees().fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(n, p * (1 - p))
    feature, cut, value = model.trees[0]
    code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(model.edges, x.T, strict=True)])
    score = lambda rows: sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + 1)
    split, todo = 0, [(0, list(range(n)))]
    while todo:
        k, rows = todo.pop()
        if k >= len(feature):
            step = toxicity.RATE * sum(g[r] for r in rows) / (sum(h[r] for r in rows) + 1)
            assert value[k - len(feature)] == pytest.approx(step)
            continue
        gains = {}
        for f in range(3):
            for b in range(int(code.max()) + 1):
                low, high = [r for r in rows if code[r, f] <= b], [r for r in rows if code[r, f] > b]
                if min(len(low), len(high)) >= toxicity.LEAST_ROWS:
                    gains[f, b] = score(low) + score(high) - score(rows)
        low = [r for r in rows if code[r, feature[k]] <= cut[k]]
        if cut[k] <= toxicity.BINS:
            split += 1
            assert gains[feature[k], cut[k]] == pytest.approx(max(gains.values())) and gains[feature[k], cut[k]] > 0
        else:
            assert not gains or max(gains.values()) <= 1e-6 + 1e-9 or len(rows) < 2 * toxicity.LEAST_ROWS
        todo += [(2 * k + 1, low), (2 * k + 2, [r for r in rows if code[r, feature[k]] > cut[k]])]
    assert split >= 3
    total = np.full(n, model.base)
    for f, c, v in model.trees:
        for r in range(0, n, 7):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(code[r, f[at]] > c[at])
            total[r] += v[at - len(f)]
    assert np.allclose(model.margin(x)[::7], total[::7])


def test_isotonic():
    def brute(x, y, w):
        """Max over starts of the min over ends of weighted means, at each distinct score."""
        at = np.unique(x)
        mean = lambda a, b: np.average(y[(x >= a) & (x <= b)], weights=w[(x >= a) & (x <= b)])
        return at, np.array([max(min(mean(a, b) for b in at[at >= z]) for a in at[at <= z]) for z in at])

    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        x, y, w = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n).astype(float), rng.uniform(0.2, 3, n)
        knots, level = toxicity.isotonic(x, y, w)
        assert (np.diff(knots) > 0).all() and (np.diff(level) >= 0).all()
        at, want = brute(x, y, w)
        got = np.interp(at, knots, level)
        inner = (want > 0.15) & (want < 0.85)
        assert np.allclose(got[inner], want[inner]) and np.abs(got - want).max() < 0.1 and (0 < got).all() and (got < 1).all()
        p = rng.permutation(n)
        again = toxicity.isotonic(x[p], y[p], w[p])
        assert np.allclose(again[0], knots) and np.allclose(again[1], level)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "packing":
            assert docs.columns == columns
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert left <= ids and (left == ids or name != "line_dedup")
            docs, ids = spark.createDataFrame(docs.toPandas(), docs.schema), left
    got = docs.toPandas()
    assert set(got.doc_id) == ids and len(corpus_pipeline.STAGES) == 5
    assert got.groupby("sequence_id").length.sum().max() <= 4096


@pytest.mark.parametrize("kind", ["int", "decimal(20,0)"])
@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality_model, "quality")])
def test_training_with_other_types_of_keys(spark, small, module, column, kind):
    """The same scores as with bigint keys."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    assert docs.schema["doc_id"].dataType.simpleString() == "bigint"
    of = lambda t: sorted(module.apply(docs.withColumn("doc_id", docs["doc_id"].cast(t)), labels.withColumn("doc_id", labels["doc_id"].cast(t))).collect())
    got = of(kind)
    assert got == of("bigint") and len(got) == docs.count()


@pytest.mark.parametrize("kind", ["int", "decimal(20,0)"])
def test_quality_stage_with_other_types_of_keys(spark, small, tmp_path, kind):
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{small}/{t}.parquet")
        df.withColumn("doc_id", df["doc_id"].cast(kind)).write.parquet(str(tmp_path / f"{t}.parquet"))
    stage = dict(corpus_pipeline.STAGES)["quality_model"]
    kept = lambda d: {int(r.doc_id) for r in stage(spark, spark.read.parquet(f"{d}/documents.parquet"), str(d)).select("doc_id").collect()}
    assert kept(tmp_path) == kept(small) != set()


def test_pipeline_run_on_awkward_tables(spark, tmp_path):
    """run() over nulls, empty and long texts, repeated rows and clashing columns; and over a table without rows."""
    text = " ".join(f"word{i % 61} is here" for i in range(80))
    rows = [*edge_rows(), *((500 + i, f"{text} number {i} " + " ".join(f"own{i}x{j}" for j in range(60)), "en", "s", 9, "k", 1) for i in range(12)), (600, f"{text} number 1", None, None, None, None, None)]
    for name, some in (("edge", rows), ("none", [])):
        spark.createDataFrame(some, SCHEMA).repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(r[0], 1, 0) for r in some if r[0] is not None and r[0] >= 500], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).toPandas()
        assert set(got.doc_id.dropna()) <= {r[0] for r in some} and (len(got) > 0) == (name == "edge")
        if len(got):
            assert got.groupby("sequence_id").length.sum().max() <= 4096 and (got.doc_id >= 500).any()
            assert got.groupby("doc_id").length.sum().eq(got.groupby("doc_id").doc_tokens.first()).all()

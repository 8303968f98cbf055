"""Clustering and near-duplicates of vectors against brute force."""

import hashlib
import math

import numpy as np
import pytest

from boxtide.llm import centroids, vector_graph
from tests.oracle import duck, rows

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance double"
WIDE = "vec_id long, embedding array<double>, label int, cluster string, distance double"


def brute_lloyd(vectors):
    kept = [(i, [math.floor(1024 * float(v)) for v in e]) for i, e in vectors if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in order[:8]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min((far(x, y), k) for k, y in enumerate(c))
    for _ in range(10):
        at = [near(x)[1] for _, x in kept]
        for k in range(len(c)):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == k]
            if own:
                c[k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    last = [(i, near(x)[1], near(x)[0]) for i, x in kept]
    total = sum(d for *_, d in last)
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    fits = lambda v: v if v < 2**63 else None
    return sorted(((i, k, fits(d), fits(sum(e for _, j, e in last if j == k)), fits(total), sha[k]) for i, k, d in last), key=str)


def vectors_with_edges(n, seed=5, scale=1.0):
    rng = np.random.default_rng(seed)
    v = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, 64)], int(i % 3)) for i in range(n)]
    same = v[3][1]
    return [*v, (900, None, 1), (901, [], 1), (902, [1.0] * 63, 1), (903, [1.0] * 63 + [None], 1), (904, [1.0] * 63 + [float("nan")], 1), (905, [1.0] * 63 + [float("inf")], 0), (906, [0.0] * 64, 0), (907, same, 0), (908, same, None), v[3], (None, v[4][1], 1)]


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_lloyd(spark, scale):
    v = vectors_with_edges(60, scale=scale)
    got = centroids.apply(spark.createDataFrame([(*r, "k", 1.5) for r in v], SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lloyd([(i, e) for i, e, _ in v])


def test_lloyd_beyond_64_bits(spark):
    """Clusters and centroids stay exact where distances no longer fit into a long."""
    v = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(0, 10.0 ** (i % 4 * 12), 64)]) for i in range(30)]
    got = centroids.apply(spark.createDataFrame([(i, e, 0, "", 0.0) for i, e in v], WIDE).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lloyd(v)


def test_lloyd_few_and_none(spark):
    few = [(i, [float(i)] * 64) for i in (1, 2, 2)]
    assert sorted((tuple(r) for r in centroids.apply(spark.createDataFrame([(*r, 0, "", 0.0) for r in few], WIDE)).collect()), key=str) == brute_lloyd(few)
    assert centroids.apply(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lloyd_sql(spark, small):
    got, want = centroids.query(spark, small).toPandas(), duck(small).sql(centroids.SQL).df()
    assert len(got) == 500 and rows(got) == rows(want)


def brute_links(vectors):
    """vec_id -> (n_links, component) by all pairs; vectors: rows (vec_id, embedding, label)."""
    good = sorted({(i, tuple(e), lab) for i, e, lab in vectors if lab is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e)}, key=str)
    x = [np.array(e) / np.linalg.norm(e) for _, e, _ in good]
    near = [[j for j in range(len(good)) if j != i and good[i][2] == good[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.93] for i in range(len(good))]
    comp = list(range(len(good)))
    for i in range(len(good)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((good[j][0] for j in seen if good[j][0] is not None), default=None)
    known = {g: (len(near[k]), comp[k]) for k, g in enumerate(good)}
    out = []
    for i, e, lab in vectors:
        n, c = known.get((i, tuple(e or ()), lab), (0, i))
        out.append((i, n, c, c is None or i == c))
    return sorted(out, key=str)


def group(rng, centre, n, noise):
    return [centre + rng.normal(0, noise, len(centre)) for _ in range(n)]


def near_rows():
    """Pairs, a tight group of 70, a second one near it so that only some members are linked, a wide group, a chain, equal vectors."""
    rng = np.random.default_rng(8)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(0, 1, 64))
    lone = [rng.normal(0, 1, 64) for _ in range(150)]
    a, b = unit(), unit()
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    turn = lambda t: math.cos(t) * a + math.sin(t) * b
    made = [*lone, *(v + rng.normal(0, 0.05, 64) for v in lone[:20]), *group(rng, a, 70, 0.012), *group(rng, turn(0.36), 60, 0.012), turn(0.5), turn(-0.35), *group(rng, unit(), 40, 0.034), *(turn(1.2 + 0.3 * k) for k in range(4)), *[unit()] * 30]
    rows = [(i, [float(np.float32(x)) for x in v], 1 + int(i == 3)) for i, v in enumerate(made)]
    return [*rows, rows[0], (5000, rows[1][1], 9), (None, rows[2][1], 1), (5001, None, 1), (5002, [0.0] * 64, 1), (5003, rows[2][1], None), (5004, [1.0, None], 1), (5005, [float("nan")] * 64, 1), (5006, [], 1), (5007, rows[2][1][:32], 1), (5008, rows[2][1][:32], 1)]


def test_near_vectors(spark):
    v = near_rows()
    want = brute_links(v)
    assert sum(r[1] for r in want) > 8000 and max(r[1] for r in want) > 100
    got = vector_graph.apply(spark.createDataFrame([(*r, "k", 1.5) for r in v], SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == want


def test_near_vectors_none(spark):
    assert vector_graph.apply(spark.createDataFrame([], SCHEMA)).count() == 0
    bad = [(1, None, 1), (2, [0.0] * 3, 1), (None, None, None)]
    assert sorted((tuple(r) for r in vector_graph.apply(spark.createDataFrame([(*r, "", 0.0) for r in bad], SCHEMA)).collect()), key=str) == brute_links(bad)


def test_near_vectors_sql(spark, small):
    got, want = vector_graph.query(spark, small).toPandas(), duck(small).sql(vector_graph.SQL).df()
    assert len(got) == 500 and rows(got) == rows(want)

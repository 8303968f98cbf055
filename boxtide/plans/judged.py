"""Queries that judge stored scenes: full AP evaluation, threshold searches; masks, agreement of runs; and answers of models parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtide.functions import masks as K
from boxtide.functions import text as T
from boxtide.operators import search as H
from boxtide.operators import side_by_side as S
from boxtide.operators import sweep as W
from boxtide.plans import fixtures as X
from boxtide.plans.fixtures import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CUTS = [50, 55, 60, 65, 70, 75, 80, 85, 90, 95]
_RANGES = {"small": (0.0, 850.0), "medium": (850.0, 1150.0), "large": (1150.0, float("inf"))}
_IN = " OR ".join(f"(r = '{n}' AND a >= {lo} AND a < {'1e18' if hi == float('inf') else hi})" for n, (lo, hi) in _RANGES.items())


@query(X.WITH + "".join(X.confident_sql(f"m{c}", c / 100) for c in _CUTS) + ", hit AS (" + " UNION ALL ".join(f"SELECT {c} AS cut, stem, di, gi FROM m{c}" for c in _CUTS) + f"""),
ig AS (SELECT DISTINCT a.stem, a.det_index FROM det a JOIN ign b ON a.stem = b.stem WHERE {X.IOA} >= 0.5),
ranges AS (SELECT unnest(['all', 'small', 'medium', 'large']) AS r), cuts AS (SELECT unnest({_CUTS}) AS cut),
ga AS (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM gt), da AS (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM det),
tot AS (SELECT cls, r, count(*) AS n_gt FROM ga, ranges WHERE r = 'all' OR {_IN} GROUP BY ALL),
rows_ AS (SELECT d.cls, c.cut, d.conf, h.gi IS NOT NULL AS tp, coalesce(g.a, d.a) AS a FROM da d CROSS JOIN cuts c LEFT JOIN hit h ON h.cut = c.cut AND h.stem = d.stem AND h.di = d.det_index
  LEFT JOIN ga g ON g.stem = h.stem AND g.gt_index = h.gi LEFT JOIN ig ON ig.stem = d.stem AND ig.det_index = d.det_index WHERE h.gi IS NOT NULL OR ig.stem IS NULL),
r0 AS (SELECT cls, cut, r, conf, tp::INT AS tp FROM rows_, ranges WHERE r = 'all' OR {_IN}),
r1 AS (SELECT *, row_number() OVER w AS rank, sum(tp) OVER w AS ctp FROM r0 WINDOW w AS (PARTITION BY cls, cut, r ORDER BY conf DESC, tp DESC ROWS UNBOUNDED PRECEDING)),
r2 AS (SELECT *, max(ctp::DOUBLE / rank) OVER (PARTITION BY cls, cut, r ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r1),
ap AS (SELECT t.cls, t.r, c.cut, t.n_gt, coalesce(sum(CASE WHEN tp = 1 THEN env * (SELECT count(*) FROM range(0, 101) q(i) WHERE i * t.n_gt <= ctp * 100 AND (i * t.n_gt > (ctp - 1) * 100 OR (i = 0 AND ctp = 1))) END), 0) / 101 AS ap
  FROM tot t CROSS JOIN cuts c LEFT JOIN r2 ON r2.cls = t.cls AND r2.r = t.r AND r2.cut = c.cut GROUP BY ALL)
SELECT cls, r AS area, any_value(n_gt) AS n_gt, round(max(CASE WHEN cut = 50 THEN ap END), 9) AS ap_50, round(max(CASE WHEN cut = 75 THEN ap END), 9) AS ap_75, round(avg(ap), 9) AS ap FROM ap GROUP BY cls, r""")
def map_full(s, d):
    """AP at ten thresholds by class and area, matches outside the range and ignore regions left out, from one fold."""
    out = S.full_evaluation(X.det(s, d), X.gt(s, d), X.ignore(s, d), [c / 100 for c in _CUTS], _RANGES)
    return out.select("cls", "area", "n_gt", *[F.round(c, 9).alias(c) for c in ("ap_50", "ap_75", "ap")])


def _judged(n: str, vectors: str) -> str:
    """CTEs that end in <n>(t0, t1, t2, kept .. objective, feasible) for the vectors of a CTE."""
    return f""",
{n}_k AS MATERIALIZED (SELECT t0, t1, t2, stem, coalesce(list(det_index ORDER BY det_index) FILTER (conf >= CASE cls WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END), []) AS m FROM det, {vectors} GROUP BY ALL),
{n}_c AS MATERIALIZED (SELECT DISTINCT stem, m FROM {n}_k),
{n}_o AS MATERIALIZED (SELECT c.stem, c.m, p.gi, p.di, row_number() OVER (PARTITION BY c.stem, c.m ORDER BY p.v DESC, p.gi, p.di) AS rn FROM {n}_c c JOIN over_ p ON p.stem = c.stem AND p.v >= 0.5 AND list_contains(c.m, p.di)),
{n}_w AS (SELECT DISTINCT stem, m, 0::BIGINT AS rn, []::INT[] AS ug, []::INT[] AS ud FROM {n}_c
  UNION ALL SELECT w.stem, w.m, o.rn, CASE WHEN list_contains(w.ug, o.gi) OR list_contains(w.ud, o.di) THEN w.ug ELSE list_append(w.ug, o.gi) END, CASE WHEN list_contains(w.ug, o.gi) OR list_contains(w.ud, o.di) THEN w.ud ELSE list_append(w.ud, o.di) END
  FROM {n}_w w JOIN {n}_o o ON o.stem = w.stem AND o.m = w.m AND o.rn = w.rn + 1),
{n}_e AS MATERIALIZED (SELECT stem, m, max_by(ug, rn) AS ug, max_by(ud, rn) AS ud FROM {n}_w GROUP BY stem, m),
{n}_h AS (SELECT e.stem, e.m, count(*) AS matched, sum((d.cls = g.cls)::INT) AS correct, sum((d.cls = 0 AND g.cls = 0)::INT) AS right_0 FROM (SELECT stem, m, unnest(ug) AS gi, unnest(ud) AS di FROM {n}_e) e
  JOIN gt g ON g.stem = e.stem AND g.gt_index = e.gi JOIN det d ON d.stem = e.stem AND d.det_index = e.di GROUP BY ALL),
{n}_f AS (SELECT e.stem, e.m, sum((coalesce(b.v, 0) >= 0.5)::INT) AS dup, sum((coalesce(b.v, 0) >= 0.1 AND coalesce(b.v, 0) < 0.5)::INT) AS partial, sum((coalesce(b.v, 0) < 0.1)::INT) AS clear
  FROM (SELECT stem, m, unnest(list_filter(m, lambda x: NOT list_contains(ud, x))) AS di FROM {n}_e) e LEFT JOIN best_ b ON b.stem = e.stem AND b.di = e.di GROUP BY ALL),
{n}_s AS (SELECT t0, t1, t2, sum(len(k.m))::BIGINT AS kept, sum(coalesce(matched, 0))::BIGINT AS matched, sum(coalesce(correct, 0))::BIGINT AS correct, sum(coalesce(dup, 0))::BIGINT AS dup, sum(coalesce(partial, 0))::BIGINT AS partial, sum(coalesce(clear, 0))::BIGINT AS clear, sum(coalesce(right_0, 0))::BIGINT AS right_0
  FROM {n}_k k LEFT JOIN {n}_h h ON h.stem = k.stem AND h.m = k.m LEFT JOIN {n}_f f ON f.stem = k.stem AND f.m = k.m GROUP BY ALL),
{n} AS MATERIALIZED (SELECT *, 2.0 * correct / (kept + (SELECT count(*) FROM gt)) - 0.1 * (1.0 * clear / greatest(kept, 1)) AS objective, matched >= 0.5 * kept AND right_0 >= 0.2 * (SELECT count(*) FROM gt WHERE cls = 0) AS feasible FROM {n}_s)"""


_PICK = "ORDER BY objective DESC, t0 + t1 + t2 DESC, t0 DESC, t1 DESC, t2 DESC LIMIT 1"
_FINE = "(SELECT unnest([30, 40, 50, 60, 70]) AS f)"


@query(X.WITH + f""", over_ AS MATERIALIZED (SELECT a.stem, b.gt_index AS gi, a.det_index AS di, {X.IOU} AS v FROM det a JOIN gt b ON a.stem = b.stem), best_ AS MATERIALIZED (SELECT stem, di, max(v) AS v FROM over_ GROUP BY ALL),
v1 AS (SELECT a.f AS t0, b.f AS t1, c.f AS t2 FROM (SELECT unnest([30, 60]) AS f) a, (SELECT unnest([30, 60]) AS f) b, (SELECT unnest([30, 60]) AS f) c)""" + _judged("p1", "v1") + f""",
b1 AS (SELECT * FROM p1 WHERE feasible {_PICK}),
v2 AS (SELECT a.f AS t0, b.f AS t1, c.f AS t2 FROM b1, {_FINE} a, {_FINE} b, {_FINE} c WHERE abs(a.f - b1.t0) <= 30 AND abs(b.f - b1.t1) <= 30 AND abs(c.f - b1.t2) <= 30 EXCEPT SELECT * FROM v1)""" + _judged("p2", "v2") + f""",
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), chosen AS (SELECT t0, t1, t2 FROM p WHERE feasible {_PICK})
SELECT p.* REPLACE (p.t0::DOUBLE AS t0, p.t1::DOUBLE AS t1, p.t2::DOUBLE AS t2, round(objective, 9) AS objective), (p.t0, p.t1, p.t2) = (SELECT (t0, t1, t2) FROM chosen) AS chosen FROM p""")
def sweep_search(s, d):
    """Per-class thresholds, a coarse grid refined around its best feasible point; every point's sums, and which is chosen."""
    stored = W.scenes(X.det(s, d), X.gt(s, d)).persist()
    m = W.metrics(3) | {"clear.share": F.col("clear") / F.greatest("kept", F.lit(1))}
    goal, allowed = H.expression("people.f1 - 0.1*clear.share", m), H.expression("crowd.precision >= 0.5 and people.recall_0 >= 0.2", m)
    points = W.coarse_to_fine(stored, H.grid(30, 60, 30), H.grid(30, 70, 10), 3, goal, allowed)
    best = H.pick_best(points, "objective", "feasible", ["t0", "t1", "t2"]).select("t0", "t1", "t2", F.lit(True).alias("chosen"))
    out = points.join(F.broadcast(best), ["t0", "t1", "t2"], "left")  # one row
    return out.select("t0", "t1", "t2", "kept", "matched", "correct", "dup", "partial", "clear", "right_0", F.round("objective", 9).alias("objective"), "feasible", F.coalesce("chosen", F.lit(False)).alias("chosen"))


_K = "(props::JSON ->> '$.k')::INT"


@query(f"""WITH e AS (SELECT event_id, event_id % 10 AS c, {_K} AS k FROM events)
SELECT event_id, CASE WHEN c = 2 THEN k + 1 WHEN c IN (3, 4, 5, 6, 7) THEN k END AS first_k, CASE WHEN c IN (6, 7) THEN k END AS second_k,
CASE WHEN c = 6 THEN 'yes' WHEN c = 7 THEN 'real_person' END AS verdict, CASE WHEN c = 6 THEN 'woman' WHEN c = 7 THEN 'unknown' END AS gender, CASE WHEN c = 7 THEN k::DOUBLE END AS age FROM e""")
def answers(s, d):
    """Answers without an object, cut off, corrected, nested, fenced, with trailing commas and keys without a value."""
    k = F.get_json_object("props", "$.k").cast("int")
    of = lambda f, *parts: F.format_string(f, *parts)
    c = F.col("event_id") % 10
    text = (
        F.when(c == 0, "no object at all").when(c == 1, "").when(c == 2, of('{"a": {"b": %s}} wait {"a": {"b": %s}}', k, k + 1)).when(c == 3, of('{"box": [1, 2], "label": "k": %s, }', k))
        .when(c == 4, of('think {not json {"k": %s}}', k)).when(c == 5, of('He said "{" and {"note": "}", "k": %s} end', k)).when(c == 6, of('{"k": 1} and {"verdict": " Yes ", "gender": "WOMAN", "k": %s}', k))
        .when(c == 7, of('{"verdict": "Real_Person", "estimated_age": "%s", "k": %s} done', k, k)).when(c == 8, of('{"verdict": "a", "estimated_age": "%s"', k))
    )
    e = load(s, d, "events").select("event_id", text.alias("t"))
    first = T.whole_or_last(F.col("t"))
    v = T.verdict(F.col("t"))
    return e.select("event_id", F.coalesce(F.get_json_object(first, "$.a.b"), F.get_json_object(first, "$.k")).cast("int").alias("first_k"), F.get_json_object(T.last_flat_object(F.col("t")), "$.k").cast("int").alias("second_k"), v["verdict"].alias("verdict"), v["gender"].alias("gender"), v["estimated_age"].alias("age"))


_RUNS = ["conf >= 30", "conf < 70", "conf % 2 = 0"]


@query(X.WITH + "".join(f", d{k} AS (SELECT * FROM det WHERE {r})" for k, r in enumerate(_RUNS)) + "".join(X.greedy_sql(f"m{k}", 0.5, det=f"d{k}") for k in range(3)) + ", " + ", ".join(f"f{k} AS (SELECT m.stem, m.gi, d.cls, m.v FROM m{k} m JOIN d{k} d ON d.stem = m.stem AND d.det_index = m.di), p{k} AS (SELECT * FROM d{k} a WHERE NOT EXISTS (SELECT 1 FROM gt b WHERE b.stem = a.stem AND {X.IOU} >= 0.5))" for k in range(3)) + " " + " UNION ALL ".join(f"""SELECT {i} AS a, {j} AS b, sum((x.v IS NOT NULL AND y.v IS NOT NULL)::INT)::BIGINT AS both, sum((x.v IS NOT NULL AND y.v IS NULL)::INT)::BIGINT AS only_a, sum((x.v IS NULL AND y.v IS NOT NULL)::INT)::BIGINT AS only_b, sum((x.v IS NULL AND y.v IS NULL)::INT)::BIGINT AS neither,
  coalesce(sum((x.cls = y.cls)::INT), 0)::BIGINT AS same_class, coalesce(sum((x.cls <> y.cls)::INT), 0)::BIGINT AS flips, round(avg(y.v - x.v), 9) AS iou_shift,
  (SELECT count(*) FROM (SELECT DISTINCT a.stem, a.det_index FROM p{i} a JOIN p{j} b ON a.stem = b.stem WHERE {X.IOU} >= 0.5)) AS shared_false, (SELECT count(*) FROM p{j} a WHERE NOT EXISTS (SELECT 1 FROM d{i} b WHERE b.stem = a.stem AND {X.IOU} >= 0.5)) AS new_false
  FROM gt LEFT JOIN f{i} x ON x.stem = gt.stem AND x.gi = gt.gt_index LEFT JOIN f{j} y ON y.stem = gt.stem AND y.gi = gt.gt_index""" for i, j in ((0, 1), (0, 2), (1, 2))))
def agreement(s, d):
    """Three runs over one GT, pair by pair: who found what, class flips, shift of IoU, false positives of a that b shares, and those of b where a has nothing."""
    return S.agreement(X.det(s, d), X.gt(s, d), [F.expr(r) for r in _RUNS]).withColumn("iou_shift", F.round("iou_shift", 9))


@query(X.WITH + f""", c AS (SELECT stem, det_index, cy * 100 + unnest(range(x1 + (cy - y1) % 3, x2 - CASE WHEN (cy - y1) % 4 = 1 THEN 6 ELSE 0 END)) AS p FROM (SELECT *, unnest(range(y1, y2)) AS cy FROM det WHERE stem % 4 = 1) q),
n AS (SELECT stem, det_index, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT x.stem, x.det_index AS i, y.det_index AS j, count(*) AS common FROM c x JOIN c y ON x.stem = y.stem AND x.p = y.p AND x.det_index < y.det_index GROUP BY ALL)
SELECT b.stem, i, j, common, round(common::DOUBLE / (p.n + q.n - common), 9) AS iou FROM b JOIN n p ON p.stem = b.stem AND p.det_index = i JOIN n q ON q.stem = b.stem AND q.det_index = j""".replace("WHERE stem % 4 = 1", ""))
def mask_overlap(s, d):
    """Pixels that two jagged masks of an image share, and their overlap. The oracle counts pixels."""
    masks = X.det(s, d, dealt=True).select("stem", "det_index", "x1", "y1", "x2", "y2")
    return K.overlaps(masks, 100, draw=X.jagged).withColumn("iou", F.round("iou", 9))

"""Report queries: end-to-end rates, occlusion, gates, ages, censuses, edge errors, replay checks, deployment by cells, and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtide.functions import classify as C
from boxtide.functions import geometry as G
from boxtide.functions import rates as R
from boxtide.operators import deployment as P
from boxtide.operators import matching as M
from boxtide.operators import quality as Q
from boxtide.operators import reports as O
from boxtide.operators import sampling as S
from boxtide.operators import search as H
from boxtide.operators import side_by_side as N
from boxtide.plans import fixtures as X
from boxtide.plans import tables as B
from boxtide.plans.fixtures import load

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _rates_sql(parts: dict[str, tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, coalesce(sum((({of}) AND coalesce({hit}, false))::INT), 0)::BIGINT AS k, coalesce(sum(coalesce({of}, false)::INT), 0)::BIGINT AS n, CASE WHEN sum(coalesce({of}, false)::INT) > 0 THEN sum((({of}) AND coalesce({hit}, false))::INT)::DOUBLE / sum(coalesce({of}, false)::INT) ELSE 0 END AS rate FROM {source}" for m, (hit, of) in parts.items())


_NAMES, _BANDS = ["woman", "man", "child"], ["small", "med", "large"]
_E2E = {"det_recall": ("said IS NOT NULL", "true"), "acc3": ("said = cls", "said IS NOT NULL"), "gender_acc_adults": ("said = cls", "said IS NOT NULL AND cls < 2"), "leak_adult20_child": ("said = 2", "said IS NOT NULL AND age >= 20")}
for _i, _n in enumerate(_NAMES):
    _E2E |= {f"det_recall_{_n}": ("said IS NOT NULL", f"cls = {_i}"), f"{_n}_recall_e2e": ("said = cls", f"cls = {_i}"), f"{_n}_precision_matched": ("said = cls", f"said = {_i}")}
for _b in _BANDS:
    _E2E |= {f"det_recall_{_b}": ("said IS NOT NULL", f"band = '{_b}'"), f"woman_recall_e2e_{_b}": ("said = cls", f"band = '{_b}' AND cls = 0")}


@query(X.WITH + ", kd AS (SELECT * FROM det WHERE conf >= 45)" + X.greedy_sql("m", 0.5, det="kd") + ", j AS (SELECT gt.cls, d.cls AS said, (gt.stem * 7 + gt.gt_index * 13) % 60 AS age, CASE WHEN gt.y2 - gt.y1 < 29 THEN 'small' WHEN gt.y2 - gt.y1 < 33 THEN 'med' ELSE 'large' END AS band FROM gt LEFT JOIN m ON m.stem = gt.stem AND m.gi = gt.gt_index LEFT JOIN det d ON d.stem = m.stem AND d.det_index = m.di) " + _rates_sql(_E2E, "j"))
def end_to_end(s, d):
    """Detection and end-to-end recalls, precision of the matched, adults written as children, by class and height."""
    det, gt = X.det(s, d).filter("conf >= 45"), X.gt(s, d)
    band = C.band_of(F.col("y2") - F.col("y1"), [(0, 29, "small"), (29, 33, "med"), (33, 10**9, "large")])
    people = gt.select("stem", "gt_index", "cls", ((F.col("stem") * 7 + F.col("gt_index") * 13) % 60).alias("age"), band.alias("band"))
    return O.end_to_end(people, det, M.match_greedy(M.pairs(det, gt, 0.5)), _NAMES, _BANDS)


_OCC = {"recall": ("hit", "true")} | {f"recall_{b}": ("hit", f"occ = '{b}'") for b in ("light", "partial", "heavy")}


@query(X.WITH + f", gone AS (SELECT DISTINCT a.stem, a.det_index FROM det a JOIN ign b ON a.stem = b.stem WHERE {X.IOA} > 0.5), kept AS (SELECT det.* FROM det ANTI JOIN gone USING (stem, det_index))" + X.greedy_sql("m", 0.5, det="kept") + ", j AS (SELECT m.gi IS NOT NULL AS hit, CASE WHEN g.vis >= 70 THEN 'light' WHEN g.vis >= 30 THEN 'partial' ELSE 'heavy' END AS occ FROM (SELECT *, (stem * 3 + gt_index * 29) % 101 AS vis FROM gt) g LEFT JOIN m ON m.stem = g.stem AND m.gi = g.gt_index) " + _rates_sql(_OCC, "j"))
def crowd_by_occlusion(s, d):
    """Recall of a crowd by how much of each person is visible, ignore regions first."""
    det, gt = X.det(s, d), X.gt(s, d)
    kept = det.join(M.inside_ignore(det, X.ignore(s, d), 0.5), ["stem", "det_index"], "left_anti")
    hit = M.match_greedy(M.pairs(kept, gt, 0.5)).select("stem", "gt_index", F.lit(True).alias("hit"))
    people = gt.select("stem", "gt_index", C.occlusion((F.col("stem") * 3 + F.col("gt_index") * 29) % 101, 70, 30).alias("occ")).join(hit, ["stem", "gt_index"], "left")
    return O.named_rates(people, {"recall": (F.col("hit"), F.lit(True))} | {f"recall_{b}": (F.col("hit"), F.col("occ") == b) for b in ("light", "partial", "heavy")})


@query(X.WITH + X.greedy_sql("m", 0.5) + """, c AS (SELECT CASE WHEN m.di IS NULL THEN 'reject' ELSE 'keep' END AS expect, det.cls, CASE (det.stem + det.det_index) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'not_person' WHEN 2 THEN 'not_person' WHEN 3 THEN 'depiction' ELSE 'real_person' END AS v FROM det LEFT JOIN m ON m.stem = det.stem AND m.di = det.det_index),
b AS (SELECT expect, unnest(['all', cls::VARCHAR]) AS cls, v FROM c), s AS (SELECT expect, cls, count(*) AS crops, sum(coalesce(v IN ('real_person', 'depiction'), false)::INT)::BIGINT AS kept, sum(coalesce(v = 'not_person', false)::INT)::BIGINT AS rejected, sum((v IS NULL)::INT)::BIGINT AS parse_fail FROM b GROUP BY ALL)
SELECT *, round(100.0::DOUBLE * CASE WHEN expect = 'reject' THEN rejected ELSE kept END / crops, 1) AS rate_pct FROM s""")
def gate(s, d):
    """What a gate keeps of verified people and kills of verified false positives, by class."""
    det = X.det(s, d)
    hit = M.match_greedy(M.pairs(det, X.gt(s, d), 0.5)).select("stem", "det_index", F.lit(True).alias("hit"))
    k = (F.col("stem") + F.col("det_index")) % 7
    crops = det.join(hit, ["stem", "det_index"], "left").select(F.when(F.col("hit"), "keep").otherwise("reject").alias("expect"), "cls", F.when(k == 0, None).when(k < 3, "not_person").when(k == 3, "depiction").otherwise("real_person").alias("verdict"))
    return O.gate(crops)


_G, _A = "CASE gender WHEN 'woman' THEN 0 WHEN 'man' THEN 1 ELSE 2 END", "CASE WHEN estimated_age BETWEEN 13 AND 17 THEN 5 WHEN age_group NOT IN ('child', 'adult') THEN 5 WHEN age_group = 'child' AND (estimated_age IS NULL OR estimated_age <= 12) THEN 4 ELSE 3 END"


@query(f"""WITH x AS (SELECT verdict IN ('real_person', 'depiction') AS p, {_G} AS g, {_A} AS a, CASE WHEN estimated_age BETWEEN 13 AND 17 THEN 'teen_band' ELSE 'age_group_unknown' END AS why, floor(estimated_age / 5)::INT * 5 AS bin FROM {B._V} v),
l AS (SELECT 'verdicts' AS stat FROM x UNION ALL SELECT CASE WHEN p THEN 'people' ELSE 'not_person' END FROM x UNION ALL SELECT 'gender_' || g FROM x WHERE p UNION ALL SELECT 'age_' || a FROM x WHERE p UNION ALL SELECT 'why_' || why FROM x WHERE p AND a = 5
  UNION ALL SELECT CASE WHEN g = 2 THEN 'child_gender_unknown' ELSE 'child_gender_known' END FROM x WHERE p AND a = 4 UNION ALL SELECT 'from_' || bin FROM x WHERE p AND bin IS NOT NULL)
SELECT stat, count(*) AS n FROM l GROUP BY 1""")
def age_counts(s, d):
    """People on the two axes, and why an age is unknown."""
    return O.age_counts(B.verdicts(s, d))


_LOST = "p AND f = 'Unknown'"


@query(f"""WITH x AS (SELECT verdict IN ('real_person', 'depiction') AS p, estimated_age AS y, age_group = 'child' AS c, CASE WHEN age_group = 'child' AND (estimated_age IS NULL OR estimated_age <= 12) THEN 'Child' WHEN gender = 'man' THEN 'Man' WHEN gender = 'woman' THEN 'Woman' ELSE 'Unknown' END AS f FROM {B._V} v)
""" + " UNION ALL ".join(f"SELECT '{k}' AS stat, sum(coalesce({t}, false)::INT)::BIGINT AS n FROM x" for k, t in {
    "verdicts": "true", "not_person": "NOT p", "people": "p", "dropped_unknown": _LOST, "rescuable_child": f"{_LOST} AND y <= 12", "dropped_teen": f"{_LOST} AND y > 12 AND y <= 17", "dropped_teen_grp_child": f"{_LOST} AND y > 12 AND y <= 17 AND c", "dropped_adult": f"{_LOST} AND y > 17",
    "dropped_age_none": f"{_LOST} AND y IS NULL", "dropped_age_none_grp_child": f"{_LOST} AND y IS NULL AND c", "kept_adult_but_young": "p AND f IN ('Man', 'Woman') AND y <= 12", "kept_adult_but_young_grp_child": "p AND f IN ('Man', 'Woman') AND y <= 12 AND c"}.items()))
def rescue_census(s, d):
    """A32."""
    return O.rescue_census(B.verdicts(s, d))


@query(X.WITH + X.greedy_sql("m", 0.5) + """, e AS (SELECT CASE WHEN d.x2 - d.x1 < 32 THEN 'small' ELSE 'large' END AS bucket, unnest([d.x1 - g.x1, d.y1 - g.y1, d.x2 - g.x2, d.y2 - g.y2]) AS e FROM m JOIN det d ON d.stem = m.stem AND d.det_index = m.di JOIN gt g ON g.stem = m.stem AND g.gt_index = m.gi)
SELECT bucket, count(*) AS edges, round(avg(abs(e)), 9) AS mean_abs, round(avg((abs(e / 2.0 - round_even(e / 2.0, 0)) * 2.0 <= 0.25)::INT), 9) AS on_grid, round(avg((abs((e + 1) / 2.0 - round_even((e + 1) / 2.0, 0)) * 2.0 <= 0.25)::INT), 9) AS null_grid FROM e GROUP BY 1""")
def edge_errors(s, d):
    """Edges of matched boxes against multiples of two pixels."""
    cand = M.pairs(X.det(s, d), X.gt(s, d), 0.5)
    won = M.match_greedy(cand).select("stem", F.col("gt_index").alias("g_gt_index"), F.col("det_index").alias("d_det_index"))
    out = O.edge_errors(cand.join(won, ["stem", "g_gt_index", "d_det_index"]), F.when(F.col("d_x2") - F.col("d_x1") < 32, "small").otherwise("large"), 2.0, 0.25)
    return out.select("bucket", "edges", *[F.round(c, 9).alias(c) for c in ("mean_abs", "on_grid", "null_grid")])


@query(X.WITH + f", b AS (SELECT a.stem, a.det_index, max({X.IOU}) AS v FROM det a JOIN gt b ON a.stem = b.stem GROUP BY ALL) SELECT least(floor(v * 10)::INT, 9) AS decile, count(*) AS n FROM b WHERE v > 0 GROUP BY 1")
def iou_deciles(s, d):
    """How well detections lie over their best GT."""
    best = M.best_overlap(X.det(s, d), X.gt(s, d), 1e-9)
    return best.groupBy(F.least(F.floor(F.col("iou") * 10), F.lit(9)).cast("int").alias("decile")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag AS grp, 'p10' AS place, NULL AS price, NULL AS qty WHERE false UNION ALL SELECT grp, place, max(price) AS price, max(qty) AS qty FROM (
SELECT l_returnflag AS grp, p AS place, CASE WHEN row_number() OVER (PARTITION BY l_returnflag, p ORDER BY l_extendedprice) - 1 = floor(q * (count(*) OVER (PARTITION BY l_returnflag, p) - 1)) THEN l_extendedprice END AS price,
  CASE WHEN row_number() OVER (PARTITION BY l_returnflag, p ORDER BY l_quantity) - 1 = floor(q * (count(*) OVER (PARTITION BY l_returnflag, p) - 1)) THEN l_quantity END AS qty FROM lineitem, (VALUES ('p10', 0.1::DOUBLE), ('p50', 0.5::DOUBLE), ('p90', 0.9::DOUBLE)) v(p, q)) GROUP BY ALL""".replace("SELECT l_returnflag AS grp, 'p10' AS place, NULL AS price, NULL AS qty WHERE false UNION ALL ", ""))
def anatomy_quantiles(s, d):
    """Quantiles of two measures by group, each selected in one pass for all places."""
    li = load(s, d, "lineitem").withColumnRenamed("l_returnflag", "grp")
    places = {f"p{p}": (p, "floor_n1") for p in (10, 50, 90)}
    one = lambda c, name: R.percentiles(li, ["grp"], c, places).withColumnsRenamed({"value": name, "name": "place"})
    return one("l_extendedprice", "price").join(one("l_quantity", "qty"), ["grp", "place"])


_MODELS = {"a": "conf >= 30", "b": "conf < 70"}
_SCALES = (1.0, 0.5)


def _kept(model: str, scale: float) -> str:
    return f"{_MODELS[model]} AND (y2 - y1) * {scale} >= 14"


@query(X.WITH + "".join(f", d{m}{int(c * 10)} AS (SELECT * FROM det WHERE {_kept(m, c)})" + X.greedy_sql(f"m{m}{int(c * 10)}", 0.3, det=f"d{m}{int(c * 10)}") for m in _MODELS for c in _SCALES) + " " + " UNION ALL ".join(f"SELECT '{m}' AS model, {c}::DOUBLE AS scale, (SELECT count(*) FROM gt) AS n_gt, round(count(*)::DOUBLE / (SELECT count(*) FROM gt), 4) AS recall, round(sum((d.cls = g.cls)::INT)::DOUBLE / count(*), 4) AS class_acc FROM m{m}{int(c * 10)} x JOIN det d ON d.stem = x.stem AND d.det_index = x.di JOIN gt g ON g.stem = x.stem AND g.gt_index = x.gi" for m in _MODELS for c in _SCALES))
def scale_rates(s, d):
    """Two models on images shrunk by two scales, boxes of both sides rescaled with the image."""
    return N.scale_rates(X.det(s, d), X.gt(s, d), [(m, c, F.expr(_kept(m, c))) for m in _MODELS for c in _SCALES], 0.3)


@query(X.WITH + """, lg AS (SELECT stem, cls, conf / 100.0::DOUBLE AS conf FROM det), em AS (SELECT stem, CASE WHEN stem % 11 = 0 AND det_index = 0 THEN (cls + 1) % 3 ELSE cls END AS cls FROM det WHERE conf >= 50 AND NOT (conf = 50 AND stem % 3 = 0) AND stem % 13 <> 0),
has AS (SELECT DISTINCT stem FROM det WHERE stem % 13 <> 0), r AS (SELECT stem, coalesce(list(cls ORDER BY cls) FILTER (conf >= 0.5), []) AS c, max((abs(conf - 0.5) <= 0.0001)::INT) AS near FROM lg GROUP BY 1), e AS (SELECT stem, list(cls ORDER BY cls) AS c FROM em GROUP BY 1)
SELECT r.stem, has.stem IS NOT NULL AS labels, has.stem IS NOT NULL AND r.c <> coalesce(e.c, []) AS mismatch, has.stem IS NOT NULL AND r.c <> coalesce(e.c, []) AND len(r.c) <> len(coalesce(e.c, [])) AND near = 1 AS at_the_cut FROM r LEFT JOIN e USING (stem) LEFT JOIN has ON has.stem = r.stem""")
def replay_check(s, d):
    """Labels as emitted against what the log gives at the thresholds; files that are missing, differ, or differ by rounding at the cut."""
    det = X.det(s, d)
    some = det.filter("stem % 13 <> 0")
    out = some.filter("conf >= 50 AND NOT (conf = 50 AND stem % 3 = 0)").select("stem", F.when((F.col("stem") % 11 == 0) & (F.col("det_index") == 0), (F.col("cls") + 1) % 3).otherwise(F.col("cls")).cast("int").alias("cls"))
    files = some.select("stem").distinct().select("stem", F.lit(None).cast("int").alias("cls"))  # every file is there, if only empty
    return Q.replay(det.select("stem", "cls", (F.col("conf") / 100.0).alias("conf")), out.unionByName(files), [0.5, 0.5, 0.5])


_CELL = "SELECT DISTINCT stem, cx, cy FROM (SELECT stem, unnest(range(greatest(x1, 0), least(x2, 64))) AS cx, greatest(y1, 0) AS y1, least(y2, 96) AS y2 FROM {0}) q, range(0, 96) t(cy) WHERE cy >= q.y1 AND cy < q.y2"


@query(X.WITH + f""", im AS (SELECT o_orderkey AS stem FROM orders), bl AS (SELECT * FROM det WHERE cls = 0 AND conf >= 45), pe AS (SELECT * FROM gt WHERE cls IN (0, 2)), al AS (SELECT stem, x1, y1, x2, y2 FROM gt WHERE cls = 0 UNION ALL SELECT * FROM ign),
pc AS (SELECT p.stem, p.gt_index, cx, cy FROM (SELECT *, unnest(range(x1, x2)) AS cx FROM pe) p, range(-10, 120) t(cy) WHERE cy >= p.y1 AND cy < p.y2),
cov AS (SELECT c.stem, c.gt_index, count(*) AS n FROM pc c WHERE EXISTS (SELECT 1 FROM bl b WHERE b.stem = c.stem AND c.cx >= b.x1 AND c.cx < b.x2 AND c.cy >= b.y1 AND c.cy < b.y2) GROUP BY ALL),
p AS (SELECT pe.stem, pe.cls, coalesce(n, 0)::DOUBLE / ((x2 - x1) * (y2 - y1)) AS cv, ((x2 - x1) * (y2 - y1)) / 6144.0::DOUBLE AS a FROM pe LEFT JOIN cov USING (stem, gt_index)),
per AS (SELECT stem, sum(CASE WHEN cls = 0 THEN (1 - cv) * a ELSE 0 END) AS exposure, sum((cls = 0)::INT) AS nt, sum((cls = 2)::INT) AS nc, max((cls = 2 AND cv > 0.2)::INT) AS hit, sum(CASE WHEN cls = 0 THEN 1 - cv END) AS us, sum((cls = 0 AND 1 - cv <= 0.1)::INT) AS c90, sum(CASE WHEN cls = 2 THEN cv END) AS cs FROM p GROUP BY 1),
bc AS ({_CELL.format("bl")}), ac AS ({_CELL.format("al")}), wr AS (SELECT stem, count(*) AS n FROM bc ANTI JOIN ac USING (stem, cx, cy) GROUP BY 1),
xc AS (SELECT b.stem, b.det_index, cx, cy, (b.x2 - b.x1) * (b.y2 - b.y1) AS a FROM (SELECT *, unnest(range(x1, x2)) AS cx FROM bl) b, range(-10, 130) t(cy) WHERE cy >= b.y1 AND cy < b.y2),
ins AS (SELECT stem, det_index, any_value(a) AS a, sum((EXISTS (SELECT 1 FROM al WHERE al.stem = xc.stem AND xc.cx >= al.x1 AND xc.cx < al.x2 AND xc.cy >= al.y1 AND xc.cy < al.y2))::INT) AS n FROM xc GROUP BY ALL), fp AS (SELECT stem, count(*) AS n FROM ins WHERE n < 0.5 * a GROUP BY 1),
r AS (SELECT im.stem, coalesce(exposure, 0) AS exposure, CASE WHEN nt > 0 THEN exposure <= 0.005 END AS m1, coalesce(wr.n, 0) / 6144.0::DOUBLE AS wf, coalesce(fp.n, 0) AS fp, CASE WHEN nc > 0 THEN hit = 0 END AS cp, coalesce(nt, 0) AS nt, coalesce(nc, 0) AS nc, us, c90, cs, im.stem % 5 = 0 AS teen FROM im LEFT JOIN per USING (stem) LEFT JOIN wr USING (stem) LEFT JOIN fp USING (stem)),
l AS (SELECT r.*, unnest(CASE WHEN teen THEN ['all', 'm' || (stem % 3), 'teen_band'] ELSE ['all', 'm' || (stem % 3)] END) AS tag FROM r), q AS (SELECT tag, exposure, row_number() OVER (PARTITION BY tag ORDER BY exposure) - 1 AS i, count(*) OVER (PARTITION BY tag) AS n FROM l WHERE m1 IS NOT NULL),
g AS (SELECT tag, count(*) AS n_images, count(m1) AS n_target_images, avg(m1::INT) AS m1_pass_rate, avg(CASE WHEN m1 IS NOT NULL THEN exposure END) AS mean_exposure, avg((wf > 0.01)::INT) AS falseblur_img_rate, avg(wf) AS fb_area_mean, sum(fp) * 100.0 / count(*) AS fp_boxes_per_100,
  count(CASE WHEN NOT teen THEN cp END) AS n_child_images, avg(CASE WHEN NOT teen THEN cp::INT END) AS child_clarity, sum(nt)::BIGINT AS n_persons, sum(us) / nullif(sum(nt), 0) AS person_uncov_mean, sum(c90)::DOUBLE / nullif(sum(nt), 0) AS person_covered90_rate, sum(CASE WHEN NOT teen THEN cs END) / nullif(sum(CASE WHEN NOT teen THEN nc ELSE 0 END), 0) AS child_blur_mean FROM l GROUP BY 1)
SELECT tag, n_images, n_target_images, round(m1_pass_rate, 9) AS m1_pass_rate, round(mean_exposure, 9) AS mean_exposure, round(falseblur_img_rate, 9) AS falseblur_img_rate, round(fb_area_mean, 9) AS fb_area_mean, round(fp_boxes_per_100, 9) AS fp_boxes_per_100, n_child_images, round(child_clarity, 9) AS child_clarity, n_persons, round(person_uncov_mean, 9) AS person_uncov_mean, round(person_covered90_rate, 9) AS person_covered90_rate, round(child_blur_mean, 9) AS child_blur_mean,
  round(p90, 9) AS exposure_p90 FROM g LEFT JOIN (SELECT tag, max(CASE WHEN i = floor(0.9::DOUBLE * (n - 1)) THEN exposure END) AS p90 FROM q GROUP BY 1) USING (tag)""")
def deployment_slices(s, d):
    """What a blur policy without a margin leaves visible or hides wrongly, by slice, with the measures by person. The oracle counts pixels."""
    im = X.images(s, d)
    r = P.image_metrics(im, X.gt(s, d), X.ignore(s, d), X.det(s, d), 0, 2, 45, dilate=0.0)
    tags = im.select("stem", F.explode(F.array_compact(F.array(F.concat(F.lit("m"), (F.col("stem") % 3).cast("string")), F.when(F.col("stem") % 5 == 0, "teen_band")))).alias("tag"))
    out = P.by_slice(r, tags)
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(X.WITH + f""", im AS (SELECT count(*) AS n FROM orders), w AS (SELECT * FROM det d WHERE cls = 0 AND NOT EXISTS (SELECT 1 FROM gt b, (SELECT d.x1, d.y1, d.x2, d.y2) a WHERE b.stem = d.stem AND b.cls = 0 AND {X.IOU} >= 0.5)), c AS (SELECT unnest([20, 50, 80]) AS cut),
px AS (SELECT DISTINCT cut, stem, cx, cy FROM (SELECT c.cut, w.*, unnest(range(x1, x2)) AS cx FROM w, c WHERE w.conf >= c.cut) q, range(-10, 120) t(cy) WHERE cy >= q.y1 AND cy < q.y2)
SELECT c.cut, round(coalesce((SELECT count(*) FROM px WHERE px.cut = c.cut), 0) / 6144.0::DOUBLE / im.n, 9) AS wrong_area_mean FROM c, im""")
def wrong_area_pixels(s, d):
    """The share of an image that wrong boxes cover, by threshold. The oracle counts pixels."""
    out = P.wrong_area_curve(X.images(s, d), X.gt(s, d), X.det(s, d), 0, s.createDataFrame([(20,), (50,), (80,)], "cut int"))
    return out.withColumn("wrong_area_mean", F.round("wrong_area_mean", 9))


@query(f"SELECT id, CASE WHEN lower(trim(raw)) IN ('infant','toddler','child','preteen','teenager','young_adult','adult','middle_aged','elderly','senior') THEN lower(trim(raw)) ELSE 'unknown' END AS band FROM (SELECT id, CASE id % 4 WHEN 0 THEN ' ' || upper({B._BAND}) || ' ' WHEN 1 THEN {B._BAND} WHEN 2 THEN 'grown up' ELSE NULL END AS raw FROM {B._P} p)")
def band_names(s, d):
    """Names of bands as answers have them."""
    p = B.people(s, d)
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" "), F.upper("band"), F.lit(" "))).when(F.col("id") % 4 == 1, F.col("band")).when(F.col("id") % 4 == 2, "grown up")
    return p.select("id", C.band_name(raw).alias("band"))


@query(X.WITH + """, v AS (SELECT stem, CASE WHEN stem % 2 = 0 THEN [y1, x1, y2, x2] ELSE [x1, y1, x2, y2] END AS b FROM det), c AS (SELECT stem, sum((b[3] - b[1] > b[4] - b[2])::INT) AS ty, sum((b[4] - b[2] > b[3] - b[1])::INT) AS tx FROM v GROUP BY 1) SELECT stem, CASE WHEN ty >= tx THEN 'yxyx' ELSE 'xyxy' END AS axis FROM c""")
def axis_orders(s, d):
    """In which order a record's boxes have their sides."""
    v = F.when(F.col("stem") % 2 == 0, F.array("y1", "x1", "y2", "x2")).otherwise(F.array("x1", "y1", "x2", "y2"))
    return X.det(s, d).groupBy("stem").agg(F.collect_list(v).alias("b")).select("stem", G.axis_order(F.col("b")).alias("axis"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_mktsegment LIKE 'A%' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT 60""")
def reserve_split(s, d):
    """A seeded reserve among the keys of a prefix that shares nothing with what is held out; sampling takes 60."""
    c = load(s, d, "customer").filter(F.col("c_mktsegment").startswith("A")).select(F.col("c_custkey").alias("id"))
    held = load(s, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("id"))
    return S.reserve(c, held, "id", 60, 42)


@query(X.WITH + X.greedy_sql("m", 0.5) + """, j AS (SELECT g.stem, g.gt_index, g.cls AS label, d.cls AS said, d.conf FROM gt g LEFT JOIN m ON m.stem = g.stem AND m.gi = g.gt_index LEFT JOIN det d ON d.stem = m.stem AND d.det_index = m.di)
SELECT 'all' AS which, stem, gt_index FROM j UNION ALL SELECT 'misclassified', stem, gt_index FROM j WHERE said <> label UNION ALL SELECT 'high_conf_mismatch', stem, gt_index FROM j WHERE said <> label AND conf >= 70""")
def populations(s, d):
    """all boxes, the misclassified ones, and those of them said with confidence."""
    return O.populations(N.named(X.det(s, d), X.gt(s, d), 0.5), 70)


@query(f"""WITH p AS {B._PTS} SELECT id, round(rec - 2.0 * ((fp + t) / 2), 9) AS woman, round(-((fp + t) / 2), 9) AS least, rec AS f1 FROM p""")
def objectives(s, d):
    """Q2: the named objectives over the points of a sweep."""
    m = {"lagenda.woman_recall_e2e": F.col("rec"), "lagenda.woman_f1_e2e": F.col("rec"), "p.img_fp_rate": F.col("fp"), "q.img_fp_rate": F.col("t")}
    of = lambda name: H.expression(H.preset(name, ["p", "q"], 2.0), m)
    return B._points(s, d).select("id", F.round(of("woman_recall_vs_fp"), 9).alias("woman"), F.round(of("min_fp"), 9).alias("least"), of("woman_f1").alias("f1"))


@query(f"""WITH p AS {B._PTS}, u AS (SELECT *, sqrt(pow((1 - rec) / 0.5, 2) + pow(fp / 0.25, 2)) AS distance FROM p) SELECT brand, arg_min(id, (distance, -t, -id)) AS id, round(min(distance), 9) AS distance FROM u GROUP BY 1""")
def utopia_points(s, d):
    """Q9: per group the point nearest to no miss and no false alarm."""
    p = B._points(s, d).select("brand", "id", (F.col("t") + F.col("id") * 1e-9).alias("t"), (1 - F.col("rec")).alias("miss"), "fp", F.lit(0.5).alias("a"), F.lit(0.25).alias("b"))
    return H.utopia(p, [("miss", "a"), ("fp", "b")], "t", ["brand"]).select("brand", "id", F.round("distance", 9).alias("distance"))

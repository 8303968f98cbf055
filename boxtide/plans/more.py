"""Further queries over boxes: confidence separation, scale, census, area ranges, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtide.functions import classify as C
from boxtide.functions import rates as R
from boxtide.operators import detection as D
from boxtide.operators import matching as M
from boxtide.operators import side_by_side as S
from boxtide.plans import fixtures as X
from boxtide.scratch import stored

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_AREA = "(x2 - x1) * (y2 - y1)"


@query(X.WITH + X.greedy_sql("m", 0.5) + """, t AS (SELECT det.cls, m.gi IS NOT NULL AS tp, conf, row_number() OVER (PARTITION BY det.cls, m.gi IS NOT NULL ORDER BY conf) - 1 AS i, count(*) OVER (PARTITION BY det.cls, m.gi IS NOT NULL) AS n FROM det LEFT JOIN m ON det.stem = m.stem AND det.det_index = m.di)
SELECT cls, tp, any_value(n) AS n, round(avg(conf), 9) AS mean_conf, max(CASE WHEN i = n // 2 THEN conf END) AS middle FROM t GROUP BY ALL""")
def confidence_split(s, d):
    """Confidences of true and false positives by class."""
    t = stored(S.matches(X.det(s, d), X.gt(s, d), 0.5).select("cls", F.col("gt_index").isNotNull().alias("tp"), "conf"))  # read several times
    mid = R.percentile(t, ["cls", "tp"], "conf", 50, "upper_middle").withColumnRenamed("value", "middle")
    return t.groupBy("cls", "tp").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 9).alias("mean_conf")).join(mid, ["cls", "tp"])


@query(X.WITH + X.greedy_sql("m", 0.5) + f""", g AS (SELECT CASE WHEN {_AREA} >= 0 AND {_AREA} < 1000 THEN 'small' WHEN {_AREA} < 1300 THEN 'med' ELSE 'large' END AS size, (m.gi IS NOT NULL)::INT AS h FROM gt LEFT JOIN m ON gt.stem = m.stem AND gt.gt_index = m.gi)
SELECT size, sum(h)::BIGINT AS k, count(*) AS n, sum(h)::DOUBLE / count(*) AS rate FROM g GROUP BY 1""")
def recall_by_size(s, d):
    """Recall by size band."""
    bands = [(0, 1000, "small"), (1000, 1300, "med"), (1300, 10**9, "large")]
    gt = X.gt(s, d).withColumn("size", C.band_of((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), bands))
    return D.recall_by(M.match_greedy(M.pairs(X.det(s, d), X.gt(s, d), 0.5)), gt, ["size"]).select("size", "k", "n", "rate")


@query(X.WITH + """, h AS (SELECT stem, y2 - y1 AS h FROM det) SELECT cut, sum(anyb::INT)::BIGINT AS images_any, sum(allb::INT)::BIGINT AS images_all, sum(c)::BIGINT AS persons FROM (SELECT cut, stem, bool_or(h < cut) AS anyb, bool_and(h < cut) AS allb, sum((h < cut)::INT) AS c FROM h, (VALUES (28), (32), (36)) v(cut) GROUP BY ALL) GROUP BY cut""")
def census(s, d):
    """Images with any or only people under a height, and those people, by cutoff."""
    cuts = s.createDataFrame([(28,), (32,), (36,)], "cut int")
    per = X.det(s, d).join(F.broadcast(cuts), F.lit(True)).withColumn("b", (F.col("y2") - F.col("y1")) < F.col("cut")).groupBy("cut", "stem").agg(F.bool_or("b").alias("x"), F.bool_and("b").alias("y"), F.sum(F.col("b").cast("int")).alias("c"))
    return per.groupBy("cut").agg(F.sum(F.col("x").cast("int")).alias("images_any"), F.sum(F.col("y").cast("int")).alias("images_all"), F.sum("c").alias("persons"))


@query(X.WITH + " SELECT stem FROM det GROUP BY stem HAVING sum((y2 - y1 BETWEEN 24 AND 30)::INT) >= 2 AND sum((conf > 95)::INT) = 0")
def band_selection(s, d):
    """F2, F8: images with at least two people in a height band and no excluded one."""
    h = F.col("y2") - F.col("y1")
    return X.det(s, d).groupBy("stem").agg(F.sum(h.between(24, 30).cast("int")).alias("a"), F.sum((F.col("conf") > 95).cast("int")).alias("b")).filter("a >= 2 AND b = 0").select("stem")


@query(X.WITH + X.confident_sql("m", 0.5) + f""", r AS (SELECT det.cls, det.conf, (m.gi IS NOT NULL)::INT AS tp FROM det LEFT JOIN m ON det.stem = m.stem AND det.det_index = m.di LEFT JOIN gt ON gt.stem = m.stem AND gt.gt_index = m.gi
  WHERE CASE WHEN m.gi IS NOT NULL THEN (gt.x2 - gt.x1) * (gt.y2 - gt.y1) < 1100 ELSE (det.x2 - det.x1) * (det.y2 - det.y1) < 1100 END),
src AS (SELECT cls AS grp, conf, tp FROM r), grps AS (SELECT cls AS grp, count(*) AS n_gt FROM gt WHERE {_AREA} < 1100 GROUP BY 1),
r1 AS (SELECT *, row_number() OVER w AS rank, sum(tp) OVER w AS ctp FROM src WINDOW w AS (PARTITION BY grp ORDER BY conf DESC, tp DESC ROWS UNBOUNDED PRECEDING)),
r2 AS (SELECT *, max(ctp::DOUBLE / rank) OVER (PARTITION BY grp ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r1),
pts AS (SELECT g.grp, i, (SELECT env FROM r2 WHERE r2.grp = g.grp AND r2.ctp * 100 >= i * g.n_gt ORDER BY rank LIMIT 1) AS p FROM grps g, range(0, 101) t(i)) SELECT grp AS cls, round(sum(coalesce(p, 0)) / 101, 9) AS ap FROM pts GROUP BY grp""")
def ap_small(s, d):
    """AP of small people: a match with a larger one, or an unmatched larger detection, counts neither way."""
    det, gt = X.det(s, d), X.gt(s, d)
    size = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    m = S.matches(det, gt, 0.5, confident=True)
    rows = m.filter(F.coalesce("gt_area", "area") < 1100).select("cls", "conf", F.col("gt_index").isNotNull().cast("int").alias("tp"))
    return D.average_precision(rows, gt.filter(size("") < 1100).groupBy("cls").agg(F.count("*").alias("n_gt")), ["cls"]).select("cls", F.round("ap", 9).alias("ap"))


@query(X.WITH + ", t AS (SELECT stem, CASE WHEN conf > 90 THEN 4 WHEN conf > 70 THEN 3 WHEN conf > 40 THEN 2 ELSE 1 END AS k FROM det) SELECT stem, CASE max(k) WHEN 4 THEN 't4_high' WHEN 3 THEN 't3_revealing' WHEN 2 THEN 't2_ordinary' ELSE 't1_modest' END AS tag FROM t GROUP BY 1")
def image_tags(s, d):
    """An image's tag is the highest of its people's."""
    k = F.when(F.col("conf") > 90, 4).when(F.col("conf") > 70, 3).when(F.col("conf") > 40, 2).otherwise(1)
    name = F.element_at(F.array(*map(F.lit, ("t1_modest", "t2_ordinary", "t3_revealing", "t4_high"))), k)
    return X.det(s, d).groupBy("stem").agg(F.max(F.struct(k.alias("k"), name.alias("tag"))).alias("m")).select("stem", "m.tag")

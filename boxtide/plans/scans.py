"""Round trips of the text formats: each query writes text made from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtide.functions.images import image_size
from boxtide.operators.boundary import image_measures as measured
from boxtide.operators.quality import dedupe
from boxtide.plans.fixtures import load
from boxtide.scratch import scratch
from boxtide.sources import readers as R
from boxtide.sources import writers as W

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# A person per customer, in a file per nation: class, corners in 64ths, confidence, and the shape of its line.
_C = """SELECT c_custkey AS k, CAST(c_nationkey AS STRING) AS stem, CAST(c_custkey % 3 AS INT) AS cls, (c_custkey % 8) / 64.0D AS x1, (c_custkey % 64 - c_custkey % 8) / 512.0D AS y1,
  (c_custkey % 8 + 8 + 2 * (c_custkey % 9)) / 64.0D AS x2, ((c_custkey % 64 - c_custkey % 8) / 8 + 8 + 2 * (c_custkey % 5)) / 64.0D AS y2, (c_custkey % 100) / 100.0D AS conf, CAST(c_custkey % 7 AS INT) AS shape FROM {customer}"""
_SQL = "c AS (" + _C.replace("{customer}", "customer").replace("AS STRING", "AS VARCHAR").replace("64.0D", "64.0::DOUBLE").replace("512.0D", "512.0::DOUBLE").replace("100.0D", "100.0::DOUBLE") + ")"


def _people(s, d):
    return s.sql(_C, customer=load(s, d, "customer"))


def _label_folder(s, d):
    p = _people(s, d)
    box = W.label_line(F.col("cls"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    poly = F.format_string("%d %.6f %.6f %.6f %.6f %.6f %.6f", "cls", "x1", "y1", "x2", "y1", "x2", "y2")
    conf = F.format_string("%.2f", "conf")
    line = F.when(F.col("shape") == 0, box).when(F.col("shape") == 1, F.concat_ws(" ", box, conf)).when(F.col("shape") == 2, poly).when(F.col("shape") == 3, F.concat_ws(" ", poly, conf)).when(F.col("shape") == 4, "not a line").when(F.col("shape") == 5, "1 0.5").otherwise("")
    path = scratch(s)
    W.write_lines(p.select("stem", "k", line.alias("value")), path, "stem", ["k"])
    return path


_AT = ", n AS (SELECT *, (row_number() OVER (PARTITION BY stem ORDER BY k) - 1)::INT AS line_no FROM c)"


@query(f"""WITH {_SQL}{_AT} SELECT stem, line_no, cls, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, CASE WHEN shape IN (1, 3) THEN conf END AS conf, CASE WHEN shape IN (2, 3) THEN 3 END AS points,
shape = 1 AS six, shape IN (0, 2) AS bare, round(CASE WHEN shape < 2 THEN x1 ELSE x1 - (x2 - 0) / 2 END, 6) AS i_x1, round(CASE WHEN shape < 2 THEN y2 ELSE y1 + y1 / 2 END, 6) AS i_y2 FROM n WHERE shape < 4""")
def scan_labels(s, d):
    """Boxes and polygons with and without confidence, by the three rules for it, and the same lines as ignore regions."""
    t = R.label_tokens(s, _label_folder(s, d))
    key = ["stem", "line_no"]
    own = R.labels(t, "parity").select(*key, "cls", "x1", "y1", "x2", "y2", "conf", F.size("poly").alias("points"))
    six, bare = R.labels(t, "six").select(*key, F.lit(True).alias("six")), R.labels(t).select(*key, F.lit(True).alias("bare"))
    ign = R.ignore_regions(t).select(*key, F.round("x1", 6).alias("i_x1"), F.round("y2", 6).alias("i_y2"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    out = own.join(six, key, "left").join(bare, key, "left").join(ign, key, "left")
    return out.select(*key, "cls", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")], "conf", F.when(F.col("points") > 0, F.col("points")).alias("points"), no("six"), no("bare"), "i_x1", "i_y2")


@query(f"""WITH {_SQL}{_AT} SELECT k, 'p' || stem AS image, line_no AS box_index, (k % 80)::DOUBLE AS gt_age, round(x2, 6) AS x2 FROM n WHERE shape IN (0, 2)""")
def scan_manifest(s, d):
    """A manifest whose ids name the lines of label files, without the images of an exclusion list and those that have no file."""
    at = F.row_number().over(R.Window.partitionBy("stem").orderBy("k")) - 1
    p = _people(s, d).withColumn("n", at).filter("shape IN (0, 2)")
    own, wrong, out = scratch(s), scratch(s), scratch(s)
    man = p.select(F.to_json(F.struct(F.concat_ws("_", F.lit("p"), "stem", F.col("n").cast("string")).alias("id"), F.concat("stem", F.lit(".jpg")).alias("image"), (F.col("k") % 80).cast("double").alias("gt_age"), F.col("k").cast("string").alias("gt_gender"))).alias("value"))
    extra = p.select(F.to_json(F.struct(F.lit("q_0").alias("id"), F.concat(F.lit("no"), "stem", F.lit(".jpg")).alias("image"))).alias("value")).distinct()
    man.unionByName(extra.unionByName(extra.withColumn("value", F.regexp_replace("value", '"no', '"out')))).write.text(own)
    p.select(F.concat(F.lit("some/out"), "stem", F.lit(".jpg")).alias("value")).distinct().write.text(wrong)
    W.overwrite(R.manifest(s, own), out)
    labels = _label_folder(s, d)
    rows = s.read.parquet(out).join(R.stems(s, wrong), "stem", "left_anti").join(R.listing(s, labels).select("stem").distinct(), "stem", "left_semi")
    j = R.manifest_boxes(rows, R.labels(R.label_tokens(s, labels)))
    return j.select(F.col("gt_gender").cast("long").alias("k"), F.concat(F.lit("p"), "stem").alias("image"), "box_index", "gt_age", F.round("x2", 6).alias("x2"))


@query("""WITH e AS (SELECT event_id, event_id % 3 AS shard, event_id % 500 AS id FROM events WHERE event_id % 7 <> 2)
SELECT id, arg_min(event_id, (shard, event_id)) AS first_v, arg_max(event_id, (shard, event_id)) AS last_v, count(*) AS n FROM e GROUP BY id""")
def scan_records(s, d):
    """JSON lines of several files, some cut off in writing: first and last of each id by the files' order."""
    e = load(s, d, "events").select((F.col("event_id") % 3).alias("shard"), "event_id", F.to_json(F.struct((F.col("event_id") % 500).alias("id"), F.col("event_id").alias("v"))).alias("j"))
    path = scratch(s)
    W.write_lines(e.select("shard", "event_id", F.when(F.col("event_id") % 7 == 2, F.expr("left(j, length(j) - 3)")).otherwise(F.col("j")).alias("value")), path, "shard", ["event_id"])
    r = R.records(s, path, "id long, v long")
    order = [F.col(c) for c in R.PLACE]
    first, last = dedupe(r, ["id"], order).select("id", F.col("v").alias("first_v")), dedupe(r, ["id"], order, "last").select("id", F.col("v").alias("last_v"))
    return first.join(last, "id").join(r.groupBy("id").agg(F.count("*").alias("n")), "id")


@query(f"""WITH {_SQL}{_AT} SELECT stem, line_no AS det_index, cls, round(x1, 6) AS x1, round(y2, 6) AS y2, conf, false AS broken FROM n WHERE stem NOT IN ('3', '11') AND shape <> 6
UNION ALL SELECT DISTINCT stem, NULL, NULL, NULL, NULL, NULL, true FROM n WHERE stem IN ('3', '11')""")
def scan_sidecars(s, d):
    """Sidecars of detections in pixels, two of them cut off in writing; excluded detections are left out, broken files are named."""
    at = (F.row_number().over(R.Window.partitionBy("stem").orderBy("k")) - 1).cast("int")
    p = _people(s, d).withColumn("n", at)
    det = F.struct(F.col("n").alias("det_index"), "cls", F.array(F.col("x1") * 640, F.col("y1") * 320, F.col("x2") * 640, F.col("y2") * 320).alias("box_xyxy"), "conf", F.when(F.col("shape") == 6, "small").alias("excluded"))
    side = p.groupBy("stem").agg(F.sort_array(F.collect_list(det)).alias("detections")).select("stem", F.to_json(F.struct(F.concat("stem", F.lit(".jpg")).alias("image"), F.lit(640).alias("width"), F.lit(320).alias("height"), "detections"), {"pretty": "true"}).alias("j"))
    path = scratch(s)
    W.write_label_files(side.select("stem", F.when(F.col("stem").isin("3", "11"), F.expr("left(j, length(j) - 40)")).otherwise(F.col("j")).alias("text")), path)
    good, bad = R.sidecars(s, path, glob="*")
    rows = R.detections(good).select("stem", "det_index", "cls", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), "conf", F.lit(False).alias("broken"))
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:-1]]
    return rows.unionByName(bad.select("stem", *none, F.lit(True).alias("broken")))


@query(f"""WITH {_SQL} SELECT 'i' || stem AS img_name, k, CASE WHEN shape = 1 THEN NULL ELSE k % 90 END::INT AS age, shape <> 2 AND shape <> 3 AS usable,
CASE WHEN shape NOT IN (2, 3) THEN (sum((shape NOT IN (2, 3))::INT) OVER (PARTITION BY stem ORDER BY k) - 1)::BIGINT END AS box_index FROM c""")
def scan_faces(s, d):
    """CSV with -1 for what is missing; indices count the usable rows of an image in the file's order."""
    p = _people(s, d)
    bad = F.when(F.col("shape") == 2, -1.0).when(F.col("shape") == 3, F.col("x1"))
    text = p.select(
        F.concat(F.lit("i"), "stem").alias("img_name"), F.when(F.col("shape") == 1, -1).otherwise(F.col("k") % 90).alias("age"), F.col("k").cast("string").alias("gender"), *[F.lit(-1).alias(c) for c in ("face_x0", "face_y0", "face_x1", "face_y1")],
        F.col("x1").alias("person_x0"), F.col("y1").alias("person_y0"), F.coalesce(bad, F.col("x2")).alias("person_x1"), F.col("y2").alias("person_y1"),
    )
    path = scratch(s)
    W.write_csv(text.withColumn("g", F.col("gender").cast("long")).repartitionByRange(4, "img_name", "g").sortWithinPartitions("img_name", "g").drop("g"), path)
    return R.faces(s, path).select("img_name", F.col("gender").cast("long").alias("k"), F.col("age").cast("int").alias("age"), "usable", "box_index")


@query(f"""WITH {_SQL} SELECT stem, k, CASE WHEN shape < 5 THEN 'person' ELSE 'ignore' END AS kind, round(x1, 6) AS x1, round(y2, 6) AS y2, CASE WHEN shape < 5 THEN CASE WHEN shape = 0 THEN 0.5 ELSE 1.0 END END::DOUBLE AS visible FROM c""")
def scan_crowd(s, d):
    """Crowd annotations: persons with their visible share, everything else as ignore boxes."""
    p = _people(s, d).withColumn("i", F.col("k").cast("int"))
    half = F.when(F.col("shape") == 0, F.col("x1") + (F.col("x2") - F.col("x1")) / 2).otherwise(F.col("x2"))
    box = lambda x2: F.struct("x1", "y1", x2.alias("x2"), "y2")
    persons = p.filter("shape < 5").select("stem", "i", box(half).alias("v"), box(F.col("x2")).alias("f"))
    path = scratch(s)
    W.crowd_lines(persons, p.filter("shape >= 5").select("stem", "i", "x1", "y1", "x2", "y2")).write.text(path)
    people, ign = R.crowd(s, path)
    keys = p.select("stem", "k", "shape", F.row_number().over(R.Window.partitionBy("stem").orderBy("k")).alias("n"))  # places in a file's list
    got = people.select("stem", "i", F.lit("person").alias("kind"), F.col("f.x1").alias("x1"), F.col("f.y2").alias("y2"), "visible").unionByName(ign.select("stem", "i", F.lit("ignore").alias("kind"), "x1", "y2", F.lit(None).cast("double").alias("visible")))
    return got.join(keys, (got["stem"] == keys["stem"]) & (got["i"] == keys["n"] - 1)).select(got["stem"], "k", "kind", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), F.round("visible", 9).alias("visible"))


@query("""WITH e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events)
SELECT 'v' || (user_id % 10) AS video, (row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1)::INT AS seq, event_id AS f, (event_id % 3)::INT AS n_dets, CASE WHEN event_id % 3 > 0 THEN (event_id % 101) / 100.0::DOUBLE END AS conf FROM e""")
def scan_frames(s, d):
    """Frame logs of several videos, in any order within a file."""
    det = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(8.0), F.col("event_id") % 101 / 100.0)
    e = load(s, d, "events").select(F.concat(F.lit("v"), (F.col("user_id") % 10).cast("string")).alias("stem"), F.md5(F.col("event_id").cast("string")).alias("any"), F.to_json(F.struct(F.col("event_id").alias("f"), (F.col("event_id") * 40.0).alias("t"), F.array_repeat(det, (F.col("event_id") % 3).cast("int")).alias("dets"))).alias("value"))
    path = scratch(s)
    W.write_lines(e, path, "stem", ["any"])
    return R.frames(s, path).select("video", "seq", "f", F.size("dets").alias("n_dets"), F.get("dets", F.lit(0))["conf"].alias("conf"))


@query(f"""WITH {_SQL} SELECT stem, k, CASE cls WHEN 0 THEN 'woman' WHEN 1 THEN 'man' ELSE 'child' END AS category, round(x2, 6) AS x2, round(y2, 6) AS y2, shape % 2 AS iscrowd FROM c""")
def scan_coco(s, d):
    """One index file of images, annotations and categories."""
    p = _people(s, d)
    image = p.select(F.struct(F.col("stem").cast("long").alias("id"), F.concat(F.lit("img/"), "stem", F.lit(".png")).alias("file_name"), F.lit(64).alias("width"), F.lit(64).alias("height")).alias("x")).distinct().agg(F.collect_list("x").alias("images"))
    note = F.struct(F.col("k").alias("id"), F.col("stem").cast("long").alias("image_id"), F.col("cls").cast("long").alias("category_id"), F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("k").cast("double")).alias("bbox"), (F.col("shape") % 2).alias("iscrowd"))
    names = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("name")) for i, n in enumerate(("woman", "man", "child"))])
    path = scratch(s)
    image.crossJoin(p.agg(F.collect_list(note).alias("annotations"))).select(F.to_json(F.struct("images", "annotations", names.alias("categories")))).write.text(path)  # a row each: the format is one object
    own = R.coco(s, path)
    return own.select("stem", F.col("id").alias("k"), "category", F.round("x2", 6).alias("x2"), F.round("y2", 6).alias("y2"), "iscrowd")


@query("""SELECT 'run' || n_nationkey AS run, (n_nationkey % 4 * 160 + 160)::VARCHAR AS size, CASE WHEN n_regionkey < 3 THEN 'val' ELSE 'test' END AS split, n_nationkey / 100.0::DOUBLE AS score, t AS tag FROM nation, (VALUES (0), (1), (2)) v(t) WHERE t = 0 OR (t = 1 AND n_nationkey % 2 = 0) OR (t = 2 AND n_nationkey % 5 = 0)""")
def scan_results(s, d):
    """Results keyed by their files' names, then stored once in each of their tags' folders."""
    n = load(s, d, "nation")
    stem = F.format_string("run%s_sz%s_%s", "n_nationkey", F.col("n_nationkey") % 4 * 160 + 160, F.when(F.col("n_regionkey") < 3, "val").otherwise("test"))
    text = n.select(stem.alias("stem"), F.to_json(F.struct((F.col("n_nationkey") / 100.0).alias("score"))).alias("text"))
    path, tagged = scratch(s), scratch(s)
    W.write_label_files(text.unionByName(text.limit(1).select(F.lit("notes").alias("stem"), "text")), path)
    got = R.keyed_results(s, path, "score double", r"^(run\d+)_sz(\d+)_(\w+)$", ["run", "size", "split"]).withColumn("stem", F.col("run"))
    key = F.regexp_extract("stem", r"(\d+)", 1).cast("int")
    tags = got.select("stem", F.explode(F.array_compact(F.array(F.lit(0), F.when(key % 2 == 0, 1), F.when(key % 5 == 0, 2)))).alias("tag"))
    W.by_tag(got, tags, tagged)
    return s.read.parquet(tagged).select("run", "size", "split", "score", "tag")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 < 5 THEN (p_size * 37 + p_partkey % 300 + 1)::INT END AS width, CASE WHEN p_partkey % 7 < 5 THEN (p_size + p_partkey % 1000 + 1)::INT END AS height FROM part""")
def image_headers(s, d):
    """Sizes from the headers of five kinds of files; others and those that break off have none."""
    w, h = F.col("p_size") * 37 + F.col("p_partkey") % 300 + 1, F.col("p_size") + F.col("p_partkey") % 1000 + 1
    big = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    little = lambda v, n: F.concat(*[F.substring(big(v, n), 2 * i + 1, 2) for i in reversed(range(n))])
    kind = F.col("p_partkey") % 7
    skip = F.concat(F.lit("FFE1"), big(F.lit(2) + F.col("p_partkey") % 50, 2), F.repeat(F.lit("AB"), (F.col("p_partkey") % 50).cast("int")))
    text = (
        F.when(kind == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0806")))
        .when(kind == 1, F.concat(F.lit("FFD8"), skip, F.lit("FFC4000400FFFFDB000300"), F.lit("FFC2001108"), big(h, 2), big(w, 2), F.lit("03")))
        .when(kind == 2, F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("F7"))).when(kind == 3, F.concat(F.lit("424D"), F.repeat(F.lit("00"), 16), little(w, 4), little(F.lit(2**32) - h, 4)))
        .when(kind == 4, F.concat(F.lit("5249464600000000574542505650385800000000"), F.lit("00000000"), little(w - 1, 3), little(h - 1, 3))).when(kind == 5, F.concat(F.lit("FFD8"), skip, F.lit("FFC200"))).otherwise("6E6F20696D616765")
    )
    return load(s, d, "part").select(F.col("p_partkey").alias("id"), image_size(F.unhex(text)).alias("z")).select("id", "z.width", "z.height")


@query("""WITH b AS (SELECT c_custkey AS k, list_transform(string_split(md5(c_custkey::VARCHAR), ''), lambda x: ascii(x)) AS b FROM customer),
i AS (SELECT k, b, list_transform(range(0, 12), lambda n: 10 + (n // 6) * 8 + n % 6) AS i FROM b), l AS (SELECT k, b, list_transform(i, lambda p: b[p - 8] + b[p + 8] + b[p - 1] + b[p + 1] - 4 * b[p]) AS l FROM i)
SELECT k, round(list_avg(b), 6) AS brightness, round(list_aggregate(l, 'var_pop'), 6) AS blurriness FROM l""")
def image_measures(s, d):
    """Brightness and sharpness of grey images of 8 x 4 pixels, made of a hash's characters."""
    c = load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit(8).alias("width"), F.lit(4).alias("height"), F.md5(F.col("c_custkey").cast("string").cast("binary")).cast("binary").alias("pixels"))
    return measured(c).select(F.col("key").cast("long").alias("k"), F.round("brightness", 6).alias("brightness"), F.round("blurriness", 6).alias("blurriness"))

"""Readers of labels, sidecars, annotations and manifests as typed tables.

Text formats are read as lines with their file's stem; a file that exists but is empty gives no line, so whether an image
was processed is a table of its own (`listing`), joined where missing must not look like empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DETECTION = "struct<det_index:int,cls:int,cls_name:string,box_xyxy:array<double>,conf:double,kept:boolean,excluded:string,gender_cls:int,gender_name:string,gender_conf:double,age_cls:int,age_name:string,age_conf:double>"
SIDECAR = f"image string, width int, height int, detections array<{DETECTION}>, _corrupt_record string"
SEGMENTS = "image string, width int, height int, detections array<struct<cls:int,conf:double,box:array<double>,parts:array<array<array<double>>>>>, suppressed array<struct<cls:int,conf:double,box:array<double>>>, _corrupt_record string"
CROWD = "ID string, gtboxes array<struct<tag:string,vbox:array<double>,fbox:array<double>,hbox:array<double>,extra:struct<ignore:int>>>"
MANIFEST = "id string, image string, gt_age double, gt_gender string"
VERDICT = (
    "image_stem string, det_index int, image string, img_wh array<int>, sam_class_id int, sam_conf double, box array<double>, n_parts int, blurriness double, person_px_height double, prompt_sha string, parse_ok boolean, "
    "v struct<verdict:string,gender:string,age_group:string,highlight_quality:string,confidence:string,estimated_age:double,apparent_race:string,head_covering:string,exposed_body_parts:array<string>>, raw_text string, source string"
)
FRAMES = "f long, t double, dets array<array<double>>"
COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,iscrowd:int>>, categories array<struct<id:long,name:string>>"
FACES = "img_name string, age string, gender string, face_x0 string, face_y0 string, face_x1 string, face_y1 string, person_x0 string, person_y0 string, person_x1 string, person_y1 string"


def stem_of(path: Column) -> Column:
    """The file's name without its extension, or the value of a folder `stem=<value>` that a partitioned sink made."""
    own = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.coalesce(F.nullif(F.regexp_extract(own, r"/stem=([^/]+)/[^/]*$", 1), F.lit("")), F.regexp_extract(own, r"([^/]+?)(\.[^./]*)?$", 1))


def listing(spark: SparkSession, folder: str, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """Stem and path of the files, empty ones too: scans skip those, so this asks Spark's file index, which holds every path on the
    driver for any scan. Contents are not read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    paths = [(p,) for p in r.load(folder).inputFiles()]
    return spark.createDataFrame(paths, "path string").select(stem_of(F.col("path")).alias("stem"), "path")


def lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, block, at, line: a split-safe scan of text files. `block` is the byte where the line's split begins and `at` grows
    within it, so (file, block, at) is the order of the lines, however many tasks share a file."""
    t = spark.read.options(**options).text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def numbered(rows: DataFrame) -> DataFrame:
    """lines() with line_no, counted from 0 in each file: a line's place in its split and the splits' counts before it.
    Windows run over a file's splits, not its lines."""
    per = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(per.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).cast("int").alias("line_no"), "line")


def label_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """stem, line_no (among the file's lines), tok: numbers of each line; lines that hold anything else are dropped."""
    t = numbered(lines(spark, folder, pathGlobFilter="*.txt", recursiveFileLookup="true")).withColumn("stem", stem_of(F.col("file")))
    tok = F.transform(F.split(F.trim("line"), r"\s+"), lambda s: s.try_cast("double"))
    return t.withColumn("tok", tok).filter((F.trim("line") != "") & ~F.exists("tok", lambda v: v.isNull())).select("stem", "line_no", "tok", "line")


def _extent(tok: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    pts = F.slice(tok, 2, n)
    xs, ys = F.filter(pts, lambda _, i: i % 2 == 0), F.filter(pts, lambda _, i: i % 2 == 1)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def labels(tokens: DataFrame, with_conf: str = "none") -> DataFrame:
    """Boxes of box lines (cls cx cy w h) and polygon lines (cls x1 y1 x2 y2 ...), normalised.
    with_conf: 'none'; 'parity': an even number of tokens ends in a confidence; 'six': only lines of exactly six tokens."""
    n = F.size("tok")
    has = (n % 2 == 0) if with_conf != "none" else F.lit(False)
    coords = n - 1 - F.when(has, 1).otherwise(0)
    t = tokens.withColumns({"coords": coords, "conf": F.when(has, F.element_at("tok", -1))})
    t = t.filter(n == 6) if with_conf == "six" else t.filter((F.col("coords") == 4) | ((F.col("coords") >= 6) & (F.col("coords") % 2 == 0)))
    is_box = F.col("coords") == 4
    e = _extent(F.col("tok"), F.col("coords"))
    at = lambda i: F.get("tok", F.lit(i))
    centre = (at(1) - at(3) / 2, at(2) - at(4) / 2, at(1) + at(3) / 2, at(2) + at(4) / 2)
    pts = F.slice("tok", 2, F.col("coords"))
    poly = F.when(~is_box, F.transform(F.sequence(F.lit(0), (F.col("coords") / 2 - 1).cast("int")), lambda i: F.struct(F.get(pts, (i * 2).cast("int")).alias("x"), F.get(pts, (i * 2 + 1).cast("int")).alias("y"))))
    return t.select("stem", "line_no", at(0).cast("int").alias("cls"), *[F.when(is_box, c).otherwise(p).alias(k) for c, p, k in zip(centre, e, ("x1", "y1", "x2", "y2"), strict=True)], "conf", poly.alias("poly"))


def ignore_regions(tokens: DataFrame) -> DataFrame:
    """The first four numbers after the class as a box, whatever the line's shape."""
    at = lambda i: F.get("tok", F.lit(i))
    return tokens.filter(F.size("tok") >= 5).select("stem", "line_no", (at(1) - at(3) / 2).alias("x1"), (at(2) - at(4) / 2).alias("y1"), (at(1) + at(3) / 2).alias("x2"), (at(2) + at(4) / 2).alias("y2"))


def sidecars(spark: SparkSession, folder: str, schema: str = SIDECAR, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(readable sidecars with their stem, stems of files that do not parse)."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(folder).withColumn("stem", stem_of(F.input_file_name()))
    bad = F.col("_corrupt_record").isNotNull() | F.col("image").isNull() & F.col("detections").isNull()
    return raw.filter(~bad).drop("_corrupt_record"), raw.filter(bad).select("stem")


def detections(side: DataFrame, prefix: str = "", normalised: bool = True) -> DataFrame:
    """One row a detection that is not excluded, in shares of the image unless pixels are asked for."""
    d = side.filter(F.col("stem").startswith(prefix)).select("stem", "width", "height", F.posexplode("detections").alias("pos", "d")).filter(F.col("d.excluded").isNull() | (F.col("d.excluded") == ""))
    over = lambda c: F.col(c).cast("double") if normalised else F.lit(1.0)
    b = F.col("d.box_xyxy")
    return d.select("stem", F.coalesce("d.det_index", "pos").alias("det_index"), F.col("d.cls").alias("cls"), *[(F.get(b, F.lit(i)) / over(w)).alias(k) for i, (k, w) in enumerate((("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height")))], F.col("d.conf").alias("conf"), F.col("d.kept").alias("kept"))


def crowd(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(persons with visible and full box and their visible share, ignore boxes)."""
    b = spark.read.schema(CROWD).json(path).select(F.col("ID").alias("stem"), F.posexplode("gtboxes").alias("i", "b"))
    person = F.coalesce((F.col("b.tag") == "person") & (F.coalesce("b.extra.ignore", F.lit(0)) != 1), F.lit(False))
    box = lambda v: F.struct(*[x.alias(k) for x, k in zip((F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.get(v, F.lit(0)) + F.get(v, F.lit(2)), F.get(v, F.lit(1)) + F.get(v, F.lit(3))), ("x1", "y1", "x2", "y2"), strict=True)])
    size = lambda v: F.get(v, F.lit(2)) * F.get(v, F.lit(3))
    vis = F.coalesce("b.vbox", "b.fbox")
    share = F.when(size(F.col("b.fbox")) > 0, F.least(F.lit(1.0), size(vis) / size(F.col("b.fbox")))).otherwise(F.lit(1.0))
    persons = b.filter(person).select("stem", "i", box(vis).alias("v"), box(F.coalesce("b.fbox", "b.vbox")).alias("f"), share.alias("visible"))
    return persons, b.filter(~person).select("stem", "i", box(F.coalesce("b.fbox", "b.vbox", "b.hbox")).alias("b")).select("stem", "i", "b.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Ids end in _<box index>; an id that does not fails the query."""
    m = spark.read.schema(MANIFEST).json(path)
    index = F.substring_index("id", "_", -1).try_cast("int")
    checked = F.when(index.isNull(), F.raise_error(F.concat(F.lit("bad id "), F.col("id"))).cast("int")).otherwise(index)
    return m.select("id", "image", stem_of(F.col("image")).alias("stem"), checked.alias("box_index"), "gt_age", "gt_gender")


def manifest_boxes(man: DataFrame, boxes: DataFrame) -> DataFrame:
    """Manifest rows with the label line of their index."""
    return man.join(boxes, (man["stem"] == boxes["stem"]) & (man["box_index"] == boxes["line_no"])).drop(boxes["stem"])


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of all files that match, with their place (file, block, at), half-written lines dropped; dedupe() then picks the first or last."""
    parsed = lines(spark, path, recursiveFileLookup="true").filter(F.trim("line") != "").withColumn("r", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter(F.col("r._bad").isNull() & F.col("r").isNotNull()).select("file", "block", "at", "r.*").drop("_bad")


#: The order of records(), for dedupe().
PLACE = ["file", "block", "at"]


def faces(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows with their place (file, block, at), -1 as missing, and the index among an image's rows with a usable person box."""
    c = spark.read.schema(FACES).option("header", True).option("recursiveFileLookup", True).csv(path)
    c = c.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "*")
    value = lambda k: F.when(F.col(k).try_cast("double") != -1, F.col(k).try_cast("double"))
    c = c.withColumns({k: value(k) for k in c.columns if k.startswith(("face_", "person_"))} | {"age": F.nullif("age", F.lit("-1"))})
    ok = (F.col("person_x1") > F.col("person_x0")) & (F.col("person_y1") > F.col("person_y0"))
    good = c.withColumn("usable", F.coalesce(ok, F.lit(False)))
    w = Window.partitionBy("img_name").orderBy(*PLACE)
    return good.withColumn("box_index", F.when(F.col("usable"), F.sum(F.col("usable").cast("int")).over(w) - 1))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with image and category names, boxes as corners."""
    c = spark.read.schema(COCO).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    i = c.select(F.inline("images")).withColumnsRenamed({"id": "image_id"})
    k = c.select(F.inline("categories")).withColumnsRenamed({"id": "category_id", "name": "category"})
    a = c.select(F.inline("annotations"))
    at = lambda n: F.get("bbox", F.lit(n))
    return a.join(i, "image_id").join(F.broadcast(k), "category_id").select("id", stem_of(F.col("file_name")).alias("stem"), "category", at(0).alias("x1"), at(1).alias("y1"), (at(0) + at(2)).alias("x2"), (at(1) + at(3)).alias("y2"), "iscrowd", "width", "height")


def layout(yaml_text: str) -> dict[str, str]:
    """The flat 'key: value' lines of a dataset file, read on the driver."""
    out = {}
    for line in yaml_text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        if value.strip() and not key.startswith((" ", "-")):
            out[key.strip()] = value.strip().strip("'\"")
    return out


#: Where a split's images may lie below a data set's root.
IMAGE_FOLDERS = ("{s}", "images/{s}", "{s}/images")


def split_folders(spark: SparkSession, root: str, split: str) -> tuple[str, str] | None:
    """The folders of a split's images and labels, the first of the usual places that there are; None without them. Asks the file system of the root."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda p: fs.exists(fs_path(p)) and fs.getFileStatus(fs_path(p)).isDirectory()
    root = root.rstrip("/")
    for place in IMAGE_FOLDERS:
        images = f"{root}/{place.format(s=split)}"
        if not there(images):
            continue
        above, name = images.rsplit("/", 1)
        for labels in (images.replace("/images/", "/labels/", 1), images.replace("images", "labels"), f"{above}/labels/{name}", f"{root}/labels/{split.rsplit('/', 1)[-1]}"):
            if labels != images and there(labels):
                return images, labels
    return None


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Stem, path, width and height of image files, from the first bytes of each; null where they can't be told."""
    from boxtide.functions.images import image_size

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,bmp,webp,PNG,JPG,JPEG}").option("recursiveFileLookup", True).load(folder)
    return files.select(stem_of(F.col("path")).alias("stem"), "path", image_size(F.col("content")).alias("size")).select("stem", "path", "size.width", "size.height")


def keyed_results(spark: SparkSession, folder: str, schema: str, pattern: str, names: list[str]) -> DataFrame:
    """JSON results whose key is in the file's name: a column for each group of the pattern."""
    r = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder).withColumn("_f", stem_of(F.input_file_name()))
    return r.filter(F.col("_f").rlike(pattern)).withColumns({n: F.regexp_extract("_f", pattern, i + 1) for i, n in enumerate(names)}).drop("_f")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all videos: video, seq (by f), t, dets as structs."""
    r = spark.read.schema(FRAMES).option("recursiveFileLookup", True).json(path).withColumn("video", stem_of(F.input_file_name()))
    names = ("cls", "x1", "y1", "x2", "y2", "conf")
    dets = F.transform("dets", lambda d: F.struct(*[F.get(d, F.lit(i)).cast("int" if n == "cls" else "double").alias(n) for i, n in enumerate(names)]))
    return r.withColumns({"seq": (F.row_number().over(Window.partitionBy("video").orderBy("f")) - 1).cast("int"), "dets": dets}).select("video", "f", "seq", "t", "dets")


def stems(spark: SparkSession, path: str) -> DataFrame:
    """A list of names, one a line, as stems."""
    return spark.read.text(path).select(stem_of(F.trim("value")).alias("stem")).filter("stem <> ''").distinct()

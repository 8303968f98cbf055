import json

import pytest
from pyspark.sql import functions as F

from boxtide.operators.quality import dedupe
from boxtide.sources import readers as R
from boxtide.sources import writers as W


def write(folder, files):
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_labels(spark, tmp_path):
    d = write(tmp_path, {"a.txt": "0 0.5 0.5 0.2 0.4\n1 0.1 0.1 0.4 0.1 0.4 0.9\nbad line here x y\n", "b.txt": "", "c.txt": "2 0.5 0.5 0.2 0.4 0.9\n0 0.1 0.1 0.4 0.1 0.4 0.9 0.7\n0 0.1 0.2\n"})
    t = R.label_tokens(spark, d)
    got = {(r.stem, r.line_no): (r.cls, round(r.x1, 6), round(r.y1, 6), round(r.x2, 6), round(r.y2, 6), r.conf, r.poly and len(r.poly)) for r in R.labels(t, "parity").collect()}
    assert got[("a", 0)] == (0, 0.4, 0.3, 0.6, 0.7, None, None)
    assert got[("a", 1)] == (1, 0.1, 0.1, 0.4, 0.9, None, 3)
    assert got[("c", 0)] == (2, 0.4, 0.3, 0.6, 0.7, 0.9, None)
    assert got[("c", 1)] == (0, 0.1, 0.1, 0.4, 0.9, 0.7, 3)
    assert len(got) == 4
    assert {r.stem for r in R.listing(spark, d).collect()} == {"a", "b", "c"}  # an empty file is there, only without lines
    assert [r.line_no for r in R.labels(t, "six").filter("stem = 'c'").collect()] == [0]
    assert R.ignore_regions(t).filter("stem = 'a'").count() == 2


def test_sidecars(spark, tmp_path):
    good = {"image": "x.jpg", "width": 100, "height": 50, "detections": [{"det_index": 0, "cls": 1, "box_xyxy": [10, 10, 50, 40], "conf": 0.5}, {"det_index": 1, "cls": 0, "box_xyxy": [0, 0, 1, 1], "conf": 0.9, "excluded": "small"}]}
    d = write(tmp_path, {"x.json": json.dumps(good, indent=1), "y.json": '{"image": "y.jpg", "wid'})
    side, bad = R.sidecars(spark, d)
    assert [tuple(r) for r in R.detections(side).select("stem", "det_index", "x1", "y1", "x2", "y2").collect()] == [("x", 0, 0.1, 0.2, 0.5, 0.8)]
    assert [r.stem for r in bad.collect()] == ["y"]


def test_crowd_round_trip(spark, tmp_path):
    rec = {"ID": "i1", "gtboxes": [{"tag": "person", "vbox": [0, 0, 10, 20], "fbox": [0, 0, 10, 30]}, {"tag": "mask", "fbox": [5, 5, 5, 5], "extra": {"ignore": 1}}, {"tag": "person", "fbox": [1, 1, 2, 2], "extra": {"ignore": 1}}]}
    p, g = R.crowd(spark, write(tmp_path, {"a.odgt": json.dumps(rec) + "\n"}))
    assert [(r.v.x2, r.v.y2, round(r.visible, 4)) for r in p.collect()] == [(10, 20, 0.6667)]
    assert g.count() == 2
    line = json.loads(W.crowd_lines(p, g).first().value)
    assert line["ID"] == "i1" and [b["tag"] for b in line["gtboxes"]] == ["person", "mask", "mask"]
    assert line["gtboxes"][0]["vbox"] == [0.0, 0.0, 10.0, 20.0]


def test_manifest_and_records(spark, tmp_path):
    (tmp_path / "m").mkdir(), (tmp_path / "r").mkdir(), (tmp_path / "bad").mkdir()
    m = R.manifest(spark, write(tmp_path / "m", {"gt.jsonl": '{"id": "ab_c_3", "image": "/p/ab_c.jpg", "gt_age": 7}\n'}))
    assert m.first()[2:4] == ("ab_c", 3)
    with pytest.raises(Exception, match="bad id"):
        R.manifest(spark, write(tmp_path / "bad", {"gt.jsonl": '{"id": "abc", "image": "x.jpg"}\n'})).collect()
    d = write(tmp_path / "r", {"v0.jsonl": '{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n', "v1.jsonl": '{"id": 1, "v": "c"}\n{"id": 3, "v'})
    r = R.records(spark, d, "id int, v string")
    order = [F.col(c) for c in R.PLACE]
    first = {x.id: x.v for x in dedupe(r, ["id"], order).collect()}
    assert first == {1: "a", 2: "b"}
    assert {x.id: x.v for x in dedupe(r, ["id"], order, "last").collect()} == {1: "c", 2: "b"}


def test_faces(spark, tmp_path):
    head = "img_name,age,gender,face_x0,face_y0,face_x1,face_y1,person_x0,person_y0,person_x1,person_y1\n"
    p = write(tmp_path, {"f.csv": head + "a.jpg,30,M,1,1,2,2,0,0,10,10\na.jpg,-1,F,-1,-1,-1,-1,5,5,5,9\na.jpg,4,F,1,1,2,2,1,1,3,3\n"})
    assert [(r.usable, r.box_index, r.age) for r in R.faces(spark, p).orderBy(*R.PLACE).collect()] == [(True, 0, "30"), (False, None, None), (True, 1, "4")]


def test_coco_keyed_and_layout(spark, tmp_path):
    (tmp_path / "c").mkdir(), (tmp_path / "k").mkdir()
    c = {"images": [{"id": 1, "file_name": "p/a.jpg", "width": 10, "height": 10}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "person"}]}
    assert R.coco(spark, write(tmp_path / "c", {"i.json": json.dumps(c)})).select("stem", "category", "x2", "y2").first() == ("a", "person", 4.0, 6.0)
    k = R.keyed_results(spark, write(tmp_path / "k", {"run1_int8_sz640_val.json": '{"map": 0.5}', "notes.json": '{"map": 1}'}), "map double", r"^(.+)_(\w+)_sz(\d+)_(\w+)$", ["run", "tag", "sz", "ds"])
    assert [tuple(r) for r in k.collect()] == [(0.5, "run1", "int8", "640", "val")]
    assert R.layout("path: /d # x\ntrain: images/train\nnames:\n  - a\n") == {"path": "/d", "train": "images/train"}


def test_frames_and_sinks(spark, tmp_path):
    (tmp_path / "f").mkdir(), (tmp_path / "s").mkdir()
    f = R.frames(spark, write(tmp_path / "f", {"v1.jsonl": '{"f": 10, "t": 400.0, "dets": [[1, 0, 0, 5, 5, 0.9]]}\n{"f": 5, "t": 200.0, "dets": []}\n'}))
    assert [(r.video, r.seq, r.f, len(r.dets)) for r in f.orderBy("seq").collect()] == [("v1", 0, 5, 0), ("v1", 1, 10, 1)]
    assert {r.stem for r in R.stems(spark, write(tmp_path / "s", {"x.txt": "p/a.jpg\nb\n\n"})).collect()} == {"a", "b"}
    lines = spark.createDataFrame([("a", 1, "l1"), ("a", 0, "l0")], "stem string, det_index int, line string")
    files = W.label_files(lines, spark.createDataFrame([("a",), ("e",)], "stem string"))
    assert {r.stem: r.text for r in files.collect()} == {"a": "l0\nl1", "e": ""}
    W.write_label_files(files, str(tmp_path / "out"))
    assert (tmp_path / "out" / "stem=a").is_dir()
    x = spark.range(1).select(W.label_line(F.lit(2), F.lit(0.1), F.lit(0.2), F.lit(0.5), F.lit(0.4)).alias("l")).first().l
    assert x == "2 0.300000 0.300000 0.400000 0.200000"
    W.by_tag(lines, spark.createDataFrame([("a", "t1"), ("a", "t2")], "stem string, tag string"), str(tmp_path / "tags"))
    assert spark.read.parquet(str(tmp_path / "tags")).count() == 4
    W.write_csv(lines, str(tmp_path / "csv")), W.overwrite(lines, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_scans_of_split_files(spark, tmp_path):
    """Files that several tasks read, ends of lines of both kinds, an empty file, names with blanks and signs."""
    (tmp_path / "in").mkdir()
    text = {"a b+c.txt": [f"{i % 3} 0.{i % 9} 0.5 0.25 0.5" for i in range(900)], "z.txt": ["0 0.5 0.5 0.1 0.1"] * 5, "e.txt": []}
    for name, rows in text.items():
        (tmp_path / "in" / name).write_bytes("".join(r + ("\r\n" if i % 2 else "\n") for i, r in enumerate(rows)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        all_lines = R.lines(spark, str(tmp_path / "in"))
        assert all_lines.rdd.getNumPartitions() > 5
        got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in R.numbered(all_lines).collect()}
        t = R.label_tokens(spark, str(tmp_path / "in"))
        assert {(r.stem, r.line_no) for r in t.collect()} == {(n[:-4], i) for n, rows in text.items() for i in range(len(rows))}
        (tmp_path / "r").mkdir()
        for k in range(2):
            (tmp_path / "r" / f"v{k}.jsonl").write_text("".join(json.dumps({"id": i % 70, "v": f"{k}-{i}"}) + "\n" for i in range(400)) + '{"id": 3, "v')
        order = [F.col(c) for c in R.PLACE]
        r = R.records(spark, str(tmp_path / "r"), "id int, v string")
        assert r.rdd.getNumPartitions() > 5 and r.count() == 800
        assert {x.id: x.v for x in dedupe(r, ["id"], order).collect()} == {i: f"0-{i}" for i in range(70)}
        assert {x.id: x.v for x in dedupe(r, ["id"], order, "last").collect()} == {i: f"1-{max(j for j in range(400) if j % 70 == i)}" for i in range(70)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(n.replace(" ", "%20"), i): r for n, rows in text.items() for i, r in enumerate(rows)}
    assert {r.stem for r in R.listing(spark, str(tmp_path / "in")).collect()} == {"a b+c", "z", "e"}


def test_layout_and_sizes(spark, tmp_path):
    import struct

    for p in ("a/images/train", "a/labels/train", "b/val/images", "b/val/labels", "c/images/x"):
        (tmp_path / p).mkdir(parents=True)
    at = lambda *names: "/".join([str(tmp_path), *names])
    assert R.split_folders(spark, at("a"), "images/train") == R.split_folders(spark, at("a/"), "train") == (at("a/images/train"), at("a/labels/train"))
    assert R.split_folders(spark, at("b"), "val") == (at("b/val/images"), at("b/val/labels"))
    assert R.split_folders(spark, at("c"), "x") is None and R.split_folders(spark, at("none"), "x") is None
    files = {
        "p.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 481), "empty.png": b"", "j.jpg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xff\xdb" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 33, 70_00, 3) + bytes(9),
        "g.gif": b"GIF87a" + struct.pack("<HH", 5, 9), "w.webp": b"RIFF\0\0\0\0WEBPVP8L" + struct.pack("<IBI", 0, 0x2F, (99) | (49 << 14)), "v.webp": b"RIFF\0\0\0\0WEBPVP8 " + struct.pack("<I", 0) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 176, 144 | 1 << 14),
        "cut.jpg": b"\xff\xd8\xff\xe0\x00", "zero.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 0, 4),
    }
    for name, raw in files.items():
        (tmp_path / "c" / "images" / "x" / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in R.image_sizes(spark, at("c/images/x")).collect()}
    none = (None, None)
    assert {k: got.get(k, none) for k in files} == {"p.png": (640, 481), "empty.png": none, "j.jpg": (7000, 33), "g.gif": (5, 9), "w.webp": (100, 50), "v.webp": (176, 144), "cut.jpg": none, "zero.png": none}


def test_sizes_behind_many_segments(spark):
    """A header behind 0, 7, 8, 63, 64 and 511 segments is found, one behind 512 is not; the walk of a short file ends in its first leg."""
    from boxtide.functions import images as I

    part, frame = "FFDB000300", "FFC20011080020004003"
    rows = spark.createDataFrame([(n, bytes.fromhex("FFD8" + part * n + frame)) for n in (0, 7, 8, 63, 64, 511, 512)], "n int, b binary")
    got = {r.n: r.z and tuple(r.z) for r in rows.select("n", I.image_size(F.col("b")).alias("z")).collect()}
    assert got == {**dict.fromkeys((0, 7, 8, 63, 64, 511), (64, 32)), 512: None}
    assert sum(I.LEGS) == I.SEGMENTS and I.LEGS[0] <= 8

import json
import random

import pytest
from pyspark.sql import functions as F

from boxtide.operators import deployment as P
from boxtide.operators import matching as M
from boxtide.streaming import ingest as I
from boxtide.streaming import tracks as K

FRAME = "video string, seq int, t double, dets array<struct<cls:int,x1:double,y1:double,x2:double,y2:double,conf:double>>"


def walk(seed, n, people=4, rare=0.0):
    """Frames of one video: people on crossing paths that vanish, fade under the threshold and are taken for another class now and then, with clutter; rare: the share of frames in long empty stretches."""
    r = random.Random(seed)
    paths = [(r.uniform(0, 300), r.uniform(-6, 6), r.uniform(40, 90), r.randrange(3)) for _ in range(people)]
    rows, quiet = [], 0
    for i in range(n):
        quiet = quiet - 1 if quiet else (r.randrange(10, 40) if r.random() < rare else 0)
        dets = []
        for x, v, size, cls in paths if not quiet else ():
            state = r.random()
            if state > 0.12:
                at = x + v * (i % 50)
                dets.append((cls if state < 0.93 else (cls + 1) % 3, at, 20.0, at + size, 20.0 + 2 * size, 0.3 if state < 0.25 else 0.45 + state / 2))
        if r.random() < 0.08:
            dets.append((r.randrange(3), 500.0, 5.0, 540.0, 45.0, r.random()))
        rows.append((f"v{seed}", i, i * 40.0, dets if dets or r.random() < 0.5 else None))
    return rows


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0


def plain_tracks(rows, conf=0.45, least=0.3, gap=15):
    """(video, track, seq, detection) by a loop over every frame of one video: all tracks, each with its last frame and box."""
    all_tracks, out = [], []
    for video, seq, _, dets in rows:
        good = [d for d in dets or () if d[5] >= conf]
        alive = [k for k, (last, _) in enumerate(all_tracks) if seq - 1 - last <= gap]
        pairs = sorted(((overlap(all_tracks[k][1], d[1:5]), k, i) for k in alive for i, d in enumerate(good)), reverse=True)
        mine = {}
        for v, k, i in pairs:
            if v >= least and k not in mine.values() and i not in mine:
                mine[i] = k
        for i, d in enumerate(good):
            if i not in mine:
                mine[i] = len(all_tracks)
                all_tracks.append(None)
            all_tracks[mine[i]] = (seq, d[1:5])
            out.append((video, mine[i], seq, *d))
    return sorted(out)


@pytest.fixture(scope="module")
def walks():
    return {s: walk(s, n, people, rare) for s, n, people, rare in ((1, 260, 4, 0.0), (2, 400, 2, 0.05), (3, 90, 6, 0.02), (4, 1, 3, 0.0), (5, 300, 1, 0.1))}


def test_tracks_are_those_of_a_loop(spark, walks, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 64)
    f = spark.createDataFrame([r for v in walks.values() for r in v], FRAME).repartition(5)
    got = sorted(tuple(r) for r in K.build_tracks(f, 0.45).collect())
    assert got == sorted(x for v in walks.values() for x in plain_tracks(v))
    cuts = K.segments(f, 0.45).select("video", "begin").distinct().groupBy("video").count()
    assert max(r["count"] for r in cuts.collect()) > 2
    assert K.build_tracks(f.filter("video = 'none'"), 0.45).count() == 0


def test_rollup_is_that_of_a_loop(spark, walks):
    f = spark.createDataFrame([r for v in walks.values() for r in v], FRAME)
    meta = spark.createDataFrame([(f"v{s}", 25.0, 25.0, 1) for s in walks], "video string, fps double, fps_sane double, every int")
    t = K.build_tracks(f, 0.45)
    gaps = {(r.video, r.track, r.after): (r.gap, r.cause) for r in K.gap_causes(t, f, 0.45).collect()}
    rolled = {r.video: r for r in K.rollup(f, meta, t, 0.45).collect()}
    want_gaps = {}
    for s, rows in walks.items():
        dets = {r[1]: r[3] or [] for r in rows}
        tracks = {}
        for _, k, seq, *d in plain_tracks(rows):
            tracks.setdefault(k, []).append((seq, d))
        real, toggles, flips, exposed, events = 0, 0, 0, [0, 0], [0, 0]
        for k, seen in tracks.items():
            own = 0
            for (a, p), (b, _) in zip(seen, seen[1:]):
                if b - a > 1:
                    own += 1
                    low = sum(any(d[5] < 0.45 and overlap(d[1:5], p[1:5]) >= 0.3 for d in dets[q]) for q in range(a + 1, b))
                    want_gaps[f"v{s}", k, a] = (b - a - 1, "threshold_gap" if low >= (b - a) // 2 else "miss_gap")
            classes = [d[0] for _, d in seen]
            major = max(set(classes), key=lambda c: (classes.count(c), -classes.index(c)))
            if len(seen) >= max(3, round(0.5 * 25)):
                real += 1
                toggles += 2 * own
                flips += sum(x != y for x, y in zip(classes, classes[1:]))
                if major < 2:
                    right = {q for q, d in seen if d[0] == major}
                    missing = [q not in right for q in range(seen[0][0], seen[-1][0] + 1)]
                    exposed[major] += sum(missing)
                    events[major] += sum(m and not p for m, p in zip(missing, [False, *missing]))
        r = rolled[f"v{s}"]
        assert (r.frames, r.tracks, r.real, r.toggles, r.flips) == (len(rows), len(tracks), real, toggles, flips)
        assert [r.exposed_frames_0, r.exposed_frames_1] == exposed and [r.exposure_events_0, r.exposure_events_1] == events
        assert r.phantoms == sum(len(x) <= max(2, round(0.3 * r.fps)) for x in tracks.values())
    assert gaps == want_gaps and len(want_gaps) > 50


def test_stream_equals_batch(spark, walks, tmp_path):
    """Four batches in order, and one with frames that come too late; what is late is left out, the rest is the batch's."""
    f = spark.createDataFrame([r for s in (1, 2, 3) for r in walks[s]], FRAME)
    late = spark.createDataFrame([(v, s, t, [(0, 1000.0, 0.0, 1050.0, 90.0, 0.9)]) for v, s, t, _ in walks[1][10:20]], FRAME)
    got = []
    for k, part in enumerate([f.filter("seq < 100"), f.filter("seq >= 100 AND seq < 180"), late, f.filter("seq >= 180")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = K.stream_tracks(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")), 0.45)
        I.run_once(s, lambda df, _: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
        assert k == 0 or len(got) > 300
    assert sorted(got) == sorted(x for s in (1, 2, 3) for x in plain_tracks(walks[s]))


def test_stream_forgets(spark, tmp_path):
    """A video that the watermark has left behind by more than idle_ms keeps no state."""
    person = [(0, 0.0, 0.0, 50.0, 90.0, 0.9)]
    parts = [[("a", i, i * 40.0, person) for i in range(20)], [("b", i, 900_000.0 + i * 40.0, person) for i in range(5)], [("b", i, 1_900_000.0 + i * 40.0, person) for i in range(5, 9)]]
    left = []
    for rows in parts:
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = K.stream_tracks(spark.readStream.schema(FRAME).parquet(str(tmp_path / "in")), 0.45)
        I.run_once(s, lambda df, _: df.count(), str(tmp_path / "ck"))
        state = spark.read.format("statestore").option("stateVarName", "at").load(str(tmp_path / "ck"))
        left.append({r.key[0] for r in state.collect()})
    assert left[0] == {"a"} and "a" not in left[2] and "b" in left[2]


def test_ingest_is_idempotent(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        I.append_new(new, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text("\n".join(json.dumps({"k": k}) for k in (1, 2, 2)))
    got = []
    for name, keys in (("b.json", (2, 3)), ("c.json", ())):
        I.run_once(I.verdict_stream(spark, str(tmp_path / "j"), "k int", ["k"]), lambda df, _: got.extend(r.k for r in df.collect()), str(tmp_path / "ck"))
        (tmp_path / "j" / name).write_text("\n".join(json.dumps({"k": k}) for k in keys))
    assert sorted(got) == [1, 2, 3]


def test_policy_is_that_of_cells(spark):
    """Exposure and what is wrongly hidden, counted on whole cells of small random images."""
    r = random.Random(77)
    box = lambda: (x := r.randrange(30), y := r.randrange(20), x + r.randint(3, 12), y + r.randint(3, 12))
    b = "x1 double, y1 double, x2 double, y2 double"
    floats = lambda q: tuple(map(float, q))
    gt = [(s, i, r.randrange(3), *floats(box())) for s in range(25) for i in range(r.randrange(4))]
    det = [(s, i, r.randrange(3), *floats(r.choice([g[3:] for g in gt if g[0] == s] or [box()]) if r.random() < 0.6 else box()), r.choice([0.2, 0.45, 0.9])) for s in range(25) for i in range(r.randrange(5))]
    ign = [(s, *floats(box())) for s in range(0, 25, 4)]
    g, d = spark.createDataFrame(gt, f"stem int, gt_index int, cls int, {b}"), spark.createDataFrame(det, f"stem int, det_index int, cls int, {b}, conf double")
    got = {x.stem: x for x in P.image_metrics(spark.createDataFrame([(s, 50, 40) for s in range(25)], "stem int, width int, height int"), g, spark.createDataFrame(ign, f"stem int, {b}"), d, 0, 2, 0.45).collect()}
    assert len(got) == 25
    for s in range(25):
        blurred = [x[3:7] for x in det if x[0] == s and x[2] == 0 and x[7] >= 0.45]
        women = [x[3:] for x in gt if x[0] == s and x[2] == 0]
        bare = sum(not any(q[0] <= x < q[2] and q[1] <= y < q[3] for q in blurred) for w in women for x in range(int(w[0]), int(w[2])) for y in range(int(w[1]), int(w[3])))
        assert got[s].exposure == pytest.approx(bare / 2000) and got[s].m1_pass == (bare / 2000 <= 0.005 if women else None)
        allowed = [q[1:] for q in ign if q[0] == s] + [(q[0] - m, q[1] - m, q[2] + m, q[3] + m) for q in women for m in [0.1 * ((q[2] - q[0]) * (q[3] - q[1])) ** 0.5]]
        points = [(q, [(q[0] + (i + 0.5) * (q[2] - q[0]) / 60, q[1] + (j + 0.5) * (q[3] - q[1]) / 60) for i in range(60) for j in range(60)]) for q in blurred]
        shares = [sum(any(a[0] <= x < a[2] and a[1] <= y < a[3] for a in allowed) for x, y in p) / 3600 for _, p in points]
        if all(abs(v - 0.5) > 0.05 for v in shares):  # on a grid of points, where that decides
            assert got[s].fp_boxes == sum(v < 0.5 for v in shares)


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0


def test_matchers_differ_and_agree_with_loops(spark):
    rnd = random.Random(4242)
    box = lambda: (x := rnd.randrange(6), y := rnd.randrange(6), x + rnd.randint(3, 6), y + rnd.randint(3, 6))
    det = [(s, i, rnd.randrange(2), rnd.randrange(4), *box()) for s in range(40) for i in range(6)]
    gt = [(s, i, rnd.randrange(2), *box()) for s in range(40) for i in range(5)]
    d = spark.createDataFrame(det, "stem int, det_index int, cls int, conf int, x1 int, y1 int, x2 int, y2 int")
    g = spark.createDataFrame(gt, "stem int, gt_index int, cls int, x1 int, y1 int, x2 int, y2 int")
    want_a, want_b = set(), set()
    for s in range(40):
        ds, gs = [x for x in det if x[0] == s], [x for x in gt if x[0] == s]
        ug, ud = set(), set()
        for _, gi, di in sorted((-v, y[1], x[1]) for x in ds for y in gs if (v := _iou(x[4:], y[3:])) >= 0.3):
            if gi not in ug and di not in ud:
                ug.add(gi), ud.add(di), want_a.add((s, gi, di))
        used = set()
        for x in sorted(ds, key=lambda x: (x[3], *x[4:], -x[1]), reverse=True):
            best = min(((-v, y[1]) for y in gs if y[2] == x[2] and y[1] not in used and (v := _iou(x[4:], y[3:])) >= 0.3), default=None)
            if best:
                used.add(best[1]), want_b.add((s, best[1], x[1]))
    a = {(r.stem, r.gt_index, r.det_index) for r in M.match_greedy(M.pairs(d, g, 0.3)).collect()}
    b = {(r.stem, r.gt_index, r.det_index) for r in M.match_confident(d, g, 0.3).filter("gt_index IS NOT NULL").collect()}
    assert a == want_a and b == want_b


def test_tracks_and_rollup_read_their_input_once(spark, walks):
    """Each frame and each track's detection is worked out once, however many windows and aggregates look at it."""
    frames_read, tracks_read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(total):
        def add(x):
            total.add(1)
            return x

        return F.udf(add, "int").asNondeterministic()

    rows = [r for v in walks.values() for r in v]
    f = spark.createDataFrame(rows, FRAME)
    t = K.build_tracks(f.withColumn("seq", counted(frames_read)("seq")), 0.45)
    assert t.count() > 1000 and frames_read.value == len(rows)
    meta = spark.createDataFrame([(f"v{s}", 25.0, 25.0, 1) for s in walks], "video string, fps double, fps_sane double, every int")
    assert len(K.rollup(f, meta, t.withColumn("seq", counted(tracks_read)("seq")), 0.45).collect()) == len(walks)
    assert tracks_read.value == t.count()


def test_segments_across_chunks(spark, monkeypatch):
    """Chunks without an accepted frame, and frames missing before a chunk's first: segments do not depend on where chunks end."""
    person, faint = [(0, 0.0, 0.0, 50.0, 90.0, 0.9)], [(0, 0.0, 0.0, 50.0, 90.0, 0.2)]
    hits = {"a": {*range(0, 30), *range(41, 70), 90, 91}, "b": {5, 26, 27, 60}, "c": {70}}
    gone = {"a": set(), "b": set(range(8, 26)), "c": set()}
    rows = [(v, i, i * 40.0, person if i in h else faint) for v, h in hits.items() for i in range(100) if i not in gone[v]]
    f, got = spark.createDataFrame(rows, FRAME).repartition(3), []
    for chunk in (1000, 8):
        monkeypatch.setattr(K, "CHUNK", chunk)
        got.append(sorted((r.video, r.seq, r.begin) for r in K.segments(f, 0.45).collect()))
    begin = {"a": lambda i: 0 if i < 90 else 90, "b": lambda i: 5 if i < 60 else 60, "c": lambda i: 70}
    assert got[0] == got[1] == sorted((v, i, begin[v](i)) for v, h in hits.items() for i in h)

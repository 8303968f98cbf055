"""Tracks over frames, their gaps and flips, and rollups of a video (ST1-ST4, W4-W6).

Frames: video, seq (0-based), t (ms), dets array<struct<cls,x1,y1,x2,y2,conf>>. Association is an ordered state machine: in
batch it runs over segments of a video that no track crosses, in a stream the open tracks are the video's keyed state.
Metrics on the tracks are windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from boxtide.scratch import stored

TRACK_SCHEMA = "video string, track long, seq int, cls int, x1 double, y1 double, x2 double, y2 double, conf double"


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


class Tracker:
    """Open tracks of one video: advance() takes a frame and returns (track, detection) for each accepted detection."""

    def __init__(self, conf: float, least: float, gap: int, open_: list | None = None, n: int = 0) -> None:
        self.conf, self.least, self.gap, self.open, self.n = conf, least, gap, open_ or [], n  # open: [track, last seq, last box]

    def advance(self, seq: int, dets: list[tuple]) -> list[tuple[int, tuple]]:
        cand = [d for d in dets if d[5] >= self.conf]
        found = sorted(((v, t, i) for t, o in enumerate(self.open) for i, d in enumerate(cand) if (v := _iou(o[2], d[1:5])) >= self.least), reverse=True)
        of_track: dict[int, int] = {}
        taken: set[int] = set()
        for _, t, i in found:
            if t not in of_track and i not in taken:
                of_track[t] = i
                taken.add(i)
        out = []
        for t, i in of_track.items():
            self.open[t][1:] = [seq, cand[i][1:5]]
            out.append((self.open[t][0], cand[i]))
        for i, d in enumerate(cand):
            if i not in taken:
                self.open.append([self.n, seq, d[1:5]])
                out.append((self.n, d))
                self.n += 1
        self.expire(seq)
        return out

    def expire(self, seq: int) -> None:
        self.open = [o for o in self.open if seq - o[1] <= self.gap]


#: Frames of a video that one window row stands for when gaps are looked for.
CHUNK = 4096


def segments(frames: DataFrame, conf: float, gap: int = 15) -> DataFrame:
    """Frames with an accepted detection, their accepted detections, and the seq at which their segment begins: no track reaches from one segment into the next.

    A frame can continue a track whose last box is at `a` if the frame before it is at most `gap` later than `a`. So a video is cut where
    that fails for the last accepted frame, and segments are tracked apart. Frames are shuffled and sorted once, by chunks of a video, and stored:
    inside a chunk only its first accepted frame needs what lies before, and that comes from one row a chunk."""
    w, over = Window.partitionBy("video", "chunk").orderBy("seq"), Window.partitionBy("video").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    past, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    det = lambda d: F.struct(d["cls"].cast("int").alias("cls"), *[d[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "conf")])
    f = frames.filter("video IS NOT NULL AND seq IS NOT NULL").select("video", "seq", F.floor(F.col("seq") / CHUNK).alias("chunk"), F.transform(F.filter("dets", lambda d: d["conf"] >= conf), det).alias("dets"))
    f = f.withColumn("ok", F.coalesce(F.size("dets") > 0, F.lit(False)))
    hit = F.when(F.col("ok"), F.col("seq"))
    f = f.withColumns({"p": F.lag("seq").over(w), "a": F.max(hit).over(past), "first": F.min(hit).over(so_far)})
    f = f.withColumn("cut", F.when(F.col("ok") & (F.col("p") - F.col("a") > gap), F.col("seq"))).withColumn("begin", F.max("cut").over(so_far))
    f = stored(f.select("video", "chunk", "seq", "ok", "p", "first", "begin", F.when(F.col("ok"), F.col("dets")).alias("dets")))
    per = f.groupBy("video", "chunk").agg(F.max(hit).alias("h"), F.max("seq").alias("last"), F.min(hit).alias("f"), F.min(F.when(F.col("seq") == F.col("first"), F.col("p"))).alias("p"), F.max("begin").alias("c"))
    per = per.withColumns({"h0": F.max("h").over(over), "p0": F.max("last").over(over)})
    per = per.withColumn("own", F.when(F.col("h0").isNull() | (F.coalesce("p", "p0") - F.col("h0") > gap), F.col("f")))
    per = per.withColumn("start", F.coalesce("own", F.max(F.greatest("c", "own")).over(over)))
    goes_on = stored(per.filter("start <> f").select("video", "chunk", "start"))  # chunks that begin inside a segment; broadcast if the file is small
    return f.filter("ok").join(goes_on, ["video", "chunk"], "left").select("video", "seq", "dets", F.coalesce("begin", "start", "first").alias("begin"))


def _boxes(dets) -> list[tuple]:
    return [(int(d["cls"]), float(d["x1"]), float(d["y1"]), float(d["x2"]), float(d["y2"]), float(d["conf"])) for d in (dets if dets is not None else ())]


def build_tracks(frames: DataFrame, conf: float, least: float = 0.3, gap: int = 15) -> DataFrame:
    """ST1, J17: TRACK_SCHEMA rows of each video's tracks, associated segment by segment and numbered on through the video.
    A task walks its segments frame by frame and holds open tracks only. The rows are worked out once and stored, for all that reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, t, last = None, None, None
        for b in batches:
            boxes = list(zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in b.column(3).flatten().flatten()], strict=True))
            end = np.cumsum(pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False)).tolist()
            rows, start = [], 0
            for i, (video, begin, seq) in enumerate(zip(*[b.column(k).to_pylist() for k in range(3)], strict=True)):
                if (video, begin) != key:
                    key, t, last = (video, begin), Tracker(conf, least, gap), None
                if last is not None and seq - last > 1:  # frames without a detection in between only let tracks expire
                    t.expire(seq - 1)
                last = seq
                rows += [(i, track, *d) for track, d in t.advance(seq, boxes[start : end[i]])]
                start = end[i]
            if rows:
                at, *cols = zip(*rows, strict=True)
                video, begin, seq = (b.column(k).take(pa.array(at)) for k in range(3))
                track, cls, *rest = cols
                yield pa.RecordBatch.from_arrays([video, begin, pa.array(track, pa.int64()), seq, pa.array(cls, pa.int32()), *[pa.array(c, pa.float64()) for c in rest]], names=["video", "begin", "track", "seq", "cls", "x1", "y1", "x2", "y2", "conf"])

    parts = segments(frames, conf, gap).select("video", F.col("begin").cast("int").alias("begin"), F.col("seq").cast("int").alias("seq"), "dets")
    own = stored(parts.repartition("video", "begin").sortWithinPartitions("video", "begin", "seq").mapInArrow(run, TRACK_SCHEMA.replace("track long", "begin int, track long")))
    before = F.sum("n").over(Window.partitionBy("video").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    first = own.groupBy("video", "begin").agg((F.max("track") + 1).alias("n")).select("video", "begin", before.alias("first"))
    later = stored(first.filter("first > 0"))  # a video's first segment counts from 0; broadcast if the file is small
    return own.join(later, ["video", "begin"], "left").withColumn("track", F.col("track") + F.coalesce("first", F.lit(0))).select("video", "track", "seq", "cls", "x1", "y1", "x2", "y2", "conf")


class VideoTracks(StatefulProcessor):
    """ST1 on a stream: a video's open tracks as a list, how far it has come as a value, and a timer that closes it."""

    def __init__(self, conf: float, least: float, gap: int, idle_ms: int) -> None:
        self.conf, self.least, self.gap, self.idle_ms = conf, least, gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "seq int, tracks long, timer long")
        self.tracks = handle.getListState("tracks", "track long, seq int, x1 double, y1 double, x2 double, y2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, n, timer = self.at.get() if self.at.exists() else (-1, 0, 0)
        t, out = Tracker(self.conf, self.least, self.gap, [[r[0], r[1], tuple(r[2:])] for r in self.tracks.get()], n), []
        latest = timer - self.idle_ms if timer else 0
        pdf = pd.concat(list(rows)).sort_values("seq")
        for seq, ms, dets in pdf[["seq", "t", "dets"]].itertuples(index=False):
            if seq > at:  # what comes after a later frame was handled is left out
                if seq - at > 1 and at >= 0:
                    t.expire(int(seq) - 1)
                at, latest = int(seq), max(latest, int(ms))
                out += [(key[0], track, at, *d) for track, d in t.advance(at, _boxes(dets))]
        if t.open:
            self.tracks.put([(a, b, *c) for a, b, c in t.open])
        else:
            self.tracks.clear()
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)
        self.at.update((at, t.n, latest + self.idle_ms))
        yield pd.DataFrame(out, columns=["video", "track", "seq", "cls", "x1", "y1", "x2", "y2", "conf"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """The video is over: nothing of it stays. (Rows this late are dropped by the watermark, so it can't begin anew.)"""
        self.tracks.clear()
        self.at.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_tracks(frames: DataFrame, conf: float, least: float = 0.3, gap: int = 15, delay: str = "10 seconds", idle_ms: int = 600_000) -> DataFrame:
    """ST1 on a stream, as rows of TRACK_SCHEMA. t is event time in ms; a video's state goes once the watermark (t less `delay`) is idle_ms past its
    last frame (event time is t + 1: a new watermark stands at 0, and what is not above it is late). Frames of a micro-batch are taken in order of seq. Needs the RocksDB state store, which this sets for the session."""
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = frames.select("video", "seq", "t", "dets", F.timestamp_millis(F.col("t").cast("long") + 1).alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("video").transformWithStateInPandas(VideoTracks(conf, least, gap, idle_ms), TRACK_SCHEMA, "Append", "EventTime")


def effective_fps(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """ST2: from the span of timestamps where that gives 0.5 to 240, else the container's rate over the probing step. meta: video, fps, fps_sane, every."""
    s = frames.groupBy("video").agg(F.count("*").alias("frames"), (F.max_by("t", "seq") - F.min_by("t", "seq")).alias("span"))
    fps = F.when((F.col("frames") >= 2) & (F.col("span") > 0), (F.col("frames") - 1) / (F.col("span") / 1000.0))
    base = F.coalesce(F.nullif(F.col("fps_sane"), F.lit(0.0)), F.col("fps"), F.lit(30.0)) / F.greatest(F.coalesce("every", F.lit(1)), F.lit(1))
    return s.join(meta, "video", "left").select("video", "frames", F.when(fps.between(0.5, 240.0), fps).otherwise(base).alias("fps"))


def steps(tracks: DataFrame) -> DataFrame:
    """Each track's detection with the one before: gap (missed frames), flip, step IoU and drift (over a diagonal) of consecutive frames."""
    w = Window.partitionBy("video", "track").orderBy("seq")
    prev = {f"p_{c}": F.lag(c).over(w) for c in ("seq", "cls", "x1", "y1", "x2", "y2")}
    t = tracks.withColumns(prev)
    from boxtide.functions import geometry as G

    near = F.col("seq") - F.col("p_seq") == 1
    mid = lambda p, k: (F.col(f"{p}{k}1") + F.col(f"{p}{k}2")) / 2
    far = F.sqrt(F.pow(mid("", "x") - mid("p_", "x"), 2) + F.pow(mid("", "y") - mid("p_", "y"), 2))
    diagonal = F.sqrt(F.pow(F.col("p_x2") - F.col("p_x1"), 2) + F.pow(F.col("p_y2") - F.col("p_y1"), 2))
    return t.withColumns({"gap": F.greatest(F.col("seq") - F.col("p_seq") - 1, F.lit(0)), "flip": (F.col("cls") != F.col("p_cls")).cast("int"), "step_iou": F.when(near, G.iou(G.box("p_"), G.box())), "drift": F.when(near, far / F.greatest(diagonal, F.lit(1e-6)))})


def gap_causes(tracks: DataFrame, frames: DataFrame, conf: float, least: float = 0.3) -> DataFrame:
    """ST3: per gap its length and whether detections under the threshold fill at least half of it: threshold_gap, else miss_gap."""
    from boxtide.functions import geometry as G

    s = steps(tracks).filter("gap > 0").select("video", "track", F.col("p_seq").alias("a"), F.col("gap"), *[F.col(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    missed = s.withColumn("seq", F.explode(F.sequence(F.col("a") + 1, F.col("a") + F.col("gap"))))
    low = frames.select("video", "seq", F.explode("dets").alias("d")).filter(F.col("d.conf") < conf)
    hit = missed.join(low, ["video", "seq"]).filter(G.iou(G.fields(F.col("d")), G.box("p_")) >= least).select("video", "track", "a", "seq").distinct()
    n = hit.groupBy("video", "track", "a").agg(F.count("*").alias("n"))
    return s.join(n, ["video", "track", "a"], "left").select("video", "track", F.col("a").alias("after"), "gap", F.when(F.coalesce("n", F.lit(0)) >= F.floor((F.col("gap") + 1) / 2), "threshold_gap").otherwise("miss_gap").alias("cause"))


def spans(tracks: DataFrame) -> DataFrame:
    """ST3, W6: a row per track: first, last, present, span, gaps, flips, majority class (first seen on ties); frames of its span without a detection
    of that class, and how often such a stretch begins. Tracks are shuffled once; a stretch is a step between two detections of the class, so no frame is made up."""
    w, own = Window.partitionBy("video", "track").orderBy("seq"), Window.partitionBy("video", "track", "cls").orderBy("seq")
    seq = F.col("seq")
    t = tracks.select("video", "track", "seq", "cls").withColumns({"p_seq": F.lag("seq").over(w), "p_cls": F.lag("cls").over(w)}).withColumn("o_seq", F.lag("seq").over(own))
    times = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = t.groupBy("video", "track", "cls").agg(
        F.count("*").alias("n"), F.min("seq").alias("f"), F.max("seq").alias("l"), times(seq - F.col("o_seq") > 1).alias("bare"), times(seq - F.col("p_seq") > 1).alias("gaps"), times(F.col("cls") != F.col("p_cls")).alias("flips"),
    )
    m = c.groupBy("video", "track").agg(
        F.min("f").alias("first"), F.max("l").alias("last"), F.sum("n").alias("present"), F.sum("gaps").alias("gaps"), F.sum("flips").alias("flips"), F.max_by(F.struct("cls", "n", "f", "l", "bare"), F.struct("n", -F.col("f"))).alias("x"),
    ).withColumn("span", F.col("last") - F.col("first") + 1)
    events = F.col("x.bare") + (F.col("x.f") > F.col("first")).cast("int") + (F.col("x.l") < F.col("last")).cast("int")
    return m.select("video", "track", "first", "last", "present", "span", "gaps", "flips", F.col("x.cls").alias("majority"), (F.col("span") - F.col("x.n")).alias("exposed_frames"), events.alias("exposure_events"))


def track_metrics(tracks: DataFrame, conf: float, band: float = 0.05) -> DataFrame:
    """ST3: the rows of spans() with each track's confidence and jitter."""
    m = steps(tracks).groupBy("video", "track").agg(
        F.avg("conf").alias("conf_mean"), F.stddev_pop("conf").alias("conf_std"),
        F.avg(F.when(F.col("conf") < conf + band, 1.0).otherwise(0.0)).alias("straddle"), F.percentile("step_iou", F.lit(0.5)).alias("jitter_iou_median"), F.percentile("drift", F.lit(0.5)).alias("drift_median"),
    )
    return spans(tracks).join(m, ["video", "track"])


def rollup(frames: DataFrame, meta: DataFrame, tracks: DataFrame, conf: float, targets: tuple[int, ...] = (0, 1), least_s: float = 0.5, phantom_s: float = 0.3) -> DataFrame:
    """ST4: per video: tracks, real ones, phantoms, toggles and flips a minute, and exposure of the target classes."""
    m = effective_fps(frames, meta).join(spans(tracks), "video", "left")
    m = m.withColumns({"real": F.col("present") >= F.greatest(F.lit(3), F.bround(F.lit(least_s) * F.col("fps"))), "phantom": F.col("present") <= F.greatest(F.lit(2), F.bround(F.lit(phantom_s) * F.col("fps")))})
    real = lambda c, v: F.sum(F.when(F.col("real") & c, v).otherwise(0))
    exposed = {f"{name}_{t}": real(F.col("majority") == t, F.col(name)) for t in targets for name in ("exposed_frames", "exposure_events")}
    out = m.groupBy("video", "frames", "fps").agg(
        F.count("track").alias("tracks"), F.coalesce(F.sum(F.col("real").cast("int")), F.lit(0)).alias("real"), F.coalesce(F.sum(F.col("phantom").cast("int")), F.lit(0)).alias("phantoms"),
        real(F.lit(True), 2 * F.col("gaps")).alias("toggles"), real(F.lit(True), F.col("flips")).alias("flips"), *[v.alias(k) for k, v in exposed.items()],
    )
    minutes = F.greatest(F.col("frames") / F.col("fps") / 60.0, F.lit(1e-6))
    rates = [(F.col(c) / minutes).alias(f"{c}_per_min") for c in ("toggles", "flips", "phantoms")]
    return out.select("video", "frames", "fps", "tracks", "real", "phantoms", "toggles", "flips", *rates, *exposed)

"""Queries over ordered frames, ledgers, and file streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtide.plans.fixtures import load
from boxtide.scratch import scratch
from boxtide.streaming import ingest as I
from boxtide.streaming import tracks as K

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def frames(s, d):
    """A video per user: each event is a frame; boxes drift with its place and drop out now and then."""
    e = load(s, d, "events").withColumn("seq", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    box = lambda n, dx: F.struct(F.when(k % 10 == n, (F.lit(n) + 1) % 2).otherwise(n).cast("int").alias("cls"), (F.col("seq") % 40 + dx).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("seq") % 40 + dx + 60).cast("double").alias("x2"), F.lit(80.0).alias("y2"), (F.lit(0.3) + k / 200.0).alias("conf"))
    dets = F.when(k % 7 == 0, F.array(box(1, 200))).when(k % 5 == 0, F.array(box(0, 0))).otherwise(F.array(box(0, 0), box(1, 200)))
    return e.select(F.col("user_id").cast("string").alias("video"), "seq", (F.col("seq") * 40.0).alias("t"), dets.alias("dets"))


def meta(s, d):
    return load(s, d, "events").select(F.col("user_id").cast("string").alias("video")).distinct().withColumns({"fps": F.lit(30.0), "fps_sane": F.lit(25.0), "every": F.lit(1)})


@query("SELECT user_id::VARCHAR AS video, count(*) AS frames, CASE WHEN count(*) >= 2 THEN (count(*) - 1) / ((count(*) - 1) * 40.0 / 1000.0) ELSE 25.0 END::DOUBLE AS fps FROM events GROUP BY 1")
def frame_rates(s, d):
    """ST2."""
    return K.effective_fps(frames(s, d), meta(s, d))


_IOU = "((60 - abs({0})) * 80)::DOUBLE / (9600 - (60 - abs({0})) * 80)"
#: A lane per person of the fixture, whose boxes never meet the other's; each walks its accepted boxes with the list of open tracks.
_TRACKS = f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS video, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS seq, (props::JSON ->> '$.k')::INT AS k FROM events),
d AS (SELECT video, seq, lane, CASE WHEN k % 10 = lane THEN (lane + 1) % 2 ELSE lane END AS cls, seq % 40 AS x, 0.3::DOUBLE + k / 200.0::DOUBLE AS conf FROM e, (VALUES (0), (1)) v(lane) WHERE NOT ((k % 7 = 0 AND lane = 0) OR (k % 7 <> 0 AND k % 5 = 0 AND lane = 1))),
o AS (SELECT *, row_number() OVER (PARTITION BY video, lane ORDER BY seq) AS rn FROM d WHERE conf >= 0.45::DOUBLE),
w AS (SELECT video, lane, rn, seq, seq AS t, [{{'t': seq, 'l': seq, 'x': x}}] AS live FROM o WHERE rn = 1
  UNION ALL SELECT video, lane, rn, seq, coalesce(al[pick].t, seq), CASE WHEN pick IS NULL THEN list_append(al, {{'t': seq, 'l': seq, 'x': x}}) ELSE list_transform(range(1, len(al) + 1), lambda i: CASE WHEN i = pick THEN {{'t': al[i].t, 'l': seq, 'x': x}} ELSE al[i] END) END
  FROM (SELECT *, list_max(list_filter(list_transform(range(1, len(al) + 1), lambda i: {{'v': {_IOU.format("al[i].x - x")}, 'i': i}}), lambda c: c.v >= 0.3 AND c.v IS NOT NULL)).i AS pick
    FROM (SELECT o.video, o.lane, o.rn, o.seq, o.x, list_filter(w.live, lambda p: o.seq - 1 - p.l <= 15) AS al FROM w JOIN o ON o.video = w.video AND o.lane = w.lane AND o.rn = w.rn + 1))),
tr AS (SELECT o.*, w.t, (dense_rank() OVER (PARTITION BY o.video ORDER BY w.t, o.lane) - 1)::BIGINT AS track FROM o JOIN w USING (video, lane, rn)),
st AS (SELECT *, lag(seq) OVER p AS p_seq, lag(cls) OVER p AS p_cls, lag(x) OVER p AS p_x FROM tr WINDOW p AS (PARTITION BY video, track ORDER BY seq))"""


@query(_TRACKS + """, fr AS (SELECT video, count(*) AS frames, CASE WHEN count(*) >= 2 THEN (count(*) - 1) / ((count(*) - 1) * 40.0 / 1000.0) ELSE 25.0 END::DOUBLE AS fps FROM e GROUP BY 1),
m AS (SELECT video, track, min(seq) AS f, max(seq) AS l, count(*) AS present, sum((seq - p_seq > 1)::INT) AS gaps, sum((cls <> p_cls)::INT) AS flips FROM st GROUP BY ALL),
mj AS (SELECT video, track, arg_max(cls, (n, -f)) AS majority FROM (SELECT video, track, cls, count(*) AS n, min(seq) AS f FROM tr GROUP BY ALL) GROUP BY ALL),
k AS (SELECT m.*, majority, present >= greatest(3, round_even(0.5 * fps, 0)) AS real, present <= greatest(2, round_even(0.3::DOUBLE * fps, 0)) AS phantom FROM m JOIN mj USING (video, track) JOIN fr USING (video)),
x AS (SELECT k.video, k.track, k.majority, q.seq, coalesce(tr.cls = k.majority, false) AS ok FROM (SELECT *, unnest(range(f, l + 1)) AS seq FROM k WHERE real AND majority < 2) q JOIN k USING (video, track) LEFT JOIN tr ON tr.video = k.video AND tr.track = k.track AND tr.seq = q.seq),
y AS (SELECT *, NOT ok AND coalesce(lag(ok) OVER (PARTITION BY video, track ORDER BY seq), true) AS begins FROM x),
z AS (SELECT video, sum((NOT ok AND majority = 0)::INT) AS f0, sum((begins AND majority = 0)::INT) AS e0, sum((NOT ok AND majority = 1)::INT) AS f1, sum((begins AND majority = 1)::INT) AS e1 FROM y GROUP BY 1),
r AS (SELECT video, count(*) AS tracks, sum(real::INT) AS real, sum(phantom::INT) AS phantoms, sum(CASE WHEN real THEN 2 * coalesce(gaps, 0) ELSE 0 END) AS toggles, sum(CASE WHEN real THEN coalesce(flips, 0) ELSE 0 END) AS flips FROM k GROUP BY 1),
a AS (SELECT fr.video, frames, fps, coalesce(tracks, 0)::BIGINT AS tracks, coalesce(real, 0)::BIGINT AS real, coalesce(phantoms, 0)::BIGINT AS phantoms, coalesce(toggles, 0)::BIGINT AS toggles, coalesce(flips, 0)::BIGINT AS flips, greatest(frames / fps / 60.0, 1e-6) AS mins,
  coalesce(f0, 0)::BIGINT AS exposed_frames_0, coalesce(e0, 0)::BIGINT AS exposure_events_0, coalesce(f1, 0)::BIGINT AS exposed_frames_1, coalesce(e1, 0)::BIGINT AS exposure_events_1 FROM fr LEFT JOIN r USING (video) LEFT JOIN z USING (video))
SELECT * EXCLUDE (mins), round(toggles / mins, 6) AS toggles_per_min, round(flips / mins, 6) AS flips_per_min, round(phantoms / mins, 6) AS phantoms_per_min FROM a""")
def track_rollup(s, d):
    """ST1, ST3, ST4, J17, W4-W6: the oracle walks every video frame by frame."""
    f = frames(s, d)
    out = K.rollup(f, meta(s, d), K.build_tracks(f, 0.45), 0.45)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_per_min")})


@query(_TRACKS + f""", gp AS (SELECT video, track, lane, p_seq AS after, seq - p_seq - 1 AS gap, p_x FROM st WHERE seq - p_seq > 1),
lo AS (SELECT g.video, g.track, g.after, count(DISTINCT d.seq) AS n FROM gp g JOIN d ON d.video = g.video AND d.lane = g.lane AND d.seq > g.after AND d.seq <= g.after + g.gap AND d.conf < 0.45::DOUBLE WHERE {_IOU.format("d.x - g.p_x")} >= 0.3 GROUP BY ALL)
SELECT video, track, after, gap, CASE WHEN coalesce(n, 0) >= (gap + 1) // 2 THEN 'threshold_gap' ELSE 'miss_gap' END AS cause FROM gp LEFT JOIN lo USING (video, track, after)""")
def track_gaps(s, d):
    """ST3, W5: gaps and their causes."""
    f = frames(s, d)
    return K.gap_causes(K.build_tracks(f, 0.45), f, 0.45)


@query("SELECT event_type AS grp, count(*) AS wanted, sum((user_id % 3 = 0)::INT)::BIGINT AS done, sum((user_id % 3 <> 0 AND user_id % 5 = 0)::INT)::BIGINT AS in_flight, sum((user_id % 3 <> 0 AND user_id % 5 <> 0)::INT)::BIGINT AS pending FROM events GROUP BY 1")
def progress(s, d):
    """ST6, J13."""
    e = load(s, d, "events").select(F.col("event_id").alias("k"), "user_id", F.col("event_type").alias("grp"))
    return I.progress(e.select("k", "grp"), e.filter("user_id % 3 = 0"), e.filter("user_id % 5 = 0"), ["k"], ["grp"])


@query("SELECT (event_id % 50)::BIGINT AS k, any_value(CASE WHEN user_id >= 0 THEN 'done' END) AS state FROM events GROUP BY 1 UNION ALL SELECT k, 'in_flight' FROM range(50, 60) t(k)")
def ledger(s, d):
    """J13, ST5: answers joined to what was reserved; repeated answers count once."""
    answers = load(s, d, "events").select((F.col("event_id") % 50).alias("k"), "user_id")
    return I.ledger(s.range(60).select(F.col("id").alias("k")), answers, ["k"]).select("k", "state")


#: How the events come in: the part of the day's order decides the file, some come again in the next one, some only at the very end.
_PARTS = 4
_LATE = "event_id % 97 = 5"


def _arriving(s, d):
    """part, late, id, kind and ts (whole seconds) of every event."""
    e = load(s, d, "events").select("event_id", "event_type", "user_id", F.date_trunc("second", "ts").alias("ts"))
    q = e.agg(F.min(F.unix_timestamp("ts")).alias("lo"), F.max(F.unix_timestamp("ts")).alias("hi"))
    at = F.least(F.floor((F.unix_timestamp("ts") - F.col("lo")) * _PARTS / (F.col("hi") - F.col("lo") + 1)), F.lit(_PARTS - 1))
    return e.join(F.broadcast(q), F.lit(True)).select(at.cast("int").alias("part"), F.expr(_LATE).alias("late"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "ts")


def _streamed(s, d):
    """Files appear one after the other; after each the stream is started from its checkpoint and runs until nothing is left; at the end once more without a new file."""
    a = _arriving(s, d).persist()
    top = scratch(s)
    for k in range(_PARTS + 1):
        own = a.filter((F.col("part") == k) & ~F.col("late")) if k < _PARTS else a.filter("late")
        again = a.filter((F.col("part") == k - 1) & ~F.col("late") & (F.col("id") % 5 == 0)) if 0 < k < _PARTS else a.limit(0)
        rows = own.unionByName(again).select(F.to_json(F.struct("id", "kind", "ts")).alias("value"))
        rows.coalesce(1).write.mode("append").text(f"{top}/in")
        for _ in range(1 + (k == _PARTS)):
            I.stream_into(I.verdict_stream(s, f"{top}/in", "id long, kind string, ts timestamp", ["id"], "ts", "1 hour"), f"{top}/table", f"{top}/checkpoint")
    a.unpersist()
    return s.read.parquet(f"{top}/table")


_SEEN = f"""WITH x AS (SELECT event_id AS id, event_type AS kind, date_trunc('second', ts) AS t, {_LATE} AS late FROM events), q AS (SELECT min(epoch(t)) AS lo, max(epoch(t)) AS hi FROM x),
p AS (SELECT x.*, least(floor((epoch(t) - lo) * {_PARTS} / (hi - lo + 1)), {_PARTS - 1}) AS part FROM x, q), top AS (SELECT max(t) - INTERVAL 1 HOUR AS mark FROM p WHERE NOT late),
seen AS (SELECT id, kind, t AS ts FROM p, top WHERE NOT late OR t > mark)"""


@query(_SEEN + " SELECT id, kind, ts FROM seen")
def event_stream(s, d):
    """ST5, S22, K3: a file stream into a table in five runs from one checkpoint; what comes again within an hour of event time counts once, what comes an hour late is dropped, a run without new files adds nothing."""
    return _streamed(s, d).select("id", "kind", "ts")


@query(_SEEN + " SELECT x.kind AS grp, count(*) AS wanted, count(seen.id) AS done, sum((seen.id IS NULL AND x.late)::INT)::BIGINT AS in_flight, sum((seen.id IS NULL AND NOT x.late)::INT)::BIGINT AS pending FROM x LEFT JOIN seen ON seen.id = x.id GROUP BY 1")
def stream_progress(s, d):
    """ST6: what the stream's table has of all that was wanted, by kind; the late ones count as in flight."""
    a = _arriving(s, d).withColumnRenamed("kind", "grp")
    return I.progress(a.select("id", "grp"), _streamed(s, d), a.filter("late"), ["id"], ["grp"])

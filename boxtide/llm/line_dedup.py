"""Repeated runs of lines, found by a suffix array over line-ID sequences.

Lines with a word are numbered within their document; each distinct line that occurs again gets an ID (by its 128-bit
BLAKE2 digest), spaced so that its occurrences have as many places in the order of suffixes. Only such lines can be part
of a repeated run, so a document's sequence falls into segments of them; segments with fewer than WORDS words in all are
left out, and of equal segments all but the first are copies whole. The suffixes of the others are sorted by distributed prefix doubling: in round k a suffix is ranked by its
rank over 2**k lines and that of the suffix 2**k lines on (none sorts first), ranks being running counts over the
range-sorted distinct pairs. Only suffixes that still share their rank with one that goes on take part, and documents
without any leave the rounds. Equal suffixes then have equal ranks: all but the first in the corpus (documents ascend by
doc_id) are copies whole. The first ones, in order, are cut into ranges; the longest common prefix of neighbours is read
from the kept ranks by binary lifting, and a pass over each range gives every suffix the longest run of at least WORDS
words that it shares with an earlier one, from the nearest earlier ones on both sides; of the other ranges it needs only,
for each length of prefix that reaches over its ends, the first document there. Later copies are deleted.

Ranges are as many as adaptive execution makes of their bytes, so that small rounds do not write many small files.

No line, first line or passage is gathered in one task: pairs are counted before they are sorted, ranges split the
suffixes of one line, and joins have distinct keys on one side. Bounds: a document's lines (a group of a window), a
range of distinct suffixes (a task), and for the driver one number of each partition, and of its ends at most one entry
for each length of prefix (no more than the lines of the longest document).

Defined results: a null text is empty and comes back empty; lines without words are never deleted; a document may lose
all its lines and stays as a row; rows that repeat doc_id and text are one document; a null doc_id comes first; an
empty table gives an empty result; other columns pass through, whatever their names but `ld_*`, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from . import textkernel as tk
from .common import forget, ship, table, text_of, written

WORDS = 50
#: How often segments that are copies whole are taken out before suffixes are sorted.
PASSES = 3
#: Place of a line in the order of the corpus: document (by ld_d, ld_v) and line.
AT = ["d", "v", "s"]
_NONE, _ALL = -1, 2**31 - 1


def _real_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and words of the lines with words."""
    ws, _, _ = tk.words(data, off)
    start, end, row = tk.words(data, off, tk.NEWLINE)
    n = np.searchsorted(ws, end) - np.searchsorted(ws, start)
    return start[n > 0], end[n > 0], row[n > 0], n[n > 0]


def _line_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines with words of each row: those with a byte that is no white space."""
    if not len(data):
        return np.zeros(len(off) - 1, np.int64)
    blank = tk.SPACE[data]
    start = np.union1d(np.flatnonzero(data == 10), off[:-1][off[:-1] < len(data)])
    row = np.searchsorted(off, start, "right") - 1
    return np.bincount(row[~np.logical_and.reduceat(blank, start)], minlength=len(off) - 1)


def _lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for a, b, data, off in tk.blocks(batch.column(2)):
            start, end, row, n = _real_lines(data, off)
            raw = memoryview(data.tobytes())
            h = np.frombuffer(b"".join([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), end.tolist(), strict=True)]), np.int64)
            seq = np.arange(len(row)) - np.searchsorted(row, np.arange(b - a))[row]
            at = pa.array(row)
            cols = [batch.column(0).slice(a, b - a).take(at), batch.column(1).slice(a, b - a).take(at), pa.array(seq.astype(np.int32)), pa.array(h[0::2]), pa.array(h[1::2]), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "v", "s", "h", "h2", "w"])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ld_d, ld_v: a document and its place in the order."""
    return docs.drop("ld_d", "ld_v").withColumns({"ld_d": F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))), "ld_v": F.xxhash64(text_of(docs))})


def _numbered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, h2, count) -> (h, h2, id): ids are so far apart that each has as many places as its line occurs."""
    base = TaskContext.get().partitionId() << 40
    for b in rows:
        count = b.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base + np.cumsum(count) - count)], names=["h", "h2", "id"])
        base += int(count.sum())


def _islands(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (d, v, s, id, w) of whole documents in order -> those in segments of WORDS words and more, with the words (rest) and lines (n) from
    there to the segment's end, its first line (s0) and a digest of its IDs (key)."""
    rest: pa.Table | None = None

    def cut(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        d, v, s, ids, w = (t.column(i).to_numpy() for i in range(5))
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1] + 1)
        start = np.flatnonzero(new)
        of, end = np.cumsum(new) - 1, np.append(start[1:], len(d))
        words = np.add.reduceat(w.astype(np.int64), start)
        before = np.cumsum(w.astype(np.int64)) - w
        long = words >= WORDS
        keys = np.empty(len(start), object)
        for k in np.flatnonzero(long).tolist():
            keys[k] = hashlib.blake2b(ids[start[k] : end[k]].tobytes(), digest_size=16).digest()
        at = np.flatnonzero(long[of])
        k = of[at]
        cols = [t.column(i).take(pa.array(at)).combine_chunks() for i in range(4)] + [pa.array(w[at].astype(np.int64)), pa.array((words[k] - (before[at] - before[start[k]])).astype(np.int32)), pa.array((end[k] - at).astype(np.int32)), pa.array(s[start[k]]), pa.array(keys[k], pa.binary())]
        yield from pa.Table.from_arrays(cols, names=["d", "v", "s", "id", "w", "rest", "n", "s0", "key"]).to_batches()

    for batch in rows:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        d, v = t.column(0).to_numpy(), t.column(1).to_numpy()
        other = np.flatnonzero((d != d[-1]) | (v != v[-1]))  # the last document may go on
        whole = int(other[-1]) + 1 if len(other) else 0
        rest = t.slice(whole)
        yield from cut(t.slice(0, whole))
    if rest is not None:
        yield from cut(rest)


def segments(lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Lines that occur again, as a written() table: d, v, s, id, w, and the words (rest) and lines (n) from there to their segment's end; and the
    segments (d, v, s, lines) that are copies of an earlier one whole. The table of lines is used up.

    Of equal segments only the first goes on: what it shares with others, they share with it, and it comes first. That may leave lines that
    no longer occur again, and so shorter segments, of which some are equal; PASSES bounds how often that is used, not what is found."""
    again = written(lines.groupBy("h", "h2").agg(F.count("*").alias("c")).filter("c > 1").mapInArrow(_numbered, "h long, h2 long, id long"))
    r = lines.join(again, ["h", "h2"]).select(*AT, "id", "w").repartition("d", "v").dropDuplicates(AT)
    copies, place, used = None, F.struct(*AT), [lines, again]
    for left in range(PASSES, -1, -1):
        cut = written(r.sortWithinPartitions(*AT).mapInArrow(_islands, "d long, v long, s int, id long, w long, rest int, n int, s0 int, key binary"))
        for old in used:
            forget(old)
        used = [cut]
        if not left:
            break
        starts = cut.filter("s = s0").select("key", *AT, "n")
        many = written(starts.groupBy("key").agg(F.min(place).alias("x"), F.count("*").alias("c")).filter("c > 1"))  # apart, so that the join can split a key
        gone = written(starts.join(many, "key").filter(place != F.col("x")).select(*AT, F.col("n").alias("lines")))
        if gone.isEmpty():
            break
        copies = gone if copies is None else copies.unionAll(gone)
        kept = cut.join(gone.select("d", "v", F.col("s").alias("s0")), ["d", "v", "s0"], "left_anti")
        still = kept.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
        r = kept.join(still, "id").select(*AT, "id", F.col("w").cast("int").alias("w")).repartition("d", "v")
    return cut, copies


def _ranked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r, r2, c) -> (r, r2, new): r and the running count within r, in order of r2, across range partitions; and the written() table it reads."""
    spark = pairs.sparkSession
    part = written(pairs.repartitionByRange("r", "r2").withColumn("pid", F.spark_partition_id()))
    ends = part.groupBy("pid", "r").agg(F.sum("c").alias("c")).groupBy("pid").agg(F.min("r").alias("low"), F.max(F.struct("r", "c")).alias("high")).collect()  # a row a partition
    carry, last, count = [], None, 0
    for e in sorted(ends, key=lambda e: e["pid"]):
        goes_on = e["low"] == last
        if goes_on:
            carry.append((e["pid"], e["low"], count))
        count = e["high"]["c"] + (count if goes_on and e["low"] == e["high"]["r"] else 0)
        last = e["high"]["r"]
    offset = F.broadcast(spark.createDataFrame(carry, "pid int, r long, before long"))  # at most a row a partition
    w = Window.partitionBy("pid", "r").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    inside = part.withColumn("new", F.col("r") + F.coalesce(F.sum("c").over(w), F.lit(0)))
    return inside.join(offset, ["pid", "r"], "left").withColumn("new", F.col("new") + F.coalesce("before", F.lit(0))).drop("pid", "before"), part


def suffix_ranks(seg: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The suffix array's order (d, v, s, id, n, rest, r; equal suffixes share r), and for each round the ranks r over
    2**k lines, with their words w, of the suffixes that have as many lines and share that rank."""
    one = Window.partitionBy("d", "v").orderBy("s")

    def ahead(df: DataFrame, step: int) -> DataFrame:
        """With rank and words of the suffix `step` lines on, in the same segment."""
        inside = F.col("n") > step
        return df.withColumns({"r2": F.coalesce(F.when(inside, F.lead("r", step).over(one)), F.lit(_NONE).cast("long")), "w2": F.coalesce(F.when(inside, F.lead("w", step).over(one)), F.lit(0).cast("long"))})

    first = seg.select(*AT, "id", "n", "rest", "w", F.col("id").alias("r"), F.lit(True).alias("live"))
    rows = written(ahead(first, 1))
    forget(seg)
    levels, settled, step = [rows.select(*AT, "r", "w")], [], 1
    while rows.filter("live").limit(1).count():
        pairs = rows.filter("live").groupBy("r", "r2").agg(F.count("*").alias("c"), F.max("n").alias("top"))
        ranks, part = _ranked(pairs)
        done = rows.withColumn("w", F.col("w") + F.col("w2")).drop("live", "w2").join(ranks, ["r", "r2"], "left")
        shared, fresh = F.col("c") > 1, F.col("new").isNotNull()
        done = done.select(*AT, "id", "n", "rest", "w", F.coalesce("new", "r").alias("r"), F.coalesce(shared & (F.col("top") > 2 * step), F.lit(False)).alias("live"), fresh.alias("fresh"), F.coalesce(shared, F.lit(False)).alias("shared"))
        done = done.repartition("d", "v").withColumn("stays", F.max("live").over(Window.partitionBy("d", "v")))
        done = written(ahead(done, 2 * step))
        forget(part)
        step *= 2
        levels.append(done.filter((F.col("n") >= step) & F.col("fresh") & F.col("shared")).select(*AT, "r", "w"))
        settled.append(done.filter("fresh AND NOT live"))
        rows = done.filter("stays").select(*rows.columns)
    order = None
    for part in settled or [rows.filter("false")]:
        part = part.select(*AT, "id", "n", "rest", "r")
        order = part if order is None else order.unionAll(part)
    return order, levels


def neighbours(first: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Distinct suffixes (r, d, v, s, id, n) -> pid, r, d, v, s, l: l lines, of WORDS words or more, are shared with the one before, else 0."""
    spark = first.sparkSession
    rows = ranged = written(first.repartitionByRange("r").withColumn("pid", F.spark_partition_id()))
    fields = ["d", "v", "s", "n", "id"]
    ends = rows.groupBy("pid").agg(F.max_by(F.struct(*fields), "r").alias("x")).collect()  # a row a partition
    ends = sorted(ends, key=lambda e: e["pid"])
    carry = [(b["pid"], *a["x"]) for a, b in zip(ends, ends[1:], strict=False)]
    over = F.broadcast(spark.createDataFrame(carry, "pid int, d long, v long, s int, n int, id long").select("pid", F.struct(*fields).alias("last")))
    w = Window.partitionBy("pid").orderBy("r")
    rows = rows.withColumns({"x": F.lag(F.struct(*fields)).over(w)}).join(over, "pid", "left").withColumn("x", F.coalesce("x", "last"))
    m = F.when(F.col("x.id") == F.col("id"), F.least("n", F.col("x.n")))
    top = F.least(F.floor(F.log2(m + F.lit(0.5))), F.lit(len(levels) - 1)).cast("int")
    pairs = written(rows.select("pid", "r", *AT, *[F.col(f"x.{c}").alias(f"{c}2") for c in AT], m.alias("m"), top.alias("top"), F.lit(0).alias("l"), F.lit(0).cast("long").alias("lw")))
    forget(ranged)
    cur = None
    for k in range(len(levels) - 1, -1, -1):
        here, last = pairs.filter(F.col("top") == k), cur
        cur = here if cur is None else cur.unionAll(here)
        a = levels[k].select(F.col("d"), F.col("v"), F.col("s").alias("at"), F.col("r").alias("ra"), F.col("w").alias("wa"))
        b = levels[k].select(F.col("d").alias("d2"), F.col("v").alias("v2"), F.col("s").alias("at2"), F.col("r").alias("rb"))
        room = F.col("m") - F.col("l") >= (1 << k)
        tried = cur.withColumns({"at": F.when(room, F.col("s") + F.col("l")), "at2": F.when(room, F.col("s2") + F.col("l"))}).join(a, ["d", "v", "at"], "left").join(b, ["d2", "v2", "at2"], "left")
        hit = F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))
        cur = written(tried.withColumns({"l": F.col("l") + F.when(hit, 1 << k).otherwise(0), "lw": F.col("lw") + F.when(hit, F.col("wa")).otherwise(0)}).select(*pairs.columns))
        if last is not None:
            forget(last)
    shared = F.when(F.col("lw") >= WORDS, F.col("l")).otherwise(0)
    return cur.select("pid", "r", *AT, shared.alias("l")).unionAll(pairs.filter("top IS NULL").select("pid", "r", *AT, "l"))


Front = list[tuple[int, tuple[int, int, int]]]  # (lines shared, place): fewer lines, earlier place


def _front(entries: Front) -> Front:
    """Of these, what is earlier than all that share more."""
    out: Front = []
    for lines, place in sorted(entries, key=lambda e: (-e[0], e[1])):
        if lines and (not out or place < out[-1][1]):
            out.append((lines, place))
    return out


def _carried(front: Front, place: tuple[int, int, int], least: int) -> int:
    for lines, other in front:
        if other < place:
            return min(lines, least)
    return 0


class _Range:
    """Consecutive distinct suffixes, and the lines each shares with the one before."""

    def __init__(self, d: np.ndarray, v: np.ndarray, s: np.ndarray, shared: np.ndarray) -> None:
        self.cols, self.shared = (d, v, s), shared.tolist()
        place = np.empty(len(d), np.int64)
        place[np.lexsort((s, v, d))] = np.arange(len(d))
        self.place = place.tolist()

    def key(self, i: int) -> tuple[int, int, int]:
        return tuple(int(c[i]) for c in self.cols)  # type: ignore[return-value]

    def ends(self) -> tuple[Front, Front, int]:
        """What can be reached from the range before it, from the range after it, and the least shared on the way through."""
        fronts = []
        n = len(self.place)
        # from before, the way to row i takes in the lines shared by rows 0 to i; from after, by rows i + 1 to the last
        for walk, step in ((range(n), 0), (range(n - 1, -1, -1), 1)):
            least, low, front = _ALL, n, []
            for i in walk:
                if i + step < n:
                    least = min(least, self.shared[i + step])
                if not least:
                    break
                if self.place[i] < low:
                    low = self.place[i]
                    front.append((least, self.key(i)))
            fronts.append(_front(front))
        return fronts[0], fronts[1], min(self.shared)

    def longest(self, before: Front, after: Front) -> np.ndarray:
        """For each suffix the most lines shared with an earlier place."""
        n = len(self.place)
        best = np.zeros(n, np.int32)
        for walk, step, front in ((range(n), 0, before), (range(n - 1, -1, -1), 1, after)):
            stack: list[tuple[int, int]] = []  # places that ascend, and the least shared with the one below
            least = _ALL
            for i in walk:
                low = self.shared[i + step] if i + step < n else _ALL
                least = min(least, low)
                if not low:
                    stack.clear()
                while stack and stack[-1][0] > self.place[i]:
                    low = min(low, stack.pop()[1])
                found = low if stack else _carried(front, self.key(i), least) if least and front else 0
                if found > best[i]:
                    best[i] = found
                stack.append((self.place[i], low))
        return best


def _ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Range]]:
    """Rows pid, d, v, s, l by pid and rank."""
    held: list[pa.RecordBatch] = []

    def take() -> tuple[int, _Range]:
        t = pa.Table.from_batches(held)
        held.clear()
        return t.column(0)[0].as_py(), _Range(*[t.column(i).to_numpy() for i in range(1, 5)])

    for batch in rows:
        pid = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(pid)) + 1).tolist(), len(pid)]
        for a, b in zip(cut, cut[1:], strict=False):
            if a < b:
                if held and held[0].column(0)[0].as_py() != pid[a]:
                    yield take()
                held.append(batch.slice(a, b - a))
    if held:
        yield take()


def _over_ranges(near: DataFrame, of: Callable, schema: str) -> DataFrame:
    dealt = near.repartition("pid").sortWithinPartitions("pid", "r").select("pid", *AT, "l")
    return dealt.mapInArrow(of, schema)


def earlier(near: DataFrame) -> DataFrame:
    """d, v, s, lines: the longest run that a distinct suffix shares with an earlier place."""

    def ends(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, r in _ranges(rows):
            before, after, through = r.ends()
            got = [(pid, 0, x, *p) for x, p in before] + [(pid, 1, x, *p) for x, p in after] + [(pid, 2, through, 0, 0, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32()], strict=True)], names=["pid", "side", "l", "d", "v", "s"])

    fronts: dict[int, tuple[Front, Front, list[int]]] = {}
    for e in _over_ranges(near, ends, "pid int, side int, l int, d long, v long, s int").collect():
        f = fronts.setdefault(e["pid"], ([], [], []))
        f[e["side"]].append(e["l"] if e["side"] == 2 else (e["l"], (e["d"], e["v"], e["s"])))
    before: dict[int, Front] = {}
    after: dict[int, Front] = {}
    for out, side, pids in ((before, 1, sorted(fronts)), (after, 0, sorted(fronts, reverse=True))):
        front: Front = []
        for pid in pids:
            out[pid] = front
            through = fronts[pid][2][0]
            front = _front([*fronts[pid][side], *[(min(x, through), p) for x, p in front]])

    def runs_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, r in _ranges(rows):
            best = r.longest(before[pid], after[pid])
            at = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in r.cols], pa.array(best[at])], names=[*AT, "lines"])

    return _over_ranges(near, runs_of, "d long, v long, s int, lines int")


def runs(docs: DataFrame) -> DataFrame:
    """d, v, s, lines: runs to delete."""
    lines = written(docs.select("ld_d", "ld_v", text_of(docs).alias("text")).mapInArrow(_lines, "d long, v long, s int, h long, h2 long, w int"))
    seg, whole = segments(lines)
    order, levels = suffix_ranks(seg)
    order = order.filter(F.col("rest") >= WORDS)
    place = F.struct(*AT)
    first = written(order.groupBy("r").agg(F.min(place).alias("x"), F.first("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("c")))
    copies = order.select("r", *AT, F.col("n").alias("lines")).join(first.filter("c > 1").select("r", "x"), "r").filter(place != F.col("x")).select(*AT, "lines")
    found = copies.unionAll(earlier(written(neighbours(first.select("r", "x.*", "id", "n"), levels))))
    return found if whole is None else found.unionAll(whole)


def apply(docs: DataFrame) -> DataFrame:
    """docs with text cleaned, and ld_lines, ld_deleted (counts of lines with words)."""
    docs = docs.drop("ld_lines", "ld_deleted", "ld_runs")
    names = docs.columns
    keyed = _keyed(docs)
    found = runs(keyed).groupBy(F.col("d").alias("ld_d"), F.col("v").alias("ld_v")).agg(F.collect_list(F.struct("s", "lines")).alias("ld_runs"))  # at most a document's lines
    joined = keyed.join(written(found).hint("merge"), ["ld_d", "ld_v"], "left")  # texts move once at any size
    text_at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in tk.blocks(batch.column(text_at)):
                rows = batch.slice(a, b - a)
                lines = _line_counts(data, off)
                texts, gone = pc.fill_null(rows.column(text_at), ""), np.zeros(b - a, np.int64)
                some = np.flatnonzero(pc.is_valid(rows.column(len(names))).to_numpy(zero_copy_only=False))
                if len(some):
                    out = texts.to_pylist()
                    for i in some.tolist():
                        parts = out[i].split("\n")
                        dead = {p for r in rows.column(len(names))[i].as_py() for p in range(r["s"], r["s"] + r["lines"])}
                        real = [p for p, x in enumerate(parts) if x.strip(" \t\n\x0b\x0c\r")]
                        drop = {real[p] for p in dead}
                        out[i] = "\n".join(x for p, x in enumerate(parts) if p not in drop)
                        gone[i] = len(dead)
                    texts = pa.array(out, pa.string())
                cols = [rows.column(i) for i in range(len(names))]
                cols[text_at] = texts
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lines.astype(np.int64)), pa.array(gone)], names=[*names, "ld_lines", "ld_deleted"])

    fields = [StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]
    joined = joined.withColumn("text", F.col("text").cast("string")).select(*names, "ld_runs")
    return joined.mapInArrow(clean, StructType([*fields, StructField("ld_lines", LongType()), StructField("ld_deleted", LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_deleted").alias("n_deleted"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return apply(docs).select(*docs.columns)

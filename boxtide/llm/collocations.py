"""Phrase collocations per language, counted by slots of minimal perfect hashes.

Texts are lower-cased (A-Z), parted into pieces at .,;:!? and line ends, and those into words at blanks and tabs. A
phrase is 2 to 5 words in a row inside a piece; a candidate occurs at least `least` times in its language.

1. A pass over the texts writes, for each block of whole texts and language, its distinct words with counts and the text
   as places in that list. Words are counted by name, per language; those of `least` occurrences and more get dense ids.
   A block's list (not its tokens) is joined to them, and the blocks are written again as ids, -1 between pieces and for
   rarer words: a phrase with such a word can't be a candidate.
2. Level by level (2 to 5 words), mappers give the candidates: phrases in a hash bucket that reaches `least`, whose first and
   last k - 1 words are frequent (from three words on; read from bits of the level below). Buckets are as many as the tokens
   need (_buckets), binned sparsely some windows at a time and summed as a tree. Either filter may let others through, and
   lets none go that is frequent.
   Tasks send them as arrays, in ranges of their hash, where each range is made distinct.
3. Candidates are dealt by hash into parts of about SLOTS; for each part a minimal perfect hash and the keys by
   slot are broadcast (at most about SLOTS x 50 bytes, whatever the data). Mappers look up each window, compare its
   words with the key stored in the slot, np.bincount the slots, and send their arrays in chunks; chunks are summed in two
   steps (within salts, then over them). More candidates mean more passes, not larger broadcasts.
4. Cuts of candidates read f of both sides by slot, from hashes over the frequent phrases and words, in parts again.

Scores are whole numbers of up to 38 digits (1000 * a * n / (l * r)), the lowest-scoring cut counts.

Within one block words are told apart by 64-bit hashes (a chance of about 1e-9 for a block of 100,000 distinct words to
merge two), everywhere else by their text or ids.

Defined results: null and blank texts have no words; a null lang is `und`, together with texts of lang `und`; a row that
repeats counts again; no candidate or an empty table gives an empty result; only lang and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as tk
from .common import table, text_of, written
from .perfect_hash import PerfectHash

LEAST, LONGEST, TOP, SUBSUMED = 100, 5, 2000, 100
BLOCK, BUCKETS, SLOTS, CHUNK, SALTS = 1 << 20, 1 << 24, 1 << 20, 1 << 15, 8
HELD, PARTS = 1 << 19, 1024
#: Windows a bucket at most on average, the most buckets (a bit each is broadcast), windows binned at a time.
LOAD, MOST_BUCKETS, WINDOWS, CHUNK_BITS = 8, 1 << 30, 1 << 21, 15
_STOPS = np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)
_BREAK = np.zeros(256, bool)
_BREAK[_STOPS] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_MULT = np.random.default_rng(11).integers(1, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = [f"w{j}" for j in range(LONGEST)]
KEY = ", ".join(f"{w} int" for w in _WORDS)
_ARRAYS = "chunk int, salt int, places binary, counts binary"


def _local(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> a row for each block and language: its distinct words, their counts, and its text as places in that list."""
    seen = 0
    for batch in rows:
        langs = batch.column(0).dictionary_encode()
        code, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for a, b, data, off in tk.blocks(batch.column(1), BLOCK):
            start, end, row = tk.words(data, off, _GAP)
            h = tk.hashes(data, start, end, lower=True)
            stops = np.concatenate([[0], np.cumsum(_BREAK[data])])[start]
            new = np.ones(len(start), bool)
            new[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
            of = code[a:b][row]
            low = tk.LOWER[data]
            for lang in np.unique(of).tolist():
                at = np.flatnonzero(of == lang)
                _, first, place, times = np.unique(h[at], return_index=True, return_inverse=True, return_counts=True)
                s, n = start[at[first]], (end - start)[at[first]]
                edge = np.concatenate([[0], np.cumsum(n)])
                words = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(low[np.repeat(s - edge[:-1], n) + np.arange(edge[-1])])).cast(pa.string())
                text = np.full(len(at) + int(new[at].sum()), -1, np.int32)
                text[np.arange(len(at)) + np.cumsum(new[at])] = place
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(TaskContext.get().partitionId() << 32) + seen]), pa.array([names[lang]]), pa.array([len(at)]), pa.ListArray.from_arrays([0, len(n)], words), pa.ListArray.from_arrays([0, len(n)], pa.array(times.astype(np.int64))), pa.array([text.tobytes()], pa.binary())],
                    names=["block", "lang", "tokens", "words", "times", "text"],
                )
                seen += 1
        pa.default_memory_pool().release_unused()


def _encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, found (place, id)) -> ids. Words without a frequent neighbour and repeated gaps are left out."""
    for batch in rows:
        out = []
        for text, found in zip(batch.column(0), batch.column(1), strict=True):
            text, pairs = np.frombuffer(text.as_buffer(), np.int32), found.values
            ids = np.full(int(text.max()) + 2, -1, np.int32)
            ids[pairs.field("place").to_numpy()] = pairs.field("id").to_numpy()
            s = np.concatenate([[-1], ids[text], [-1]]).astype(np.int32)
            alone = (s[1:-1] >= 0) & (s[:-2] < 0) & (s[2:] < 0)
            s[1:-1][alone] = -1
            out.append(s[1:][(s[1:] >= 0) | (s[:-1] >= 0)].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])
        pa.default_memory_pool().release_unused()


def _hash(words: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(words[0]), len(words), np.uint64)
    for w, m in zip(words, _MULT, strict=False):
        h += (w.astype(np.uint64) + np.uint64(1)) * m
    return tk.mix(h)


def _windows(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[list[np.ndarray]]:
    """Of each block the k words of every window without a gap, as k arrays."""
    for batch in rows:
        for ids in batch.column(0):
            s = np.frombuffer(ids.as_buffer(), np.int32)
            gaps = np.concatenate([[0], np.cumsum(s < 0)])
            at = np.flatnonzero(gaps[k:] == gaps[: len(gaps) - k]) if len(s) >= k else np.zeros(0, np.int64)
            yield [s[at + j] for j in range(k)]


def _keys(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[list[np.ndarray]]:
    for batch in rows:
        yield [batch.column(j).to_numpy() for j in range(k)]


def _sent(total: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """An array's counts that are not 0, by chunks."""
    at = np.flatnonzero(total)
    edge = np.searchsorted(at, np.arange(0, len(total) + CHUNK, CHUNK))
    some = np.flatnonzero(np.diff(edge)).tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([salt] * len(some), pa.int32()), pa.array([(at[edge[c] : edge[c + 1]] - c * CHUNK).astype(np.uint16).tobytes() for c in some], pa.binary()), pa.array([total[at[edge[c] : edge[c + 1]]].tobytes() for c in some], pa.binary())],
        names=["chunk", "salt", "places", "counts"],
    )


def _counts(places: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Places of a chunk and their counts: of one or four bytes as a mapper sends them, of eight once summed."""
    at, raw = np.frombuffer(places.as_buffer(), np.uint16), counts.as_buffer()
    return at, np.frombuffer(raw, {1: np.uint8, 4: np.uint32, 8: np.int64}[raw.size // max(len(at), 1)] if len(at) else np.int64)


def _summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their chunks; one chunk is held at a time."""
    now, total = None, np.zeros(CHUNK, np.int64)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        out = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([0], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], names=["chunk", "salt", "places", "counts"])
        total[:] = 0
        return out

    for batch in rows:
        for chunk, places, counts in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if now is not None and chunk != now:
                yield done()
            now = chunk
            at, n = _counts(places, counts)
            total[at] += n
    if now is not None:
        yield done()


def _tree(arrays: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Sums of the tasks' arrays, within salts, then over them; `read` turns the chunks of the sum into rows, in the same worker."""
    within = arrays.repartition("chunk", "salt").sortWithinPartitions("chunk").mapInArrow(_summed, _ARRAYS)
    return within.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lambda rows: read(_summed(rows)), schema)


def _buckets(tokens: int) -> int:
    """A power of two, BUCKETS at least, that leaves about LOAD windows a bucket: with a fixed number nearly every bucket of a large table would reach `least`."""
    return max(BUCKETS, min(1 << (tokens // LOAD).bit_length(), MOST_BUCKETS))


def _binned(windows: Iterator[list[np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts by bucket, of about WINDOWS windows at a time: memory and messages grow with the windows, not with the buckets."""
    held, n = [], 0

    def sent() -> Iterator[pa.RecordBatch]:
        at, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        for some, kind in ((times < 256, np.uint8), (times >= 256, np.uint32)):  # nearly all counts fit a byte
            if some.any():
                own, n = at[some], times[some].astype(kind)
                edge = np.append(0, np.flatnonzero(np.diff(own >> CHUNK_BITS)) + 1)
                cut = lambda x, edge=edge: pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer((np.append(edge, len(x)) * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
                salt = np.full(len(edge), TaskContext.get().partitionId() % SALTS, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array((own[edge] >> CHUNK_BITS).astype(np.int32)), pa.array(salt), cut((own & np.uint32(CHUNK - 1)).astype(np.uint16)), cut(n)], names=["chunk", "salt", "places", "counts"])

    for w in windows:
        if len(w[0]):
            held.append((_hash(w) & np.uint64(buckets - 1)).astype(np.uint32))
            n += len(held[-1])
        if n > WINDOWS:
            yield from sent()
            n = 0
    if held:
        yield from sent()


def _bits(source: DataFrame, words: Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]], least: int, buckets: int) -> np.ndarray:
    """Flags of so many buckets (packed): whether the phrases of a bucket add up to `least`."""

    def flags(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for places, counts in zip(batch.column(2), batch.column(3), strict=True):
                f, (at, n) = np.zeros(CHUNK, bool), _counts(places, counts)
                f[at] = n >= least
                out.append(np.packbits(f).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "flags"])

    bits = np.zeros(buckets // 8, np.uint8)
    for r in _tree(source.mapInArrow(lambda rows: _binned(words(rows), buckets), _ARRAYS), flags, "chunk int, flags binary").collect():  # a bit a bucket in all
        bits[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["flags"], np.uint8)
    return bits


def _has(bits: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    at = (_hash(words) % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _possible(bits: np.ndarray, w: list[np.ndarray]) -> list[np.ndarray]:
    """The windows that the level below leaves possible."""
    if not len(w[0]):
        return w
    ok = _has(bits, w[:-1])
    ok[ok] = _has(bits, [x[ok] for x in w[1:]])
    return [x[ok] for x in w]


def _batch(w: list[np.ndarray], **more: np.ndarray) -> pa.RecordBatch:
    none = np.full(len(w[0]), -1, np.int32)
    cols = {c: pa.array(w[j] if j < len(w) else none, pa.int32()) for j, c in enumerate(_WORDS)} | {k: pa.array(v) for k, v in more.items()}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


class Slots:
    """A perfect hash over the phrases of one part, their words by slot, and their counts if known."""

    def __init__(self, phrases: pa.Table, k: int) -> None:
        words = [phrases.column(j).to_numpy().astype(np.int32) for j in range(k)]
        h = _hash(words)
        if len(np.unique(h)) < len(h):
            raise ValueError("two phrases have one 64-bit hash; choose other multipliers")
        self.hash = PerfectHash(h)
        order = np.argsort(self.hash.slots(h))
        self.words = [w[order] for w in words]
        self.counts = phrases.column("n").to_numpy()[order] if "n" in phrases.column_names else None

    def find(self, words: list[np.ndarray]) -> np.ndarray:
        """The slot of each phrase, -1 where the words stored there differ."""
        slot = self.hash.slots(_hash(words))
        ok = slot >= 0
        for mine, theirs in zip(self.words, words, strict=True):
            ok[ok] = mine[slot[ok]] == theirs[ok]
        return np.where(ok, slot, -1)


def _parts(phrases: DataFrame, k: int) -> Iterator[tuple[Slots, F.Column]]:
    """The phrases of k words as Slots of bounded size, each with the condition for its part of words w0, w1, ..."""
    parts = -(-phrases.count() // SLOTS)
    for p in range(parts):
        own = F.pmod(F.xxhash64(*_WORDS[:k]), F.lit(parts)) == p
        yield Slots(phrases.filter(own).select(*_WORDS[:k], *[c for c in phrases.columns if c == "n"]).toArrow(), k), own


def _distinct(words: list[np.ndarray]) -> list[np.ndarray]:
    """Each phrase once. (Of phrases that share a 64-bit hash the first is known by it, the others all stay.)"""
    _, first, at = np.unique(_hash(words), return_index=True, return_inverse=True)
    keep = np.zeros(len(words[0]), bool)
    keep[first] = True
    for x in words:
        keep |= x != x[first][at]
    return [x[keep] for x in words]


def _packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Phrases as a row for each of PARTS ranges of their hash, with all words as one array."""
    words = _distinct([np.concatenate(x) for x in zip(*held, strict=True)]) if held else [np.zeros(0, np.int32)]
    part = (_hash(words) % np.uint64(PARTS)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    words, edge = np.stack(words)[:, order], np.searchsorted(part[order], np.arange(PARTS + 1))
    some = np.flatnonzero(np.diff(edge)).tolist()
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([words[:, edge[p] : edge[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "keys"])


def frequent(streams: DataFrame, k: int, below: np.ndarray | None, least: int, buckets: int) -> DataFrame:
    """w0 ... w4 and n of the phrases of k words that occur at least `least` times. below: flags of the frequent phrases of k - 1 words."""
    spark = streams.sparkSession
    lower = spark.sparkContext.broadcast(below)
    known = lambda rows: (w if k == 2 else _possible(lower.value, w) for w in _windows(rows, k))
    sent = spark.sparkContext.broadcast(_bits(streams, known, least, buckets))

    def likely(rows: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for w in known(rows):
            yield [x[_has(sent.value, w)] for x in w] if len(w[0]) else w

    def candidates(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for w in likely(rows):
            held.append(_distinct(w))
            n += len(held[-1][0])
            if n > HELD:
                held = [_distinct([np.concatenate(x) for x in zip(*held, strict=True)])]
                n = len(held[0][0])
            if n > HELD // 2:
                yield _packed(held)
                held, n = [], 0
        yield _packed(held)

    def distinct(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in rows:
            for part, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.setdefault(part, []).append(np.frombuffer(keys.as_buffer(), np.int32).reshape(k, -1))
        for own in parts.values():
            yield _batch(_distinct(list(np.concatenate(own, axis=1))))

    found = written(streams.mapInArrow(candidates, "part int, keys binary").repartition("part").mapInArrow(distinct, KEY))
    out = spark.createDataFrame([], f"{KEY}, n long")
    for slots, _ in _parts(found, k):
        part = spark.sparkContext.broadcast(slots)

        def binned(rows: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            total = np.zeros(part.value.hash.n, np.uint32)
            for w in likely(rows):
                slot = part.value.find(w)
                total += np.bincount(slot[slot >= 0], minlength=len(total)).astype(np.uint32)
            yield from _sent(total, TaskContext.get().partitionId() % SALTS)

        def read(rows: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for chunk, places, counts in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    at, n = _counts(places, counts)
                    slot = at.astype(np.int64)[n >= least] + chunk * CHUNK
                    yield _batch([w[slot] for w in part.value.words], n=n[n >= least].astype(np.int64))

        out = out.unionAll(written(_tree(streams.mapInArrow(binned, _ARRAYS), read, f"{KEY}, n long")))
        part.destroy()
    sent.unpersist()
    lower.unpersist()
    return out


def _counted(cuts: DataFrame, k: str, first: F.Column, name: str, levels: dict[int, DataFrame]) -> DataFrame:
    """Adds f of the side that has k words from word `first` on, read by slot."""
    side = [F.when(F.lit(j) < F.col(k), F.try_element_at("phrase", (first + j + 1).cast("int"))).otherwise(-1).cast("int").alias(w) for j, w in enumerate(_WORDS)]
    wide = written(cuts.select("*", *side))
    schema, out = f"{', '.join(f'{c} {t}' for c, t in cuts.dtypes)}, {name} long", None
    for size, phrases in levels.items():
        for slots, own in _parts(phrases, size):
            part = cuts.sparkSession.sparkContext.broadcast(slots)

            def read(rows: Iterator[pa.RecordBatch], part=part, size=size) -> Iterator[pa.RecordBatch]:
                for batch in rows:
                    slot = part.value.find([batch.column(batch.schema.get_field_index(w)).to_numpy() for w in _WORDS[:size]])
                    yield pa.RecordBatch.from_arrays([batch.column(j) for j in range(batch.num_columns - LONGEST)] + [pa.array(part.value.counts[slot], mask=slot < 0)], names=[*batch.schema.names[:-LONGEST], name])

            got = wide.filter((F.col(k) == size) & own).mapInArrow(read, schema)
            out = got if out is None else out.unionAll(got)
    return out


def apply(docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` best phrases of each language."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text_of(docs).alias("text"))
    local = written(rows.mapInArrow(_local, "block long, lang string, tokens long, words array<string>, times array<long>, text binary"))
    tokens = local.groupBy("lang").agg(F.sum("tokens").alias("n"))
    counted = local.select("lang", F.explode(F.arrays_zip("words", "times")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.times").alias("n"))
    vocabulary = written(counted.filter(F.col("n") >= least).withColumn("sparse", F.monotonically_increasing_id()))
    base, starts = 0, []
    for r in vocabulary.groupBy(F.shiftright("sparse", 33).alias("p")).count().orderBy("p").collect():  # one row a partition
        starts.append((r["p"], base))
        base += r["count"]
    if not base:
        return empty
    starts = F.broadcast(spark.createDataFrame(starts, "p long, base long"))
    vocabulary = vocabulary.withColumn("p", F.shiftright("sparse", 33)).join(starts, "p").select("lang", "word", "n", (F.col("base") + F.col("sparse").bitwiseAND(2**33 - 1)).cast("int").alias("id"))
    vocabulary = written(vocabulary)
    places = local.select("block", "lang", F.posexplode("words").alias("place", "word"))
    found = places.join(vocabulary.select("lang", "word", "id").hint("shuffle_hash"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("found"))
    streams = written(local.select("block", "text").join(found, "block").select("text", "found").mapInArrow(_encode, "ids binary"))

    levels = {1: vocabulary.select(F.col("id").alias("w0"), "n")}
    phrases, below, buckets = None, None, _buckets(tokens.agg(F.sum("n")).first()[0])
    for k in range(2, LONGEST + 1):
        if k > 2:
            below = _bits(levels[k - 1].select(*_WORDS[: k - 1]), lambda b, k=k: _keys(b, k - 1), 1, buckets)
        levels[k] = frequent(streams, k, below, least, buckets)
        own = levels[k].select(F.slice(F.array(*_WORDS), 1, k).alias("phrase"), F.col("n").alias("a"))
        phrases = own if phrases is None else phrases.unionAll(own)
    phrases = written(phrases)

    cuts = phrases.filter(F.size("phrase") > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1))).withColumn("rest", F.size("phrase") - F.col("cut"))
    sides = {k: v for k, v in levels.items() if k < LONGEST}
    cuts = _counted(_counted(cuts, "cut", F.lit(0), "l", sides), "rest", F.col("cut"), "r", sides)
    named = cuts.join(vocabulary.select(F.col("id").alias("first"), "lang"), F.col("first") == F.element_at("phrase", 1)).join(F.broadcast(tokens), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    worst = named.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))

    size = F.size("phrase")
    longer = phrases.filter(size > 2).select("a", "phrase", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    longer = longer.select("a", "phrase", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("at")).select("a", F.slice("phrase", F.col("at"), F.col("k")).alias("phrase"))
    inside = longer.groupBy("phrase").agg(F.max("a").alias("b"))
    left = worst.join(inside, "phrase", "left").filter(F.col("b").isNull() | (wide("b") * 100 < wide("a") * subsumed))

    spelt = left.select("lang", "phrase", "a", "n", "m", F.posexplode("phrase").alias("j", "id")).join(vocabulary.select("id", "word"), "id")
    spelt = spelt.groupBy("lang", "phrase", "a", "n", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "word"))), lambda x: x["word"]), " ").alias("text"))
    flat = spelt.select("lang", F.col("text").alias("phrase"), "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return flat.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long")).select(*empty.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


#: DuckDB, over `documents`.
SQL = f"""WITH co_p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
co_w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM co_p),
co_n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM co_w GROUP BY lang),
co_g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM co_w, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k),
co_f AS (SELECT lang, k, g, count(*) AS f FROM co_g GROUP BY ALL HAVING count(*) >= {LEAST}),
co_c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w, unnest(range(1, k)) AS c FROM co_f WHERE k > 1),
co_s AS (SELECT c.lang, c.k, c.g, c.a, min({{'score': (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f), 'c': c.c, 'l': x.f, 'r': y.f}}) AS m, any_value(n.n) AS n
  FROM co_c c JOIN co_n n ON n.lang = c.lang JOIN co_f x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:c.c], ' ') JOIN co_f y ON y.lang = c.lang AND y.g = array_to_string(c.w[c.c + 1:], ' ') GROUP BY c.lang, c.k, c.g, c.a),
co_i AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS g, max(a) AS b FROM (SELECT DISTINCT lang, k, a, w FROM co_c), range(2, {LONGEST}) t(j), range(1, {LONGEST}) u(i) WHERE j < k AND i + j - 1 <= k GROUP BY ALL),
co_r AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY m.score DESC, s.a DESC, s.g) AS rank FROM co_s s LEFT JOIN co_i i ON i.lang = s.lang AND i.g = s.g WHERE i.b IS NULL OR 100 * i.b < {SUBSUMED} * s.a)
SELECT lang, rank, g AS phrase, a, m.l AS l, m.r AS r, n::BIGINT AS n, m.score::BIGINT AS score FROM co_r WHERE rank <= {TOP}
"""

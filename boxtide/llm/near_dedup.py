"""Near-duplicate documents by HyperMinHash.

A document's set are the distinct five-word shingles of its lower-cased text (of a shorter text, all its words as one).
Documents with equal sets form a class; only the class's least doc_id goes on. Its HyperMinHash has BUCKETS registers:
the least hash of the set under the bucket's own hash function, stored as the count of leading zeros and MANTISSA bits
after the leading one. (A hash function for each bucket, not a partition of one hash, keeps buckets of short documents
from staying empty.) Each ROWS registers form a band; documents that agree in a band are candidates: at similarity
0.75 a pair agrees in none of the 32 bands with a chance of 5e-6.

Candidates are resolved without emitting a bucket's pairs. First each member meets only its bucket's least member.
Then buckets whose members lie in several components are taken up inside tasks, in blocks of at most about BLOCK
members (and SHINGLES shingles): across components only, and only where the band is the first that two documents share.
Either way a pair goes on if its sizes allow the similarity and the collision-corrected Jaccard estimate is within five
standard errors of it, and is then verified on the full sets of the whole texts; a block emits only links that join
components of its own. Components come from alternating large-star and small-star steps. Nothing is capped.

Defined results: a null or word-less text has an empty set, is linked with nothing and is kept; repeated rows of one
doc_id are one document; a null doc_id is in no component unless its set equals another's; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, table, text_of, written

BUCKETS, ROWS, MANTISSA = 128, 4, 10
PERCENT = 75
#: Estimates below this are no candidates: the wanted similarity less five standard errors.
LEAST = PERCENT / 100 - 5 * (0.75 * 0.25 / BUCKETS) ** 0.5
BLOCK, SHINGLES = 2048, 2_000_000
_rng = np.random.default_rng(7)
_MULT = (_rng.integers(1, 2**31, BUCKETS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_FLIP = _rng.integers(0, 2**32, BUCKETS, dtype=np.uint32)


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) 16-bit registers of sorted sets; rows without a set stay 0."""
    n = len(off) - 1
    some = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((n, BUCKETS), np.uint16)
    if not len(some):
        return out
    x, at = (h >> np.uint64(32)).astype(np.uint32), off[some]
    low, y = np.empty((BUCKETS, len(some)), np.uint32), np.empty_like(x)
    for j in range(BUCKETS):
        np.bitwise_xor(x, _FLIP[j], out=y)
        np.multiply(y, _MULT[j], out=y)
        low[j] = np.minimum.reduceat(y, at)
    m, e = np.frexp(low.astype(np.float64))
    after = ((2 * m - 1) * (1 << MANTISSA)).astype(np.int64)
    out[some] = np.where(low > 0, ((32 - e) << MANTISSA) | after, 32 << MANTISSA).astype(np.uint16).T
    return out


def _sketch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids = batch.column(0)
        for a, b, _, h, off in tk.shingle_sets(batch.column(1)):
            reg = registers(h, off)
            n = np.diff(off)
            keys = [hashlib.blake2b(h[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), pa.array([r.tobytes() if k else None for r, k in zip(reg, n.tolist(), strict=True)], pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "registers"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key and registers of every document (the last two null without a set)."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, registers binary")


def _bands(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per = BUCKETS // ROWS
    salt = tk.mix(np.arange(1, per + 1, dtype=np.uint64))
    for batch in rows:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            reg = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(ids), BUCKETS)
            keys = tk.mix(np.ascontiguousarray(reg).view(np.uint64).reshape(len(ids), per) ^ salt)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, per)), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(per, dtype=np.int32), len(ids)))], names=["id", "band", "place"])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, less the expected share of accidental collisions."""
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (a == b).mean(-1) - chance


def _estimated(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, ra, rb) -> the pairs worth verifying."""
    for batch in rows:
        a, b, na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(a), BUCKETS) for i in (4, 5))
        ok = estimate(ra, rb, na, nb) >= LEAST
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return [h[off[r] : off[r + 1]] for x, y, _, h, off in tk.shingle_sets(texts) for r in range(y - x)]


def _similar(s: np.ndarray, t: np.ndarray) -> bool:
    both = np.concatenate([s, t])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return bool(common) and 100 * common >= PERCENT * (len(both) - common)


def _verified(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> the pairs whose full sets are similar enough."""
    for batch in rows:
        for k in range(0, batch.num_rows, 128):
            part = batch.slice(k, 128)
            keep = pa.array([_similar(s, t) for s, t in zip(_sets(part.column(2)), _sets(part.column(3)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")


def _sizes_fit(n: str, m: str) -> F.Column:
    return (F.col(n) * 100 >= F.col(m) * PERCENT) & (F.col(m) * 100 >= F.col(n) * PERCENT)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable, for every node with an edge (a, b)."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = cut(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _in_block(batch: pa.Table) -> pa.Table:
    """Members of one or two blocks of a bucket -> verified links (a, b) that join components, as few as connect them."""
    ids, comp, n, block = (batch.column(c).to_numpy() for c in ("id", "comp", "n", "block"))
    reg = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(len(ids), BUCKETS)
    band, place = np.ascontiguousarray(reg).view(np.uint64), batch.column("place")[0].as_py()
    sets = _sets(batch.column("text"))
    two = block.min() != block.max()
    _, own = np.unique(comp, return_inverse=True)  # components, renamed as links join them
    out: list[tuple[int, int]] = []
    for i in (np.flatnonzero(block == block.min()) if two else np.arange(len(ids))).tolist():
        j = np.flatnonzero((own != own[i]) & (n * 100 >= n[i] * PERCENT) & (n[i] * 100 >= n * PERCENT) & ((block != block[i]) if two else (ids > ids[i])))
        if not len(j):
            continue
        likely = estimate(reg[i], reg[j], n[i], n[j])
        first = (band[j] == band[i]).argmax(1)
        ok = (likely >= LEAST) & (first == place)
        for k in j[ok][np.argsort(-likely[ok], kind="stable")].tolist():
            if own[k] != own[i] and _similar(sets[i], sets[k]):
                own[own == own[k]] = own[i]
                out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of representatives, enough to connect each component."""
    bands = written(reps.select("id", "registers").mapInArrow(_bands, "id long, band long, place int"))
    shared = bands.groupBy("band").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    inside = written(bands.join(shared, "band"))
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).alias("text"))
    texts = written(texts.join(inside.select("id").distinct(), "id", "left_semi"))  # all texts move once, then only those that share a band
    narrow = reps.select("id", "n")
    star = inside.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(narrow.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(narrow.withColumnsRenamed({"id": "b", "n": "nb"}), "b").filter(_sizes_fit("na", "nb"))
    reg = reps.select("id", "registers")
    star = star.join(reg.withColumnsRenamed({"id": "a", "registers": "ra"}), "a").join(reg.withColumnsRenamed({"id": "b", "registers": "rb"}), "b")
    star = star.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated, "a long, b long")
    first = cut(_verify(star, texts).distinct())
    comp = components(first)
    member = inside.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = member.join(narrow, "id").groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m"), F.sum("n").alias("s")).filter("c0 <> c1")
    mixed = mixed.select("band", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("s") / SHINGLES)).cast("int").alias("blocks"))
    rest = member.drop("pivot", "members").join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("band", "place", F.least("block", "other").alias("k0"), F.greatest("block", "other").alias("k1"), "block", "id", "comp").join(reps, "id")
    texts = texts.join(rest.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    found = rest.join(texts, "id").select("band", "k0", "k1", "place", "block", "id", "comp", "n", "registers", "text").groupBy("band", "k0", "k1").applyInArrow(_in_block, "a long, b long")
    return first.unionAll(cut(found.distinct()))


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per row of docs."""
    base = written(sketches(docs))
    classes = base.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = written(classes)
    comp = components(links(docs, classes.select("id", "n", "registers"))).withColumnRenamed("node", "id")
    root = classes.select("set_key", "id").join(comp, "id", "left").select("set_key", F.coalesce("comp", "id").alias("root"))
    out = base.select("doc_id", "n_shingles", "set_key").join(root, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    gone = apply(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: DuckDB, over `documents`.
SQL = f"""WITH RECURSIVE nd_w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
nd_s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM nd_w),
nd_n AS (SELECT doc_id, count(*) AS n FROM nd_s GROUP BY doc_id),
nd_f AS (SELECT sh, count(*) AS f FROM nd_s GROUP BY sh HAVING count(*) > 1),
nd_r AS (SELECT s.doc_id, s.sh, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(f.f, 1), s.sh) AS r FROM nd_s s JOIN nd_n n USING (doc_id) LEFT JOIN nd_f f USING (sh)),
nd_p AS (SELECT * FROM nd_r WHERE r <= n - (n * {PERCENT} + 99) // 100 + 1),
nd_c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM nd_p a JOIN nd_p b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
nd_i AS (SELECT c.a, c.b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS i FROM nd_c c JOIN nd_s x ON x.doc_id = c.a JOIN nd_s y ON y.doc_id = c.b AND y.sh = x.sh GROUP BY c.a, c.b),
nd_l AS (SELECT a, b FROM nd_i WHERE 100 * i >= {PERCENT} * (na + nb - i)),
nd_e AS (SELECT a, b FROM nd_l UNION ALL SELECT b, a FROM nd_l),
nd_g AS (SELECT a AS id, a AS c FROM nd_e UNION SELECT e.b, g.c FROM nd_g g JOIN nd_e e ON e.a = g.id AND g.c < e.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(c), d.doc_id))::BIGINT AS component_id, least(d.doc_id, coalesce(min(c), d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN nd_n USING (doc_id) LEFT JOIN nd_g g ON g.id = d.doc_id GROUP BY d.doc_id, n
"""

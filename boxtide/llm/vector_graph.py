"""Near-duplicate vectors by NN-descent, within equal labels, at a cosine of LEAST and more.

1. Equal vectors of a label are one node with a weight. (Vectors that are null, empty, zero, or hold null or non-finite
   components, and those without a label, are no nodes; vectors of different lengths are never compared.)
2. The first lists: nodes are sorted by the signs of random projections, TABLES times; in blocks of BLOCK neighbours in
   that order each takes its nearest few.
3. NN-descent: a node's list and the nodes that list it meet at the node; pairs with a fresh entry are compared, and those
   that better either list go into it, until hardly any list changes. A list holds the WIDTH nearest.
4. Where a list is full of links (saturated), it must grow. Nodes with saturated lists that hang together by close links
   are replaced by one ball: the mean direction and the angle that covers its members, at most half the wanted angle, so
   that all members are linked with each other and none of these pairs need be listed. Balls and the rest are
   descended again; a pair counts there if any of its members could be linked (the angle less both radii). Lists
   that are still saturated get twice the room, again and again, until none is: nothing is capped.
5. An audit compares AUDIT random nodes with all others by brute force, adds what the graph lacks, and orders further
   tables and another descent while the recall is under RECALL (ROUNDS at most).
6. Threshold edges stay. A pair of balls (or of a ball and a vector) whose angle and radii decide it is counted by weights;
   the undecided ones are compared member by member in pairs of blocks of SIDE, which give back counts, not pairs.

Lists, counts and blocks are bounded whatever the size of a group of copies: copies that a ball covers take one place in
each list. A wide region in which a vector has many links that no ball covers takes as many list entries as it has links.

Defined results: other vectors as in 1. have n_links 0 and are their own component; rows that repeat a vec_id and vector
are one vector (each row is returned); a null vec_id counts as a vector, but is never a component's id unless all are
null (then component_id is null and the row is kept); an empty table gives an empty result; only vec_id, embedding and
label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .near_dedup import components

LEAST = 0.93
WIDTH, TABLES, BLOCK, FIRST, SIDE = 10, 10, 128, 3, 512
AUDIT, RECALL, ROUNDS, DELTA = 512, 0.99, 6, 0.002
HALF = math.acos(LEAST) / 2 - 1e-6
EDGES = "u long, v long, s double, link boolean"


def _units(vectors: pa.Array) -> np.ndarray:
    """Unit vectors as rows of doubles; shorter vectors of a batch are filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(n), int(n.max(initial=0))))
    x[np.arange(x.shape[1]) < n[:, None]] = flat
    x /= np.maximum(np.abs(x).max(1, initial=0), 1e-320)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-320)[:, None]


def _angle(s: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(s, -1, 1))


def _link(s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether members of two nodes can be linked; r: both radii added."""
    return np.where(r > 0, _angle(s) - r <= 2 * HALF + 4e-6, s >= LEAST)


def _edges(u: list, v: list, s: list, link: list) -> pa.RecordBatch:
    join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([join(u, pa.int64()), join(v, pa.int64()), join(s, pa.float64()), join(link, pa.bool_())], names=["u", "v", "s", "link"])


def _first_lists(nodes: DataFrame, seed: int, tables: int, bits: int) -> DataFrame:
    def keyed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x = _units(part.column(part.schema.get_field_index("vec")))
                dims = np.diff(part.column(part.schema.get_field_index("vec")).offsets.to_numpy())
                code, value = np.zeros((len(x), tables), np.int64), np.zeros((len(x), tables))
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    p = (x[at, :d] @ np.random.default_rng([seed, d]).normal(size=(d, tables * (bits + 1)))).reshape(len(at), tables, bits + 1)
                    code[at], value[at] = (p[:, :, :bits] > 0) @ (1 << np.arange(bits)), p[:, :, bits]
                out = part.take(pa.array(np.repeat(np.arange(len(x)), tables)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), pa.array(code.ravel()), pa.array(value.ravel())], names=[*out.schema.names, "tab", "code", "value"])

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            u, v, s, link = [], [], [], []
            node, r, tab = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("node", "r", "tab"))
            grp = batch.column(batch.schema.get_field_index("grp")).dictionary_encode().indices.to_numpy()
            x = _units(batch.column(batch.schema.get_field_index("vec")))
            for a in range(0, len(x), BLOCK):
                b = slice(a, a + BLOCK)
                cos = x[b] @ x[b].T
                cos[(grp[b][:, None] != grp[b]) | (tab[b][:, None] != tab[b])] = -2
                np.fill_diagonal(cos, -2)
                near = np.argpartition(-cos, min(FIRST, len(cos) - 1), axis=1)[:, :FIRST]
                i, j = np.repeat(np.arange(len(cos)), near.shape[1]), near.ravel()
                keep = cos[i, j] > -1.5
                i, j = i[keep], j[keep]
                u.append(node[b][i]), v.append(node[b][j]), s.append(cos[i, j]), link.append(_link(cos[i, j], r[b][i] + r[b][j]))
            yield _edges(u, v, s, link)

    kind = dict(nodes.dtypes)["vec"]
    order = ["grp", "tab", "code", "value"]
    rows = nodes.select("node", "grp", "r", "vec").mapInArrow(keyed, f"node long, grp string, r double, vec {kind}, tab int, code long, value double")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, EDGES)


def _merged(graph: DataFrame | None, found: DataFrame, room: int) -> DataFrame:
    """Lists (u, v, s, link, fresh, rank): of old and found entries the WIDTH nearest, and links up to `room`."""
    both = found.unionAll(found.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "link")).withColumn("fresh", F.lit(True))
    both = both if graph is None else both.unionAll(graph.select("u", "v", "s", "link", F.lit(False).alias("fresh")))
    one = both.groupBy("u", "v").agg(F.max("s").alias("s"), F.max("link").alias("link"), F.min("fresh").alias("fresh"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("link"), F.desc("s"), "v"))).filter(F.col("rank") <= room)
    return written(ranked.filter((F.col("rank") <= WIDTH) | F.col("link")))


def _met(graph: DataFrame, nodes: DataFrame, room: int) -> DataFrame:
    """The pairs of nodes that meet at a node and better a list."""
    lists = graph.select(F.col("u").alias("at"), F.col("v").alias("node"), "fresh")
    listed = graph.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).filter(F.col("k") <= WIDTH)
    meeting = lists.unionAll(listed.select(F.col("v").alias("at"), F.col("u").alias("node"), "fresh")).groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("u").agg(F.max(F.when(F.col("rank") == WIDTH, F.col("s"))).alias("worst"), F.max(F.when((F.col("rank") == room) & F.col("link"), F.col("s"))).alias("last"))
    facts = nodes.select("node", "r", "vec").join(worst.withColumnRenamed("u", "node"), "node", "left").select("node", "r", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"), F.coalesce("last", F.lit(-2.0)).alias("last"))

    def join(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in rows:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            at = t.column("at").to_numpy()
            cut = int(np.searchsorted(at, at[-1]))  # the last node's rows may go on in the next batch
            rest = t.slice(cut)
            yield from meet(t.slice(0, cut))
        if rest is not None:
            yield from meet(rest)

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        at, node, fresh, r, worst, last = (t.column(c).to_numpy() for c in ("at", "node", "fresh", "r", "worst", "last"))
        x = _units(t.column("vec"))
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])).tolist()
        u, v, s, link = [], [], [], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a < 2 or not fresh[a:b].any():
                continue
            own = slice(a, b)
            cos = x[own] @ x[own].T
            i, j = np.nonzero(np.triu(fresh[own][:, None] | fresh[own], 1))
            c = cos[i, j]
            linked = _link(c, r[own][i] + r[own][j])
            keep = (c > np.minimum(worst[own][i], worst[own][j])) | (linked & (c > np.minimum(last[own][i], last[own][j])))
            i, j = i[keep], j[keep]
            u.append(node[own][i]), v.append(node[own][j]), s.append(c[keep]), link.append(linked[keep])
        if u:
            yield _edges(u, v, s, link)

    rows = meeting.join(facts, "node").select("at", "node", "fresh", "r", "worst", "last", "vec")
    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(join, EDGES)


def descend(nodes: DataFrame, graph: DataFrame | None, seed: int, tables: int = TABLES, grow: bool = False) -> DataFrame:
    """The neighbour graph of nodes (node, grp, vec, r) after refinement; grow: saturated lists get more room until none is."""
    n, room = nodes.count(), WIDTH
    found = _first_lists(nodes, seed, tables, max(6, math.ceil(math.log2(max(n, 1) / 64))))
    graph = _merged(graph, found, room)
    while True:
        full = graph.filter((F.col("rank") == room) & F.col("link")) if grow else None
        new = graph.filter("fresh").count()
        if new <= DELTA * WIDTH * n:
            if full is None or full.isEmpty():
                return graph
            room *= 2
            open_ = full.select("u").withColumn("full", F.lit(True))
            graph = graph.join(open_, "u", "left").withColumn("fresh", F.col("fresh") | F.coalesce("full", F.lit(False))).drop("full").select("u", "v", "s", "link", "fresh", "rank")
        graph = _merged(graph, _met(graph, nodes, room), room)


def balls(nodes: DataFrame, graph: DataFrame) -> DataFrame | None:
    """unit, node, grp, centre, angle of the members of each ball of saturated nodes."""
    full = written(graph.filter((F.col("rank") == WIDTH) & F.col("link")).select(F.col("u").alias("node")))
    if full.isEmpty():
        return None
    close = graph.filter(F.col("s") >= math.cos(HALF)).join(full.withColumnRenamed("node", "u"), "u", "left_semi").join(full.withColumnRenamed("node", "v"), "v", "left_semi")
    comp = components(close.select(F.col("u").alias("a"), F.col("v").alias("b")))

    def unit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x, dims = _units(batch.column(2)), np.diff(batch.column(2).offsets.to_numpy())
            comps, grps = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for c in np.unique(comps).tolist():
                at = np.flatnonzero(comps == c)
                total = x[at].sum(0)[: dims[at[0]]]
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(total)), pa.array([grps[at[0]]] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["comp", "grp", "place", "x"])

    def angles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            cos = (_units(batch.column(3)) * _units(batch.column(4))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(_angle(cos))], names=["comp", "node", "grp", "centre", "angle"])

    kind = dict(nodes.dtypes)["vec"]
    member = nodes.join(comp, "node").select("comp", "grp", "vec", "node")
    sums = member.select("comp", "grp", "vec").mapInArrow(unit, "comp long, grp string, place int, x double").groupBy("comp", "place").agg(F.sum("x").alias("x"))
    centre = written(sums.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).cast(kind).alias("centre")))
    near = member.join(centre, "comp").select("comp", "node", "grp", "vec", "centre").mapInArrow(angles, f"comp long, node long, grp string, centre {kind}, angle double").filter(F.col("angle") <= HALF)
    near = written(near)
    units = near.groupBy("comp").agg(F.min("node").alias("unit"), F.count("*").alias("members")).filter("members > 1")
    return near.join(units, "comp").select("unit", "node", "grp", "centre", "angle")


def _audit(units: DataFrame, graph: DataFrame, seed: int) -> tuple[float, DataFrame]:
    """The share of the links of AUDIT random nodes that the graph has, and the links that it lacks."""
    asked = units.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(AUDIT).select("node", "grp", "r", "vec").toArrow().combine_chunks()
    sent = units.sparkSession.sparkContext.broadcast(asked)

    def against(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = sent.value
        y, node, grp, r = _units(ask.column("vec")), ask.column("node").to_numpy(), np.array(ask.column("grp").to_pylist(), object), ask.column("r").to_numpy()
        for batch in rows:
            x, other = _units(batch.column(3)), batch.column(0).to_numpy()
            d = max(x.shape[1], y.shape[1])
            cos = np.pad(y, ((0, 0), (0, d - y.shape[1]))) @ np.pad(x, ((0, 0), (0, d - x.shape[1]))).T
            ok = _link(cos, r[:, None] + batch.column(2).to_numpy()) & (grp[:, None] == np.array(batch.column(1).to_pylist(), object)) & (node[:, None] != other)
            i, j = np.nonzero(ok)
            yield _edges([node[i]], [other[j]], [cos[i, j]], [np.ones(len(i), bool)])

    true = written(units.select("node", "grp", "r", "vec").mapInArrow(against, EDGES))
    have = graph.filter("link").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    lost = written(true.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).join(have, ["a", "b"], "left_anti").select("u", "v", "s", "link"))
    n = true.count()
    return (1 - lost.count() / n if n else 1.0), lost


def _across(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) units that angles and radii leave open -> a, b, node, n: how many vectors of the other unit each member is linked with."""
    sizes = members.groupBy("unit").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("blocks"))
    dealt = members.join(sizes, "unit").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    both = pairs.join(sizes.withColumnsRenamed({"unit": "a", "blocks": "na"}), "a").join(sizes.withColumnsRenamed({"unit": "b", "blocks": "nb"}), "b")
    left = both.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).join(dealt.withColumnRenamed("unit", "a"), "a").select("a", "b", F.col("block").alias("i"), "j", "node", "w", "vec", F.lit(0).alias("side"))
    right = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).join(dealt.withColumnRenamed("unit", "b"), "b").select("a", "b", "i", F.col("block").alias("j"), "node", "w", "vec", F.lit(1).alias("side"))

    def count(t: pa.Table) -> pa.Table:
        x, side, w = _units(t.column("vec")), t.column("side").to_numpy(), t.column("w").to_numpy()
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        ok = x[p] @ x[q].T >= LEAST
        n = np.zeros(len(side), np.int64)
        n[p], n[q] = ok @ w[q], w[p] @ ok
        some = np.flatnonzero(n)
        return t.select(["a", "b", "node"]).take(pa.array(some)).append_column("n", pa.array(n[some]))

    return left.unionAll(right).groupBy("a", "b", "i", "j").applyInArrow(count, "a long, b long, node long, n long").groupBy("a", "b", "node").agg(F.sum("n").alias("n"))


def links(nodes: DataFrame) -> DataFrame:
    """node, n_links, component of nodes (node, grp, vec, w, id); component: the least id reachable."""
    nodes = nodes.withColumn("r", F.lit(0.0))
    graph = descend(nodes, None, 1)
    near = balls(nodes, graph)
    if near is None:
        units, member = nodes.select("node", "grp", "vec", "r"), nodes.select(F.col("node").alias("unit"), "node", "w", "id", "vec", F.lit(False).alias("ball"))
    else:
        near = written(near)
        single = nodes.join(near, "node", "left_anti")
        ball = near.groupBy("unit").agg(F.first("grp").alias("grp"), F.first("centre").alias("vec"), F.max("angle").alias("r"))
        units = written(single.select("node", "grp", "vec", "r").unionAll(ball.select(F.col("unit").alias("node"), "grp", "vec", (F.col("r") + 1e-9).alias("r"))))
        member = single.select(F.col("node").alias("unit"), "node", "w", "id", "vec", F.lit(False).alias("ball")).unionAll(nodes.join(near.select("unit", "node"), "node").select("unit", "node", "w", "id", "vec", F.lit(True).alias("ball")))
        singles = single.select("node")
        graph = graph.join(singles.withColumnRenamed("node", "u"), "u", "left_semi").join(singles.withColumnRenamed("node", "v"), "v", "left_semi")
        graph = descend(units, graph, 2, grow=True)
    for k in range(ROUNDS):
        recall, lost = _audit(units, graph, k)
        if recall >= RECALL:
            break
        graph = descend(units, graph.select("u", "v", "s", "link").unionAll(lost), 3 + k, TABLES * (k + 2), grow=True)
    graph = graph.select("u", "v", "s", "link").unionAll(lost).filter("link")

    member = written(member)
    total = member.groupBy("unit").agg(F.sum("w").alias("total"))
    pairs = graph.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "s").groupBy("a", "b").agg(F.max("s").alias("s"))
    size = units.select(F.col("node").alias("unit"), "r").join(total, "unit")
    for side in ("a", "b"):
        pairs = pairs.join(size.withColumnsRenamed({"unit": side, "r": f"r{side}", "total": f"t{side}"}), side)
    r = F.col("ra") + F.col("rb")
    sure = (r == 0) | (F.acos(F.least("s", F.lit(1.0))) + r <= 2 * HALF)
    pairs = written(pairs.withColumn("sure", sure))
    whole = pairs.filter("sure")
    open_ = written(_across(pairs.filter("NOT sure").select("a", "b"), member))
    of_unit = whole.select(F.col("a").alias("unit"), F.col("tb").alias("n")).unionAll(whole.select(F.col("b").alias("unit"), F.col("ta").alias("n"))).groupBy("unit").agg(F.sum("n").alias("x"))
    of_node = open_.groupBy("node").agg(F.sum("n").alias("y"))
    comp = components(whole.select("a", "b").unionAll(open_.select("a", "b").distinct())).withColumnsRenamed({"node": "unit"})
    out = member.join(total, "unit").join(of_unit, "unit", "left").join(of_node, "node", "left").join(comp, "unit", "left").withColumn("comp", F.coalesce("comp", "unit"))
    inside = F.when(F.col("ball"), F.col("total")).otherwise(F.col("w")) - 1
    out = out.select("node", "id", "comp", (inside + F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("n_links"))
    least = out.groupBy("comp").agg(F.min("id").alias("component"))
    return out.join(least, "comp").select("node", "n_links", "component")


def apply(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of vectors."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"), F.concat_ws(":", F.size("embedding"), F.col("label").cast("string")).alias("grp"), F.col("label").isNotNull().alias("has"))
    finite = F.forall("vec", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))) & F.exists("vec", lambda c: c != 0)
    rows = rows.withColumn("good", F.coalesce(F.col("has") & finite, F.lit(False)))
    good = rows.filter("good")
    nodes = good.select("grp", "vec", "vec_id").distinct().groupBy("grp", "vec").agg(F.count("*").alias("w"), F.min("vec_id").alias("id"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = nodes.select("grp", "vec", "node").join(links(nodes), "node").select("grp", "vec", "n_links", "component")
    out = good.join(found, ["grp", "vec"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    out = out.unionAll(rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "embeddings"))


#: DuckDB, over `embeddings`.
SQL = f"""WITH RECURSIVE vg_v AS MATERIALIZED (SELECT vec_id, label, [v::DOUBLE for v in embedding] AS x, sqrt(list_sum([v::DOUBLE * v for v in embedding])) AS n FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
vg_l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM vg_v a JOIN vg_v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= {LEAST}),
vg_e AS (SELECT a, b FROM vg_l UNION ALL SELECT b, a FROM vg_l),
vg_d AS (SELECT a, count(*) AS n FROM vg_e GROUP BY a),
vg_g AS (SELECT a AS id, a AS c FROM vg_e UNION SELECT e.b, g.c FROM vg_g g JOIN vg_e e ON e.a = g.id AND g.c < e.b),
vg_c AS (SELECT id, min(c) AS c FROM vg_g GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id))::BIGINT AS component_id, least(vec_id, coalesce(c, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN vg_d ON vg_d.a = vec_id LEFT JOIN vg_c ON vg_c.id = vec_id
"""

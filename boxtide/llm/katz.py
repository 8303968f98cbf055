"""Bigram language model with Katz backoff.

Counts are discounted after Good and Turing up to CUT; P(w) = d c(w) / (N + 1), what that leaves is the probability of
all unknown words together. P(w | h) = d r(h, w) / (c(h) + 1) for a bigram seen r times in training, else
a(h) P(w), with a(h) such that the sum over all words is exactly 1. (The one added to each denominator is an unseen
event: a history whose followers are all frequent keeps some mass to back off with.) The first word's history is a
start mark, the last token an end mark.

The counts live in tables partitioned by the hash of the word. Documents are dealt to them as packed arrays: for each
unit of about UNIT tokens and each partition, the words' hashes, the histories' hashes of each word once, and the
documents of each bigram. A partition so holds all of a word's count and bigrams, and gives each document the sum of
what it can settle: log(d r), or log P(w) of a bigram not seen, and -log(c(w) + 1) for the word as the next token's
history. What a history's followers add to a(h), and the unseen bigrams that ask for it, then meet in a second table
partitioned by the history's hash. The discounts need counts of counts over all partitions first; the same exchange is
read once for these and once for the scores.

Defined results: a null text is empty and has the end token alone; without training rows every probability is 1 (the
unknown word's) and the base is log10(1); rows that repeat a doc_id count and are scored each; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import bucket_of, table, text_of

CUT, UNIT = 5, 1 << 21
START, END = np.uint64(0x9AF1_30C5_77D2_4E01), np.uint64(0x1B5D_C0A7_3E99_8F43)
_SCHEMA = "key long, kind int, unit long, blob binary"
_U = np.uint64


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind their lengths and types."""
    head = [f"{a.dtype.str},{len(a)}" for a in arrays]
    top = ";".join(head).encode()
    return len(top).to_bytes(4, "little") + top + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    at, out = 4 + n, []
    for part in blob[4:at].decode().split(";"):
        kind, size = part.split(",")
        out.append(np.frombuffer(blob, np.dtype(kind), int(size), at))
        at += out[-1].nbytes
    return out


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    key, kind, unit, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(unit, pa.int64()), pa.array(blob, pa.binary())], names=["key", "kind", "unit", "blob"])


def _dealt(buckets: int):
    """(doc_id, held_out, text) -> a unit's documents (kind 0) and its bigrams by bucket (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId() << 32
        ws: list[np.ndarray] = []
        hs: list[np.ndarray] = []
        ds: list[np.ndarray] = []
        ids: list[int | None] = []
        held: list[bool] = []
        sizes: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            w, h, d = np.concatenate(ws), np.concatenate(hs), np.concatenate(ds)
            train = ~np.array(held, bool)
            none = np.array([i is None for i in ids])
            out = [(unit % buckets, 0, unit, _pack(np.array([i or 0 for i in ids], np.int64), none, train, np.concatenate(sizes).astype(np.int64)))]
            bucket = (w % _U(buckets)).astype(np.int64)
            order = np.lexsort((h, w, bucket))
            w, h, d, bucket = w[order], h[order], d[order].astype(np.uint16), bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                s, e = int(edge[b]), int(edge[b + 1])
                if s == e:
                    continue
                x, y = w[s:e], h[s:e]
                new_w = np.ones(e - s, bool)
                new_w[1:] = x[1:] != x[:-1]
                new = new_w.copy()
                new[1:] |= y[1:] != y[:-1]
                at = np.flatnonzero(new)
                first = np.flatnonzero(new_w[at])
                out.append((b, 1, unit, _pack(x[new_w], np.diff(np.append(first, len(at))).astype(np.uint32), y[at], np.diff(np.append(at, e - s)).astype(np.uint32), d[s:e], np.packbits(train), np.array([len(train)], np.uint32))))
            for c in (ws, hs, ds, ids, held, sizes):
                c.clear()
            return _rows(out)

        for batch in batches:
            for a, b, data, off in tk.blocks(batch.column(2)):
                n = b - a
                start, end, row = tk.words(data, off)
                per = np.bincount(row, minlength=n)
                last = np.cumsum(per + 1) - 1  # a row's end token
                first = last - per
                w = np.full(int(last[-1]) + 1, END, np.uint64)
                place = np.arange(len(row)) + row
                w[place] = tk.hashes(data, start, end, lower=True)
                h = np.empty_like(w)
                h[1:] = w[:-1]
                h[first] = START
                if len(ids) + n > 60_000 or (tokens and tokens + len(w) > UNIT):
                    yield flush()
                    unit += 1
                    tokens = 0
                ws.append(w)
                hs.append(h)
                ds.append(np.repeat(np.arange(n) + len(ids), per + 1))
                sizes.append(per + 1)
                ids += batch.column(0).slice(a, n).to_pylist()
                held += batch.column(1).slice(a, n).to_pylist()
                tokens += len(w)
        if ids:
            yield flush()

    return run


class _Bucket:
    """All units' bigrams of one bucket: counts of its words (c) and bigrams (r), and the events."""

    def __init__(self, t: pa.Table) -> None:
        self.units, self.docs = [], []
        w, pairs_of, h, events_of, doc, train = [], [], [], [], [], []
        base = 0
        for unit, blob in sorted((u, b) for u, k, b in zip(t.column("unit").to_pylist(), t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True) if k == 1):
            a = _unpack(blob)
            n = int(a[6][0])
            self.units.append(unit)
            self.docs.append(n)
            w.append(a[0])
            pairs_of.append(a[1])
            h.append(a[2])
            events_of.append(a[3])
            doc.append(a[4].astype(np.int32) + np.int32(base))
            train.append(np.unpackbits(a[5], count=n).astype(bool))
            base += n
        self.n_docs, self.any = base, base > 0
        if not self.any:
            return
        self.doc, self.train = np.concatenate(doc), np.concatenate(train)
        events_of = np.concatenate(events_of).astype(np.int64)
        word = np.repeat(np.concatenate(w), np.concatenate(pairs_of))
        hist = np.concatenate(h)
        key, first, pair = np.unique(tk.mix(word) + hist * _U(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        self.word, self.hist = word[first], hist[first]  # by distinct bigram
        self.pair = np.repeat(pair.astype(np.int32), events_of)  # by event
        self.r = np.bincount(self.pair, weights=self.train[self.doc], minlength=len(key)).astype(np.int64)
        self.words, self.word_of = np.unique(self.word, return_inverse=True)
        self.c = np.bincount(self.word_of, weights=self.r, minlength=len(self.words)).astype(np.int64)


def _count(t: pa.Table) -> pa.Table:
    """N, V, D and the numbers of words and bigrams counted 1 .. CUT + 1 times."""
    b = _Bucket(t)
    out = np.zeros(3 + 2 * (CUT + 1))
    if b.any:
        out[0], out[1] = b.c.sum(), (b.c > 0).sum()
        out[2] = b.c[b.words == END].sum()
        for k in range(CUT + 1):
            out[3 + k] = (b.c == k + 1).sum()
            out[4 + CUT + k] = (b.r == k + 1).sum()
    return pa.table({f"n{i}": pa.array([v]) for i, v in enumerate(out.tolist())})


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0 .. CUT from the numbers of types counted 1 .. CUT + 1 times; 1 where these are no use."""
    d = np.ones(CUT + 1)
    if n[0] > 0 and (high := (CUT + 1) * n[CUT] / n[0]) < 1:
        for r in range(1, CUT + 1):
            if n[r - 1] > 0:
                x = ((r + 1) * n[r] / n[r - 1] / r - high) / (1 - high)
                d[r] = x if 0 < x <= 1 else 1
    return d


def _less(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts * np.where(counts <= CUT, d[np.minimum(counts, CUT)], 1.0)


def _scored(buckets: int):
    """A bucket's bigrams -> documents' sums (kind 1), histories' sums (kind 2) and questions for a(h) (kind 3)."""

    def run(t: pa.Table) -> pa.Table:
        out = [(u, 0, u, blob) for u, k, blob in zip(t.column("unit").to_pylist(), t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True) if k == 0]
        b = _Bucket(t)
        if b.any:
            s = np.array(t.column("stats")[0].as_py())
            total, kinds = s[0], s[3 : 4 + CUT]
            du, db = discounts(kinds), discounts(s[4 + CUT :])
            spare = (1 + ((1 - du[1:]) * np.arange(1, CUT + 1) * kinds[:CUT]).sum()) / (total + 1)
            p = np.where(b.c > 0, _less(b.c, du) / (total + 1), spare)
            seen = b.r > 0
            by_pair = np.where(seen, np.log10(np.maximum(_less(b.r, db), 1e-300)), np.log10(p)[b.word_of])
            # the word as the next token's history
            by_pair = by_pair - np.where(b.word == END, 0, np.log10(b.c + 1)[b.word_of])
            c_event = b.c[b.word_of][b.pair]
            add = lambda x: np.bincount(b.doc, weights=x, minlength=b.n_docs)
            here, known, base, score = np.bincount(b.doc, minlength=b.n_docs), add(c_event > 0), add(np.log10(c_event + 1)), add(by_pair[b.pair])
            at = 0
            unit_of = np.repeat(np.arange(len(b.units)), b.docs)
            start = np.cumsum([0, *b.docs])
            for u, n in zip(b.units, b.docs, strict=True):
                d = np.flatnonzero(here[at : at + n])  # only documents with a token in this bucket
                out.append((u, 1, u, _pack(d.astype(np.uint16), known[at + d].astype(np.uint32), base[at + d], score[at + d])))
                at += n
            hb = (b.hist % _U(buckets)).astype(np.int64)
            order = np.flatnonzero(seen)[np.lexsort((b.hist[seen], hb[seen]))]
            hist = b.hist[order]
            first = np.flatnonzero(np.append(True, hist[1:] != hist[:-1])) if len(hist) else np.zeros(0, np.int64)
            if len(hist):
                lost = np.add.reduceat((b.r - _less(b.r, db))[order], first)
                mass = np.add.reduceat(p[b.word_of[order]], first)
                edge = np.searchsorted(hb[order][first], np.arange(buckets + 1))
                for k in range(buckets):
                    x, y = edge[k], edge[k + 1]
                    if x < y:
                        out.append((-1 - k, 2, 0, _pack(hist[first][x:y], lost[x:y], mass[x:y])))
            ask = np.flatnonzero(~seen[b.pair])
            ask = ask[np.argsort(hb[b.pair[ask]], kind="stable")]
            edge = np.searchsorted(hb[b.pair[ask]], np.arange(buckets + 1))
            units = np.array(b.units, np.int64)
            for k in range(buckets):
                q = ask[edge[k] : edge[k + 1]]
                if len(q):
                    u = unit_of[b.doc[q]]
                    out.append((-1 - k, 3, 0, _pack(b.hist[b.pair[q]], u.astype(np.uint32), (b.doc[q] - start[u]).astype(np.uint16), units)))
        return pa.Table.from_batches([_rows(out)])

    return run


def _backed_off(t: pa.Table) -> pa.Table:
    """Of a history bucket: a(h) for each question, summed by document (kind 4). Of a unit: its rows, sums added up."""
    kind = np.array(t.column("kind").to_pylist())
    blobs, units = t.column("blob").to_pylist(), t.column("unit").to_pylist()
    if t.column("key")[0].as_py() >= 0:
        out = [(u, 0, u, blob) for u, k, blob in zip(units, kind.tolist(), blobs, strict=True) if k == 0]
        n = len(_unpack(out[0][3])[0])
        sums = np.zeros((3, n))
        for k, blob in sorted(zip(kind.tolist(), blobs, strict=True)):
            if k == 1:
                d, *values = _unpack(blob)
                for total, v in zip(sums, values, strict=True):
                    total[d] += v
        out.append((units[0], 1, units[0], _pack(*sums)))
        return pa.Table.from_batches([_rows(out)])
    tables = [_unpack(x) for k, x in zip(kind.tolist(), blobs, strict=True) if k == 2]
    asked = [_unpack(x) for k, x in zip(kind.tolist(), blobs, strict=True) if k == 3]
    if not asked or not tables:
        return pa.Table.from_batches([_rows([])])
    hist, back = np.unique(np.concatenate([x[0] for x in tables]), return_inverse=True)
    lost = 1 + np.bincount(back, weights=np.concatenate([x[1] for x in tables]))
    rest = np.maximum(1 - np.bincount(back, weights=np.concatenate([x[2] for x in tables])), 1e-9)
    weight = np.log10(lost) - np.log10(rest)
    out = []
    per: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for h, u, d, names in asked:
        i = np.searchsorted(hist, h)
        i[i == len(hist)] = 0
        value = np.where(hist[i] == h, weight[i], 0.0)
        order = np.argsort(u, kind="stable")
        edge = np.searchsorted(u[order], np.arange(len(names) + 1))
        for k, unit in enumerate(names.tolist()):
            if edge[k] < edge[k + 1]:
                q = order[edge[k] : edge[k + 1]]
                per.setdefault(unit, []).append((d[q], value[q]))
    for unit, parts in sorted(per.items()):
        d, v = np.concatenate([x[0] for x in parts]).astype(np.int64), np.concatenate([x[1] for x in parts])
        s = np.bincount(d, weights=v)
        at = np.flatnonzero(np.bincount(d))
        out.append((unit, 4, unit, _pack(at.astype(np.uint16), s[at])))
    return pa.Table.from_batches([_rows(out)])


def _final(t: pa.Table) -> pa.Table:
    """A unit's rows -> its documents."""
    s = np.array(t.column("stats")[0].as_py())
    kinds: dict[int, list[bytes]] = {}
    for k, blob in sorted(zip(t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True)):
        kinds.setdefault(k, []).append(blob)
    ids, none, train, size = _unpack(kinds[0][0])
    known, base, score = _unpack(kinds[1][0])
    score = score - np.log10(s[2] + 1)  # the start mark as the first token's history
    for blob in kinds.get(4, []):
        at, v = _unpack(blob)
        score[at] += v
    return pa.table({
        "doc_id": pa.array(ids, mask=none), "held_out": pa.array(~train), "n_tokens": pa.array(size), "n_known": pa.array(np.rint(known).astype(np.int64)),
        "train_tokens": pa.array(np.full(len(ids), int(s[0]))), "base_score": pa.array(base - size * np.log10(s[0] + s[1] + 1)), "score": pa.array(score),
    })


def apply(docs: DataFrame, held: int = 2, folds: int = 7) -> DataFrame:
    """Scores of every text under the model of the texts that are not held out."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (bucket_of(docs["doc_id"], folds) == held).alias("held_out"), text_of(docs).alias("text"))
    dealt = rows.mapInArrow(_dealt(buckets), _SCHEMA).repartition(buckets, "key")
    n = 3 + 2 * (CUT + 1)
    counted = dealt.groupBy("key").applyInArrow(_count, ", ".join(f"n{i} double" for i in range(n)))
    stats = counted.agg(F.array(*[F.sum(f"n{i}") for i in range(n)]).alias("stats"))
    with_stats = dealt.join(F.broadcast(stats), F.lit(True))  # one row
    scored = with_stats.groupBy("key").applyInArrow(_scored(buckets), _SCHEMA)
    summed = scored.groupBy("key").applyInArrow(_backed_off, _SCHEMA)
    return summed.join(F.broadcast(stats), F.lit(True)).groupBy("unit").applyInArrow(_final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))

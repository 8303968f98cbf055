"""Phrase mining against brute force and SQL; the perfect hash against its definition."""

import re
from collections import Counter

import numpy as np
import pytest

from boxtide.llm import collocations
from boxtide.llm.perfect_hash import PerfectHash
from tests.llm.conftest import SCHEMA, edge_rows
from tests.oracle import duck, rows


def brute(texts, least, top=2000, subsumed=100):
    count, n = Counter(), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {x: c for x, c in count.items() if c >= least}
    out, longer = [], Counter()
    for (lang, q), b in f.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                longer[lang, q[i : i + k]] = max(b, longer[lang, q[i : i + k]])
    for (lang, p), a in f.items():
        if len(p) > 1 and not (longer[lang, p] and 100 * longer[lang, p] >= subsumed * a):
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, score, a, " ".join(p), l, r))
    got = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        got += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (_, s, a, p, l, r) in enumerate(own[:top])]
    return sorted(got)


def made_texts():
    rng = np.random.default_rng(4)
    words = np.array(["Aa", "bb", "cc", "éé", "日本", "dd", "ee", "ff"])
    p = np.array([30, 20, 10, 8, 6, 4, 2, 1]) / 81
    texts = [(["en", "de", None, "und"][i % 4], "".join(w + s for w, s in zip(rng.choice(words, 40, p=p), rng.choice([" ", "\t", ". ", "\n", " ,"], 40, p=[0.8, 0.05, 0.05, 0.05, 0.05]), strict=True))) for i in range(40)]
    return [*texts, ("en", None), ("en", ""), ("en", " \t\n.,"), ("fr", "aa aa aa aa aa aa aa"), (None, "x\x0by\x0cz\rq"), texts[0]]


@pytest.mark.parametrize(("least", "top", "subsumed"), [(3, 2000, 100), (5, 4, 60)])
def test_phrases(spark, monkeypatch, least, top, subsumed):
    monkeypatch.setattr(collocations, "SLOTS", 150)  # several parts a level
    monkeypatch.setattr(collocations, "BUCKETS", collocations.CHUNK)
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "k", 1) for i, (lang, t) in enumerate(texts)], SCHEMA).repartition(4)
    got = collocations.apply(docs, least, top, subsumed)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(texts, least, top, subsumed)
    assert len(want) > 10 and sorted(tuple(r) for r in got.collect()) == want


def test_phrases_edges(spark, edge, empty):
    assert sorted(tuple(r) for r in collocations.apply(edge, 2).collect()) == brute([(r[2], r[1]) for r in edge_rows()], 2)
    assert collocations.apply(empty).count() == 0
    assert collocations.apply(edge, 10**9).count() == 0


def test_phrases_sql(spark):
    d = "/root/testdata/sf0.01"
    got, want = collocations.query(spark, d).toPandas(), duck(d).sql(collocations.SQL).df()
    assert len(got) > 20 and rows(got) == rows(want)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        h = PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        other = h.slots(rng.integers(0, 2**64, 1000, dtype=np.uint64))
        assert ((other >= -1) & (other < max(1, len(keys)))).all()


def test_buckets_grow_with_the_tokens():
    """With a fixed number every bucket of a large table reaches `least`, and every phrase is a candidate."""
    for tokens in (10**6, 2 * 10**9, 8 * 10**9):
        assert tokens / collocations._buckets(tokens) <= 8
    assert collocations._buckets(10**12) == collocations.MOST_BUCKETS


def test_bins_take_memory_by_windows_and_sums_hold_a_chunk(monkeypatch):
    monkeypatch.setattr(collocations, "WINDOWS", 1000)
    monkeypatch.setattr(collocations, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    rng = np.random.default_rng(1)
    w = [[rng.integers(0, 40, 600).astype(np.int32) for _ in range(2)] for _ in range(20)] + [[np.zeros(700, np.int32)] * 2] * 2
    sent = list(collocations._binned(iter(w), 1 << 28))
    rows = sorted(((c, p, n) for b in sent for c, p, n in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True)), key=lambda r: r[0])
    assert len(sent) > 10 and any(b.column(3)[0].as_buffer().size // (b.column(2)[0].as_buffer().size // 2) == 4 for b in sent)
    import pyarrow as pa

    ordered = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1].as_py() for r in rows], pa.binary()), pa.array([r[2].as_py() for r in rows], pa.binary())], names=["chunk", "salt", "places", "counts"])
    got = {}
    for b in collocations._summed(iter([ordered])):
        at, n = collocations._counts(b.column(2)[0], b.column(3)[0])
        assert b.column(0)[0].as_py() not in {k >> 15 for k in got}
        got |= {(b.column(0)[0].as_py() << 15) + int(a): int(x) for a, x in zip(at, n, strict=True)}
    at, n = np.unique(np.concatenate([collocations._hash(x) & np.uint64((1 << 28) - 1) for x in w]), return_counts=True)
    assert got == dict(zip(at.tolist(), n.tolist(), strict=True))

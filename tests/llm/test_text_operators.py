"""Operators held against brute force, exact round trips and goldens, on a small table with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from boxtide.llm import fingerprints, html_text, katz, line_dedup, near_dedup, packing, quality_rules, sentencepieces, tokens
from tests.llm.conftest import edge_rows
from tests.oracle import duck, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute_lines(docs, least=50):
    """Lines that lie in a run of at least `least` words that an earlier place has, by all shortest such runs from each line on and back."""
    seqs = [(d, [(s, len(WORD.findall(s))) for s in (t or "").split("\n") if WORD.search(s)]) for d, t in docs]
    runs = []
    for k, (_, v) in enumerate(seqs):
        for p in range(len(v)):
            for step in (1, -1):
                n, e = 0, p
                while 0 <= e < len(v):
                    n += v[e][1]
                    if n >= least:
                        runs.append((k, min(p, e), max(p, e) + 1))
                        break
                    e += step
    first, dead = {}, Counter()
    gone = {k: set() for k in range(len(seqs))}
    for k, a, b in sorted(set(runs)):
        key = tuple(s for s, _ in seqs[k][1][a:b])
        if key in first:
            gone[k].update(range(a, b))
        else:
            first[key] = (k, a)
    return {seqs[k][0]: len(g) for k, g in gone.items()} | dead


def test_line_dedup(edge, empty):
    got = line_dedup.apply(edge)
    assert got.columns == [*edge.columns, "ld_lines", "ld_deleted"]
    docs = sorted({(-(2**63) if r[0] is None else r[0], r[1] or "") for r in edge_rows()})
    want = brute_lines(docs)
    have = {(-(2**63) if r.doc_id is None else r.doc_id): r for r in got.collect()}
    assert {k: r.ld_deleted for k, r in have.items()} == want
    assert have[108].text == "" and have[110].text == "other start\nother end"
    assert len(WORD.findall(have[111].text)) == 1 and got.count() == len(edge_rows())
    assert line_dedup.apply(empty).count() == 0


@pytest.mark.parametrize("lines", [1, 2])
def test_line_dedup_repeat_that_goes_on_in_the_later_copy(spark, lines):
    """The longest repeat has exactly 2**k lines, and a short line follows it that recurs elsewhere."""
    a = "\n".join(" ".join(f"a{k}x{i}" for i in range(60)) for k in range(lines))
    docs = [(1, a), (2, f"{a}\nc one two"), (3, "c one two\nother words")]
    got = {r.doc_id: (r.ld_deleted, r.text) for r in line_dedup.apply(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: n for d, (n, _) in got.items()} == brute_lines(docs)
    assert got[2] == (lines, "c one two") and got[1] == (0, a)


def test_fingerprints(edge, empty):
    got = fingerprints.apply(edge.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = [t or "" for t in dict(sorted((r[0], r[1]) for r in edge_rows() if r[0] is not None)).values()]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        nxt, k = texts[(i + 1) % len(texts)], len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        assert got.n_chars[i] == len(t) and got.edited_sha256[i] == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = shingle_set(t), shingle_set(e), shingle_set(nxt)
        if len(a) > 200:
            assert abs(got.near_edited[i] - len(a & b) / len(a | b)) < 0.12 and abs(got.near_next[i] - len(a & c) / len(a | c)) < 0.12
    assert got.fingerprint[7] == got.fingerprint[8] and got.near_next[7] == 1.0
    assert got.fingerprint[0] == got.fingerprint[1] == "" and got.near_next[0] == 1.0 and got.near_next[2] == 0.0
    assert got.fingerprint[3] == got.fingerprint[4]
    assert fingerprints.apply(edge).count() == len(edge_rows()) and fingerprints.apply(empty).count() == 0


def test_near_dedup_components(spark, edge, empty):
    rnd = random.Random(5)
    base = [f"t{rnd.randrange(900)}" for _ in range(300)]
    rows_ = [(r[0], r[1]) for r in edge_rows()]
    for i in range(60):  # near copies of one text, chains among them, and half-shared texts that must not link
        t = list(base)
        for _ in range(rnd.randrange(12)):
            t[rnd.randrange(300)] = f"n{rnd.randrange(10**6)}"
        rows_.append((200 + i, " ".join(t)))
        rows_.append((300 + i, " ".join(base[:150] + [f"m{rnd.randrange(10**6)}" for _ in range(150)])))
    got = {r.doc_id: r for r in near_dedup.apply(spark.createDataFrame(rows_, "doc_id long, text string").repartition(4)).collect()}
    sets = {i: shingle_set(t) for i, t in rows_ if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root(i), root(i) == i), i
    assert got[None].component_id is None and got[None].kept
    assert near_dedup.apply(empty).count() == 0


@pytest.mark.parametrize("module", [quality_rules, near_dedup])
def test_sql(spark, small, module):
    assert rows(module.query(spark, small).toPandas()) == rows(duck(small).sql(module.SQL).df())


def test_quality_rules_edges(edge, empty):
    got = quality_rules.apply(edge.drop("kept"), ["doc_id", "score"]).toPandas()
    assert len(got) == len(edge_rows())
    for r in got.itertuples():
        t = next((x[1] for x in edge_rows() if x[0] == r.doc_id or (x[0] is None and pd.isna(r.doc_id))), None) or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {p for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[x] > 1 for p in (i, i + 1, i + 2)}
        lines = [s for s in t.split("\n") if WORD.search(s)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.apply(empty.drop("kept"), ["doc_id"]).count() == 0


def test_quality_rules_keep_users_columns(spark):
    """Columns named as the measures, as working columns and as the fences' keys come through as they were, types too."""
    good = " ".join(f"word{i} of text{i % 7}" for i in range(60))
    rows = [(i, good if i % 3 else None, "en", "s", "yes", i, "w", 1.5, "d", "r", "b", "l", "x") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, n_words int, word_chars string, n_symbols double, n_dup_lines string, n_repeat_words string, base_failed string, qr_lang string, in_0 string")
    got = quality_rules.stage(spark, docs, "")
    assert got.schema == docs.schema and sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[1])
    assert quality_rules.stage(spark, docs.limit(0), "").count() == 0
    assert {r.kept for r in quality_rules.apply(docs, docs.columns).collect()} == {True, False}


def test_quality_rules_wide_text(spark):
    """Beyond 2**18 words, distinct windows are not taken for repeats, and true ones are found."""
    text = " ".join(f"w{i}" for i in range(1_000_000))
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, f"{text} w5 w6 w7", "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.measures(docs, ["doc_id"]).select("doc_id", "n_words", "n_repeat_words").collect()}
    assert got == {1: (1_000_000, 0), 2: (1_000_003, 6)}


def test_sketch_merges(spark):
    """A quantile of the merged level equals that of all values' buckets, and buckets are within 1/32."""
    q = quality_rules
    for v in (0, 1, 63, 64, 65, 1000, 123456):
        drop = max(v.bit_length() - q.SIGNIFICANT, 0)
        assert 0 <= v - (v >> drop << drop) <= v / 32


def test_packing(edge, empty):
    path = packing.vocabulary()
    enc = tokens.Encoder(path)
    got = packing.apply(edge, path).toPandas()
    want = Counter()
    for d, t in [(r[0], r[1] or "") for r in edge_rows()]:
        ids = np.array([*enc.tokenizer.encode(t, add_special_tokens=False).ids, packing.END], "<u4")
        for s in range(0, len(ids), packing.LENGTH):
            want[(-1 if d is None else d, s, len(ids[s : s + packing.LENGTH]), zlib.crc32(ids[s : s + packing.LENGTH].tobytes()), len(ids))] += 1
    assert Counter((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= packing.LENGTH
    assert packing.apply(empty, path).count() == 0


def test_column_generation():
    rnd = random.Random(1)
    demand = dict(Counter(min(256, int(rnd.lognormvariate(3.5, 1)) + 1) for _ in range(20000)))
    plan = packing.solve(demand, 256)
    used = Counter()
    for pattern, times in plan:
        assert sum(w * n for w, n in pattern.items()) <= 256
        for w, n in pattern.items():
            used[w] += n * times
    assert used == demand
    assert sum(t for _, t in plan) <= math.ceil(sum(w * n for w, n in demand.items()) / 256 * 1.02)
    assert packing.solve({}, 256) == []


def test_encoder_is_exact():
    enc = tokens.Encoder(packing.vocabulary())
    rnd = random.Random(3)
    parts = ["a", "B", "'s", "'", "!", "…", "é", "é", "≠", "1", " ", "\n", " ", "<|endoftext|>", "<|", "'re", "İ", "　", "日", "'LL", "-", "ß", "\x0b", "٣"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + [None]
    for t, ids in zip(texts, enc.encode(pa.array(texts)), strict=True):
        assert list(map(int, ids)) == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


def _viterbi(p, pts):
    score, ids = p.spans(pts, np.zeros(len(pts), int))
    best, took = [0.0] + [-np.inf] * len(pts), [0] * (len(pts) + 1)
    for j in range(1, len(pts) + 1):
        for k in range(min(p.longest, j), 0, -1):
            if best[j - k] + score[k - 1, j - 1] > best[j]:
                best[j], took[j] = best[j - k] + score[k - 1, j - 1], k
    out, j = [], len(pts)
    while j:
        out.append(took[j])
        j -= took[j]
    return best[-1], p._emit(pts, ids, len(pts) - 1, out)


def test_max_plus_scan():
    p = sentencepieces.encoder(sentencepieces.model_path()).pieces
    rnd, k = random.Random(2), p.longest
    for n in (1, 15, 64, 65, 256, 272, 1003, 3000):
        pts = sentencepieces._points("".join(rnd.choice("the of and ▁in日é") for _ in range(n)))
        best, ids = _viterbi(p, pts)
        assert p.trace(pts, 0, 0, 0) == ids and p.matrix(pts, 0)[0, 0] == best
        if n > 600:  # two parts worked out apart
            c = n // 2
            a, b = p.matrix(pts[:c], 0), p.matrix(pts[c - k :], k)
            state = int((a[0] + b[:, 0]).argmax())
            assert p.trace(pts[:c], 0, 0, state) + p.trace(pts[c - k :], k, state, 0) == ids


def test_sentencepieces_against_library_and_back(edge, empty, monkeypatch):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = sentencepieces.model_path()
    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    p = sentencepieces.encoder(path).pieces
    value = lambda ids: sum(m.pieces[int(i)].score for i in ids)
    for w in "the then reading isn't world's internationalisation".split():
        assert value(p.segment([sentencepieces.SPACE + w])[0]) == max(value(x) for x in lib.nbest_encode_as_ids(w, 8))
    whole = {(r.doc_id, r.part): list(r.ids) for r in sentencepieces.encode(edge, path).collect()}
    assert len([k for k in whole if k[1] > 0]) > 0  # the long text went through parts
    for d, t in {(r[0], r[1] or "") for r in edge_rows()}:
        ids = sum((whole[k] for k in sorted((k for k in whole if k[0] == d), key=lambda k: k[1])), [])
        assert p.decode(np.array(ids, np.int64)).decode() == t.replace(sentencepieces.SPACE, " ") if t else ids == []
    monkeypatch.setattr(sentencepieces, "PART", 1 << 22)
    for r in sentencepieces.encode(edge.filter("doc_id = 107"), path).collect():
        assert list(r.ids) == sum((whole[k] for k in sorted(k for k in whole if k[0] == 107)), [])
    assert sentencepieces.encode(empty, path).count() == 0


@pytest.fixture
def giants(spark, tmp_path):
    """A folder whose documents exceed PART: words, text without a space, runs of spaces, and each of them at odd lengths."""
    rnd = random.Random(5)
    words_ = " ".join("".join(rnd.choice("etaoinshrdlu日é▁") for _ in range(rnd.randint(1, 12))) for _ in range(30000))
    solid = "".join(rnd.choice("theinganor日é") for _ in range(sentencepieces.PART + 7))
    texts = [words_, solid, " " + words_[:70000] + " " * 3000 + words_[: 2 * sentencepieces.PART - 73000], "short one", " two  spaces ", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    return tmp_path, texts


@pytest.mark.parametrize("kind", [1, 2])
def test_sentencepieces_query_decodes_giants(spark, giants, kind, monkeypatch):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(sentencepieces.model_path(), "rb").read())
    m.trainer_spec.model_type = kind
    (giants[0] / "file.model").write_bytes(m.SerializeToString())
    monkeypatch.setattr(sentencepieces, "model_path", lambda: str(giants[0] / "file.model"))
    got = sentencepieces.query(spark, str(giants[0])).toPandas()
    assert set(got.doc_id) == set(range(len(giants[1]))) and (got.groupby("doc_id").part.max() > 0).sum() >= 2
    assert [x for x in got.decoded if x is not True] == []


def test_sentencepieces_ids_are_the_librarys(spark, edge, giants, small):
    import sentencepiece

    path = sentencepieces.model_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    p = sentencepieces.encoder(path).pieces
    assert [p.merge(sentencepieces.SPACE + w) for w in ("the", "that", "and")] == [[lib.piece_to_id(f"▁{w}")] for w in ("the", "that", "and")]
    for t in ("a" * 5000, " " * 700 + "x", "the" * 300, "ab" * 33 + "日" * 40):  # chunks over SHORT
        assert p.merge(sentencepieces.SPACE + t.replace(" ", sentencepieces.SPACE)) == lib.encode(t)
    for df in (edge.dropDuplicates(["doc_id", "text"]), spark.read.parquet(f"{giants[0]}/documents.parquet"), spark.read.parquet(f"{small}/documents.parquet")):
        text = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        got = {d: [] for d in text}
        for r in sorted(sentencepieces.encode(df, path).collect(), key=lambda r: r.part):
            got[r.doc_id] += r.ids
        assert [d for d in text if got[d] != lib.encode(text[d])] == []


def test_katz(spark, edge, empty):
    got = katz.apply(edge).toPandas()
    data = [(r[0], [*words(r[1]), "</s>"], zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2) for r in edge_rows()]
    c, b = Counter(), Counter()
    for _, t, train in data:
        if train:
            c.update(t)
            b.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v, h = sum(c.values()), len(c), Counter()
    for (x, _), r in b.items():
        h[x] += r
    kinds = lambda k: katz.discounts(np.array([sum(1 for x in k.values() if x == i) for i in range(1, katz.CUT + 2)], float))
    du, db = kinds(c), kinds(b)
    less = lambda r, d: r * (d[r] if r <= katz.CUT else 1)
    spare = 1 - sum(less(x, du) for x in c.values()) / (n + 1)
    p = lambda w: less(c[w], du) / (n + 1) if c[w] else spare
    held, mass = Counter(), Counter()
    for (x, w), r in b.items():
        held[x] += less(r, db) / (h[x] + 1)
        mass[x] += p(w)
    prob = lambda x, w: less(b[x, w], db) / (h[x] + 1) if b[x, w] else ((1 - held[x]) / (1 - mass[x]) if x in h else 1) * p(w)
    for x in ("<s>", "one", "w1", "never seen"):
        assert sum(prob(x, w) for w in c) + prob(x, "@unknown@") == pytest.approx(1, abs=1e-6)
    for d, t, train in data:
        r = got[got.doc_id.isna()].iloc[0] if d is None else got[got.doc_id == d].iloc[0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train, len(t), sum(1 for w in t if c[w]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(prob(x, w)) for x, w in zip(["<s>", *t[:-1]], t, strict=True)), rel=1e-5)
    assert katz.apply(empty).count() == 0


def test_katz_weights_of_a_history_that_saw_most(spark):
    """1 - mass keeps its digits: scores agree with brute force to nearly double precision."""
    texts = [" ".join(f"a w{(k * 37 + i) % 300}" for i in range(100)) for k in range(40)] + ["q q q q", "a q a q a q"] * 4
    docs = list(enumerate(texts))
    data = [([*t.split(), "</s>"], zlib.crc32(str(d).encode()) % 7 != 2) for d, t in docs]
    c, b, h = Counter(), Counter(), Counter()
    for t, train in data:
        if train and "a q" not in " ".join(t):
            c.update(t)
            b.update(zip(["<s>", *t[:-1]], t, strict=False))
    docs = [(d, t) for (d, t), (_, train) in zip(docs, data, strict=True) if not (train and "a q" in t)]
    for (x, _), r in b.items():
        h[x] += r
    kinds = lambda k: katz.discounts(np.array([sum(1 for x in k.values() if x == i) for i in range(1, katz.CUT + 2)], float))
    n, du, db = sum(c.values()), kinds(c), kinds(b)
    less = lambda r, d: r * (d[r] if r <= katz.CUT else 1)
    spare = (1 + math.fsum(x - less(x, du) for x in c.values())) / (n + 1)
    p = lambda w: less(c[w], du) / (n + 1) if c[w] else spare
    lost, mass = Counter(), Counter()
    for (x, w), r in b.items():
        lost[x] += r - less(r, db)
        mass[x] += p(w)
    weight = lambda x: (1 + lost[x]) / (h[x] + 1) / (1 - mass[x]) if x in h else 1
    prob = lambda x, w: less(b[x, w], db) / (h[x] + 1) if b[x, w] else weight(x) * p(w)
    got = {r.doc_id: r.score for r in katz.apply(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    asked = 0
    for d, t in docs:
        t = [*t.split(), "</s>"]
        asked += ("a", "q") in zip(t, t[1:], strict=False)
        assert got[d] == pytest.approx(sum(math.log10(prob(x, w)) for x, w in zip(["<s>", *t[:-1]], t, strict=True)), rel=1e-11)
    assert asked and mass["a"] > 0.4


def test_html():
    x = html_text.extract
    assert x(None) == x("") == "" and x("plain &lt;text") == "plain <text"
    assert x("<p>One<p>Two <b>bold</b>text<div hidden>no</div><div style='display: none'>no</div>") == "One\n\nTwo boldtext"
    assert x("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>") == "- a\n- b\n  1. x\n  2. y\n- c"
    assert x("<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>Apples<td>3<tr><td>Fig<td>12</table>") == "Cap\nName    Qty\nApples  3\nFig     12"
    assert x("<head><title>T</title><style>p{}</style></head><script>var t='</p>';</script>a<br>b<!-- c -->") == "a\nb"
    assert x("<pre>  keep\n   this</pre>") == "  keep\n   this"
    assert x("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert x("<p>unclosed <a href='x") == "unclosed"


def test_html_forms_formulas_and_graphics():
    x = html_text.extract
    assert x("<p>Size <select><option>Small<option selected>Large</select> please") == "Size\nSmall\nLarge\nplease"
    assert x("<select><option>Any<optgroup label='Fruit'><option>Apple<option label='Fig'>f<optgroup label=Nuts><option hidden>no<option>Almond</select>") == "Any\nFruit\nApple\nFig\nNuts\nAlmond"
    assert x("<p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='TeX'>x=2</annotation></semantics></math>.") == "So x=2."
    assert x("<p>See <svg><title>t</title><desc>d</desc><metadata>m</metadata><style>text{}</style><path d='M0'/><text>North</text><text>So<tspan>uth</tspan></text></svg> here") == "See North South here"
    assert x("<svg><title/><text>kept</text></svg> too") == "kept too"
    assert x("<map name=m><p>Choose <a href=a>one</a><area alt=no></p></map>") == "Choose one"
    assert x("<desc>outside</desc><datalist><option>no</datalist>") == "outside"


def test_html_depth_and_visibility():
    x = html_text.extract
    assert x("<div>" * 250 + "<span hidden>secret</span>shown") == "shown"
    assert x("<div hidden>" + "<div>" * 250 + "</div>" * 250 + "secret</div>shown") == "shown"
    assert x("<b>" * 50000 + "deep" + "</i>" * 50000) == "deep" and x("<blockquote>" * 20000 + "deep").strip() == "deep"
    assert x("<ul><li>" * 3000 + "deep").endswith("- deep") and x("<table><tr><td>" * 500 + "deep") == "deep"
    assert x("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no<img alt=no></div>") == "yes"
    assert x("<table style='visibility:hidden'><caption>no<tr><td>no<td style='visibility:visible'>yes</table>on") == "  yes\n\non"
    assert x("<body style='visibility:hidden'>no<p style='display:none'><b style='visibility:visible'>no") == ""


def test_html_rows():
    x = html_text.extract
    assert x("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>") == "a  b\n   c  d"
    assert x("<table><tbody><tr><td>1</tbody><tr><td>2<tbody><tr><td>3</table>") == "1\n2\n3"
    assert x("<table><tfoot><tr><td>sum<tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>") == "a    b\n     c\nd    e\nsum"
    assert x("<table><tr><td colspan=2>long heading<td>x<tr><td>a<td>b<td>c</table>") == "long heading  x\na  b  c"


def test_html_table(spark):
    t = spark.createDataFrame([(1, "<p>a", "u"), (2, None, "u"), (None, "b", "u"), (1, "<p>a", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.apply(t).collect()) == [(0, "b"), (1, "a"), (1, "a"), (2, "")]


def test_line_counts():
    import numpy as np
    import pyarrow as pa

    from boxtide.llm import textkernel as tk

    rng = np.random.default_rng(1)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(list("a b\n\té \n"), rng.integers(0, 9))) for _ in range(rng.integers(1, 8))]
        for a, b, data, off in tk.blocks(pa.array(texts, pa.string())):
            want = [sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")) for t in texts[a:b]]
            assert line_dedup._line_counts(data, off).tolist() == want


def test_html_bounds():
    """Spans and long cells can't make more text than the page's size warrants, and none gets lost."""
    import time

    page = "<table>" + "<tr><td rowspan=60000 colspan=100>a" * 3000
    began = time.perf_counter()
    got = html_text.extract(page)
    assert time.perf_counter() - began < 1 and len(got) < 10 * len(page) and got.split() == ["a"] * 3000
    wide = "<table><tr><td>" + "x" * 50_000 + "<td>y" + "<tr><td>p<td>q" * 3000
    assert html_text.extract(wide).split() == ["x" * 50_000, "y"] + ["p", "q"] * 3000 and len(html_text.extract(wide)) < 5 * len(wide)
    assert html_text.extract("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"


@pytest.mark.parametrize(("page", "want"), [
    ("<p style='not-display:none'>a</p><p style='DISPLAY : none !important'>b</p><p style='display:none;display:block'>c</p>", "a\n\nc"),
    ("<style>.h, #gone {display:none} p.v{visibility:hidden} /* .k{display:none} */ @media print{.k{display:none}} b{color:red}</style><p class='x h'>1</p><p id=gone>2</p><div class=h>3</div><p class=v>4</p><div class=v>5</div><p class=k>6</p>", "5\n\n6"),
    ("<style>div{display:none} .s{display:block} #t.s{display:none}</style><div>1</div><div class=s>2</div><div class=s id=t>3</div><div style='display:block'>4</div>", "2\n4"),
    ("<p>1<style>@charset 'x'; p i{display:none} i{display:none}</style> <i>2</i> 3", "1 3"),
    ("<dialog>1</dialog><dialog open>2</dialog>", "2"),
    ("<ol reversed><li>a<li>b<li value=9>c<li>d</ol><ol start=-1><li>e<li>f</ol>", "4. a\n3. b\n9. c\n8. d\n\n-1. e\n0. f"),
])
def test_html_visibility(page, want):
    assert html_text.extract(page) == want


def test_html_words_of_random_trees():
    """The words of random pages, in order, against a list made along with the markup."""
    r = random.Random(12)

    def made(depth, seen):
        out, words = "", []
        for _ in range(r.randrange(1, 5)):
            kind = r.choice(["text", "text", "p", "div", "b", "ul", "table", "hide", "style", "pre"]) if depth < 5 else "text"
            if kind == "text":
                w = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 4))]
                out, words = out + " " + "\n ".join(w) + " ", words + (w if seen else [])
                continue
            inner, own = made(5 if kind in ("p", "style") else depth + 1, seen and kind not in ("hide", "style"))  # blocks would end a p, and the span in it
            words += own
            out += {
                "p": f"<div><P>{inner}</div>", "div": f"<div title='>'>{inner}</div>", "b": f"<b>{inner}</b>", "ul": f"<ul><li>{inner}</ul>", "table": f"<table><tr><td>{inner}</table>",
                "hide": f"<div hidden>{inner}</div>", "style": f"<span style='color:red;display:none'>{inner}</span>", "pre": f"<pre>{inner}</pre>",
            }[kind]
        return out, words

    for _ in range(300):
        page, words = made(0, True)
        assert [w for w in html_text.extract(page).split() if w != "-"] == words, page


def test_html_table_of_pages(spark):
    schema = "page_id long, html string, text string, n_chars string"
    assert html_text.apply(spark.createDataFrame([], schema)).count() == 0
    got = html_text.apply(spark.createDataFrame([(1, "<p>a", "clash", "n"), (1, "<p>a", "clash", "n"), (None, None, None, None), (2, "", "", "")], schema))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a"), (1, "a"), (2, ""), (None, "")]

"""SentencePiece encoding and decoding: exact merges for BPE files, a max-plus parallel scan for unigram files.

A BPE file's scores are ranks of merges, not weights to be summed, so its texts are encoded as the library does: of all
neighbours that make a piece together, those of the best score are joined first, the leftmost of equals. No merge
crosses a place whose two characters stand side by side in no piece, so texts are cut there without changing any id:
into chunks that begin with spaces, encoded once a worker while remembered, and documents of PART characters or more
into parts that are encoded across tasks. A stretch without such a place (one letter repeated a million times) stays whole.

For a unigram file: the best segmentation of a text into the vocabulary's pieces, by summed score, with byte fallback for characters that
no piece covers. Cut a text anywhere: the state at the cut is how far back the last piece boundary lies (0 to K - 1,
K the longest piece), and a stretch of text acts on states as a K x K matrix of best scores. Max-plus products of
these matrices are associative, so stretches are worked out side by side, combined by a prefix scan, and traced back
independently once the states at their two ends are known. This happens on two scales: documents of more than PART
characters are exploded into parts, whose matrices are combined per document, across tasks; within a part, and
for unbroken chunks, stretches of STRETCH characters are one batch. A space can only begin a piece (or stand among
spaces), so elsewhere chunks that begin with spaces are segmented on their own, once a worker while remembered.

Scores are added in double precision; of equal sums the longer last piece wins. Other kinds of files, and BPE files with
user-defined or unused pieces or with spaces inside pieces, are refused.

Defined results: a null text is empty and has no ids; U+2581 in a text is a space; decoding gives back the text with
those replaced; repeated rows are encoded each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from . import tokens
from .common import table, text_of, written

PART, STRETCH, SHORT = 1 << 16, 256, 64
SPACE = "▁"
_U = np.uint64
_NONE = -np.inf


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Batched max-plus product."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def scan(m: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of a batch of matrices, in a logarithmic number of rounds."""
    m, step = m.copy(), 1
    while step < len(m):
        m[step:] = _product(m[:-step], m[step:])
        step *= 2
    return m


class Pieces:
    """The vocabulary, and segmentation of arrays of code points."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        m = pb.ModelProto()
        m.ParseFromString(sp.serialized_model_proto())
        kind = m.trainer_spec.model_type
        if kind not in (pb.TrainerSpec.UNIGRAM, pb.TrainerSpec.BPE):
            raise ValueError(f"{path}: neither a unigram nor a BPE file")
        self.bpe = kind == pb.TrainerSpec.BPE
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = [sp.id_to_piece(i) for i in plain]
        self.longest = max(map(len, text))
        pts = _points("".join(text))
        end = np.cumsum([len(x) for x in text])
        key = self._hash(pts, end - [len(x) for x in text], end)
        order = np.argsort(key)
        self.key, self.id = key[order], np.array(plain)[order]
        score = np.array([sp.get_score(i) for i in plain], float)
        self.score = score[order]
        self.unknown = float(score.min()) - 10
        self.id_of = dict(zip(text, plain, strict=True))
        self.merged = {x: v for x, v in zip(text, score.tolist(), strict=True) if len(x) > 1}
        self.pairs = np.unique(self._pairs(pts)[~np.isin(np.arange(1, len(pts)), end)])
        if self.bpe and (any(sp.is_unused(i) for i in range(n)) or any(q.type == pb.ModelProto.SentencePiece.USER_DEFINED for q in m.pieces) or any(SPACE in x.lstrip(SPACE) for x in text)):
            raise ValueError(f"{path}: a BPE file with user-defined or unused pieces, or spaces inside pieces")
        byte = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte = [byte[f"<0x{b:02X}>"] for b in range(256)]
        raw = [b""] * n
        for i, x in zip(plain, text, strict=True):
            raw[i] = x.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.raw, self.raw_off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    @staticmethod
    def _hash(pts: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = tk._power(len(pts) + 1)
        run = np.zeros(len(pts) + 1, np.uint64)
        np.cumsum(tk.mix(pts.astype(np.uint64) + _U(1)) * up[: len(pts)], out=run[1:])
        return tk.mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))

    @staticmethod
    def _pairs(pts: np.ndarray) -> np.ndarray:
        return pts[:-1].astype(np.uint64) << _U(32) | pts[1:].astype(np.uint64)

    def cuts(self, pts: np.ndarray) -> np.ndarray:
        """Places that no merge crosses."""
        pair = self._pairs(pts)
        i = np.searchsorted(self.pairs, pair)
        i[i == len(self.pairs)] = 0
        return np.flatnonzero(self.pairs[i] != pair) + 1

    def parts(self, text: str, size: int) -> Iterator[str]:
        """text, with spaces as SPACE, cut at the first of these places after each `size` characters."""
        begin = 0
        while begin < len(text):
            end = at = begin + size
            while at < len(text):
                if len(found := self.cuts(_points(text[at - 1 : at + 4096]))):
                    end = at - 1 + int(found[0])
                    break
                at += 4096
            else:
                end = len(text)
            yield text[begin:end]
            begin = end

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by a BPE file."""
        if len(chunk) > SHORT:
            cut = [0, *self.cuts(_points(chunk)).tolist(), len(chunk)]
            symbols = [x for a, b in zip(cut, cut[1:], strict=False) for x in (self._join_long if b - a > SHORT else self._join)(chunk[a:b])]
        else:
            symbols = self._join(chunk)
        out: list[int] = []
        for x in symbols:
            i = self.id_of.get(x)
            if i is None:
                out += [self.byte[b] for b in x.encode()]
            else:
                out.append(i)
        return out

    def _join(self, text: str) -> list[str]:
        sym, get = list(text), self.merged.get
        value = [get(a + b, _NONE) for a, b in zip(sym, sym[1:], strict=False)]
        while value and (top := max(value)) != _NONE:
            i = value.index(top)
            sym[i] += sym.pop(i + 1)
            del value[i]
            if i:
                value[i - 1] = get(sym[i - 1] + sym[i], _NONE)
            if i < len(value):
                value[i] = get(sym[i] + sym[i + 1], _NONE)
        return sym

    def _join_long(self, text: str) -> list[str]:
        """As _join, in n log n."""
        sym: list[str | None] = list(text)
        n, before, after = len(sym), list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (v := self.merged.get(both := sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-v, i, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue  # one of the two has been joined since
            sym[i], sym[j] = sym[i] + sym[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in sym if x is not None]

    def spans(self, pts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(K, n) scores and ids of the pieces of each length that end at each point; first: where each point's sequence begins."""
        k, n = self.longest, len(pts)
        score, ids = np.full((k, n), _NONE), np.full((k, n), -1, np.int32)
        up, down = tk._power(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(tk.mix(pts.astype(np.uint64) + _U(1)) * up[:n], out=run[1:])
        at = np.arange(n)
        for length in range(1, k + 1):
            end = at[at - length + 1 >= first]
            begin = end - length + 1
            h = tk.mix((run[end + 1] - run[begin]) * down[begin] + _U(length))
            i = np.searchsorted(self.key, h)
            i[i == len(self.key)] = 0
            hit = self.key[i] == h
            score[length - 1, end[hit]] = self.score[i[hit]]
            ids[length - 1, end[hit]] = self.id[i[hit]]
        bare = ids[0] < 0
        score[0, bare] = self.unknown
        return score, ids

    def _emit(self, pts: np.ndarray, ids: np.ndarray, end: int, lengths: list[int]) -> list[int]:
        out: list[int] = []
        for length in lengths:  # last piece first
            i = int(ids[length - 1, end])
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte[b] for b in reversed(chr(int(pts[end])).encode())]
            end -= length
        return out[::-1]

    def short(self, chunks: list[np.ndarray]) -> list[list[int]]:
        """Segments chunks side by side, one position after another."""
        size = np.array([len(c) for c in chunks])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        pts = np.concatenate([chunks[i] for i in order])
        off = np.cumsum(size) - size
        score, ids = self.spans(pts, np.repeat(off, size))
        best = np.full((len(chunks), int(size[0]) + 1), _NONE)
        best[:, 0] = 0
        took = np.zeros((len(chunks), int(size[0]) + 1), np.int8)
        for j in range(1, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -j, "right"))
            top, arg = np.full(n, _NONE), np.zeros(n, np.int8)
            for length in range(min(self.longest, j), 0, -1):
                v = best[:n, j - length] + score[length - 1, off[:n] + j - 1]
                up = v > top
                top[up], arg[up] = v[up], length
            best[:n, j], took[:n, j] = top, arg
        out: list[list[int]] = [[]] * len(chunks)
        for c, i in enumerate(order.tolist()):
            j, lengths = int(size[c]), []
            while j:
                lengths.append(int(took[c, j]))
                j -= lengths[-1]
            out[i] = self._emit(pts, ids, int(off[c] + size[c]) - 1, lengths)
        return out

    def _stretches(self, pts: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of pts[lead:]: their edges, matrices, best scores and last lengths by in-state, and the ids of spans. lead: points before, for context."""
        k = self.longest
        score, ids = self.spans(pts, np.zeros(len(pts), np.int64))
        n = len(pts) - lead
        edge = lead + np.append(np.arange(0, max(n - k + 1, 1), STRETCH), n)
        edge = np.delete(edge, -2) if len(edge) > 2 and edge[-1] - edge[-2] < k else edge
        count, longest = len(edge) - 1, int(np.diff(edge).max())
        best = np.full((count, k, k - 1 + longest + 1), _NONE)  # node at edge + x is at index x + k - 1
        back = np.arange(k)
        for i in range(count):
            ok = back <= edge[i]
            best[i, back[ok], k - 1 - back[ok]] = 0
        took = np.zeros((count, k, longest + 1), np.int8)
        for j in range(1, longest + 1):
            live = np.flatnonzero(edge[:-1] + j <= edge[1:])
            end = edge[:-1][live] + j - 1
            top, arg = np.full((len(live), k), _NONE), np.zeros((len(live), k), np.int8)
            for length in range(k, 0, -1):
                v = best[live, :, j - length + k - 1] + score[length - 1, end][:, None]
                up = v > top
                top[up], arg[up] = v[up], length
            best[live, :, j + k - 1], took[live, :, j] = top, arg
        m = np.empty((count, k, k))
        for i in range(count):
            m[i] = best[i][:, int(edge[i + 1] - edge[i]) + k - 1 - back]
            # a boundary before the stretch is not one inside it, unless the stretch is shorter than the piece
        return edge, m, took, ids, best

    def matrix(self, pts: np.ndarray, lead: int) -> np.ndarray:
        return scan(self._stretches(pts, lead)[1])[-1]

    def trace(self, pts: np.ndarray, lead: int, b_in: int, b_out: int) -> list[int]:
        """Ids of the pieces that end in pts[lead:], given the states at both ends."""
        edge, m, took, ids, _ = self._stretches(pts, lead)
        before = scan(m)[:, b_in]  # best score from the first state to each state after each stretch
        state = [b_out]
        for i in range(len(m) - 1, 0, -1):
            state.append(int((before[i - 1] + m[i][:, state[-1]]).argmax()))
        state = [b_in, *state[::-1]]
        out: list[int] = []
        for i in range(len(m)):
            j, lengths = int(edge[i + 1] - edge[i]) - state[i + 1], []
            while j > 0:
                lengths.append(int(took[i, state[i], j]))
                j -= lengths[-1]
            if lengths:
                out += self._emit(pts, ids, int(edge[i + 1]) - state[i + 1] - 1, lengths)
        return out

    def segment(self, chunks: list[str]) -> list[list[int]]:
        pts = [_points(c) for c in chunks]
        out: list[list[int]] = [[]] * len(pts)
        small = [i for i, p in enumerate(pts) if 0 < len(p) <= SHORT]
        for i, ids in zip(small, self.short([pts[i] for i in small]) if small else [], strict=True):
            out[i] = ids
        for i, p in enumerate(pts):
            if len(p) > SHORT:
                out[i] = self.trace(p, 0, 0, 0)
        return out

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        """The text of ids; of a document's first ids, without the leading space that encoding puts there."""
        n = self.raw_off[ids + 1] - self.raw_off[ids]
        run = np.cumsum(n) - n
        out = self.raw[np.repeat(self.raw_off[ids] - run, n) + np.arange(int(n.sum()))].tobytes()
        return out[1:] if first and out[:1] == b" " else out


class Encoder(tokens.Encoder):
    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self._reset()

    def chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        some = np.diff(off) > 0
        first = off[:-1] + np.cumsum(some) - some
        data = np.insert(data, off[:-1][some], 32)
        edge = np.zeros(len(data), bool)
        edge[1:] = (data[1:] == 32) & (data[:-1] != 32)
        edge[first[some]] = True
        start = np.flatnonzero(edge)
        row = np.searchsorted(first[some], start, "right") - 1
        return data, start, np.append(start[1:], len(data))[: len(start)], np.flatnonzero(some)[row] if len(start) else row

    def ids_of(self, chunks: list[str]) -> list:
        chunks = [c.replace(" ", SPACE) for c in chunks]
        return [self.pieces.merge(c) for c in chunks] if self.pieces.bpe else self.pieces.segment(chunks)

    def part(self, text: str) -> list[int]:
        """Ids of a part of a document by a BPE file, spaces as SPACE; no space is added."""
        chunks = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)
        known = {c: self.pieces.merge(c) for c in set(chunks)}
        return [i for c in chunks for i in known[c]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part, ids, text: ids of a document in order of part (one part but for giants), and the text that they cover."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                texts = pc.replace_substring(p.column(1), SPACE, " ")
                ids = [pa.array(x, pa.int32()) for x in enc.plain(texts)]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(np.zeros(p.num_rows, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), flat), p.column(1)], names=["doc_id", "part", "ids", "text"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    small = rows.filter(F.length("text") < PART).mapInArrow(plain, "doc_id long, part int, ids array<int>, text string")
    big = rows.filter(F.length("text") >= PART).withColumn("g", F.xxhash64("doc_id", "text"))
    if encoder(path).pieces.bpe:
        return small.unionAll(_merged(big, path, PART))
    k = encoder(path).pieces.longest
    giant = big.withColumns({"parts": F.ceil((F.length("text") + 1) / PART).cast("int")})
    parts = giant.withColumn("whole", F.concat(F.lit(" "), "text")).select("g", "doc_id", "parts", "whole", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    start = F.col("part") * PART
    lead = F.when(F.col("part") > 0, k).otherwise(0)
    # a last part shorter than a piece would hide the state before it, so it joins its neighbour
    size = F.length("whole")
    last = F.when((F.col("parts") > 1) & (size - (F.col("parts") - 1) * PART < 2 * k), F.col("parts") - 2).otherwise(F.col("parts") - 1)
    parts = parts.withColumn("last", last).filter("part <= last")
    parts = parts.select("g", "doc_id", "part", "last", lead.alias("lead"), F.substr("whole", start - lead + 1, F.when(F.col("part") == F.col("last"), size).otherwise(F.lit(PART)) + lead).alias("text"))
    parts = written(parts.repartition("g", "part"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for b in batches:
            g, part, lead_, text = (b.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pieces.matrix(_points(t.replace(" ", SPACE)), n).tobytes() for t, n in zip(text, lead_, strict=True)], pa.binary())], names=["g", "part", "m"])

    def states(t: pa.Table) -> pa.Table:
        """One document's matrices -> the states at both ends of each part."""
        t = t.sort_by("part")
        m = np.stack([np.frombuffer(x, float).reshape(k, k) for x in t.column("m").to_pylist()])
        before = scan(m)[:, 0]
        state = [0]
        for i in range(len(m) - 1, 0, -1):
            state.append(int((before[i - 1] + m[i][:, state[-1]]).argmax()))
        state = [0, *state[::-1]]
        return pa.table({"g": t.column("g"), "part": t.column("part"), "b_in": pa.array(state[:-1], pa.int32()), "b_out": pa.array(state[1:], pa.int32())})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for b in batches:
            _, part, lead_, text, b_in, b_out = (b.column(i).to_pylist() for i in range(6))
            ids = [pieces.trace(_points(t.replace(" ", SPACE)), n, x, y) for t, n, x, y in zip(text, lead_, b_in, b_out, strict=True)]
            # pieces that reach over a part's ends: b_in characters before it, b_out before its end; part 0 begins with the added space
            covered = [t[1 if k == 0 else n - x : len(t) - y] for k, t, n, x, y in zip(part, text, lead_, b_in, b_out, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(covered)], names=["doc_id", "part", "ids", "text"])

    found = parts.select("g", "part", "lead", "text").dropDuplicates(["g", "part"]).mapInArrow(matrices, "g long, part int, m binary").groupBy("g").applyInArrow(states, "g long, part int, b_in int, b_out int")
    large = parts.join(written(found), ["g", "part"]).select("doc_id", "part", "lead", "text", "b_in", "b_out").mapInArrow(traced, "doc_id long, part int, ids array<int>, text string")
    return small.unionAll(large)


def _merged(big: DataFrame, path: str, size: int) -> DataFrame:
    """Giant documents by a BPE file."""

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for b in batches:
            for i in range(b.num_rows):
                whole = SPACE + b.column(1)[i].as_py().replace(" ", SPACE)
                for part, text in enumerate(pieces.parts(whole, size)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([part], pa.int32()), pa.array([text]), b.column(2).slice(i, 1)], names=["doc_id", "part", "text", "g"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for i in range(b.num_rows):
                part, text = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                ids = pa.array([enc.part(text)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), ids, pa.array([text[part == 0 :]])], names=["doc_id", "part", "ids", "text"])

    parts = big.select("doc_id", "text", "g").mapInArrow(parted, "doc_id long, part int, text string, g long")
    return parts.repartition("g", "part").mapInArrow(merged, "doc_id long, part int, ids array<int>, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, part, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded (the ids give back the part's text)."""
    path = model_path()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            part = b.column(1).to_pylist()
            ids_all = b.column(2)
            off, flat = ids_all.offsets.to_numpy(), ids_all.values.to_numpy()
            for i, text in enumerate(b.column(3).to_pylist()):
                ids = flat[off[i] : off[i + 1]]
                out[0].append(len(ids))
                out[1].append(zlib.crc32(ids.astype("<u4").tobytes()))
                raw = pieces.decode(ids, not part[i]) if len(ids) else b""
                want = text.replace(SPACE, " ").encode()
                out[2].append(raw == want)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["doc_id", "part", "n_ids", "ids_crc32", "decoded"])

    return encode(table(spark, sf_dir, "documents"), path).mapInArrow(digest, "doc_id long, part int, n_ids long, ids_crc32 long, decoded boolean")

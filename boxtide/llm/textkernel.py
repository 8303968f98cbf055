"""Words and word shingles of Arrow text columns as 64-bit hashes, computed on whole blocks of bytes with NumPy.

A word's hash is a polynomial over its bytes (mod 2**64, from one running sum over the block), mixed; a shingle's
is a mixed linear form of its words' hashes. Blocks hold whole texts of about BLOCK bytes, so that working arrays
stay small however large a batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(2**40, 2**62)) * 8 + 5
_BACK = pow(_BASE, -1, 2**64)
_WEIGHT = _rng.integers(1, 2**63, 5, dtype=np.uint64) * U(2) + U(1)
_LENGTH = _rng.integers(1, 2**63, 6, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


#: Bytes between runs of letters (bytes of other alphabets count as letters), and between lines.
NO_LETTER, NEWLINE = np.ones(256, bool), np.zeros(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False
NEWLINE[10] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + (1 << 17))
        _powers[:] = []
        for base in (_BASE, _BACK):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of each block; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a block. gaps: which bytes part words."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    space = gaps[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    first = off[:-1]
    before[first[first < len(data)]] = True
    last = off[1:]
    after[last[last > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the given spans of a block."""
    up, down = _power(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data] if lower else data] * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each five-word shingle; a row with one to four words has one, of all its words. Rows ascend."""
    per = np.bincount(row, minlength=n_rows)
    first = np.cumsum(per) - per
    out_row, out = [], []
    if len(h) >= 5:
        ok = np.flatnonzero(row[4:] == row[:-4])
        s = np.full(len(ok), _LENGTH[5], np.uint64)
        for j in range(5):
            s += h[ok + j] * _WEIGHT[j]
        out_row.append(row[ok])
        out.append(s)
    for n in range(1, 5):
        rows = np.flatnonzero(per == n)
        s = np.full(len(rows), _LENGTH[n], np.uint64)
        for j in range(n):
            s += h[first[rows] + j] * _WEIGHT[j]
        out_row.append(rows)
        out.append(s)
    r, s = np.concatenate(out_row), mix(np.concatenate(out))
    order = np.argsort(r, kind="stable")
    return r[order], s[order]


def distinct(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row: row, hash, row offsets."""
    edge = np.searchsorted(row, np.arange(n_rows + 1))
    h = h.copy()
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[keep], h[keep]
    return row, h, np.searchsorted(row, np.arange(n_rows + 1))


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, hash, row offsets) with the sorted distinct shingle hashes of lower-cased texts."""
    for a, b, data, off in blocks(texts):
        start, end, row = words(data, off)
        r, s = shingles(hashes(data, start, end, lower=True), row, b - a)
        yield (a, b, *distinct(r, s, b - a))

"""Dense statistics of whole texts, computed on blocks of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textkernel as tk

NAMES = [
    "log_words", "mean_word", "caps", "punctuation", "bangs", "symbols", "pipes", "digits", "obfuscated", "distinct_words", "repeated_triples", "log_line", "repeated_lines", "wide_bytes", "top_word",
]


def _flags(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for s in chars for c in s]] = True
    return out


_CAPS, _PUNCT, _BANG = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags(".,;:!?'\"()-"), _flags("!?")
_SYMBOL, _PIPE, _DIGIT, _MASK = _flags("#*$%&<>@^~_=+"), _flags("|"), _flags("0123456789"), _flags("0123456789@$*!#")


def _sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=run[1:])
    return (run[off[1:]] - run[off[:-1]]).astype(float)


def block_stats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, features) of a block; an empty text has zeros."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    start, end, row = tk.words(data, off)
    per = np.bincount(row, minlength=n).astype(float)
    some = np.maximum(per, 1)
    letters = np.bincount(row, weights=end - start, minlength=n)
    size = np.maximum(letters, 1)
    h = tk.hashes(data, start, end, lower=True)
    _, _, woff = tk.distinct(row, h, n)
    # the most frequent word's share, from runs of equal hashes within each row
    sorted_h = h.copy()
    edge = np.searchsorted(row, np.arange(n + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        sorted_h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    top = np.zeros(n)
    if len(first):
        np.maximum.at(top, row[first], np.diff(np.append(first, len(h))))
    triple = np.flatnonzero(row[2:] == row[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    th = h[triple] * np.uint64(0x9E3779B97F4A7C15) + h[triple + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[triple + 2] if len(triple) else h[:0])
    _, _, toff = tk.distinct(row[triple], th, n)
    n_triple = np.bincount(row[triple], minlength=n)
    ls, le, lrow = tk.words(data, off, tk.NEWLINE)
    lines = np.bincount(lrow, minlength=n)
    _, _, loff = tk.distinct(lrow, tk.hashes(data, ls, le), n)
    letter = ~tk.NO_LETTER[data]
    between = np.zeros(len(data), bool)
    between[1:-1] = _MASK[data[1:-1]] & letter[:-2] & letter[2:]
    cols = [
        np.log1p(per), letters / some, _sums(_CAPS[data], off) / size, _sums(_PUNCT[data], off) / size, _sums(_BANG[data], off) / some, _sums(_SYMBOL[data], off) / size, _sums(_PIPE[data], off) / some,
        _sums(_DIGIT[data], off) / size, _sums(between, off) / some, np.diff(woff) / some, 1 - np.diff(toff) / np.maximum(n_triple, 1), np.log1p(letters / np.maximum(lines, 1)),
        1 - np.diff(loff) / np.maximum(lines, 1), _sums(data >= 0xC0, off) / size, top / some,
    ]
    for k, c in enumerate(cols):
        out[:, k] = np.where(per > 0, c, 0)
    return out


def stats(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(NAMES))), *[block_stats(data, off) for _, _, data, off in tk.blocks(texts)]])

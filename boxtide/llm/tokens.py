"""Token ids of texts by a word-level BPE file, encoding each distinct unit once a worker.

This holds for tokenizers that lower-case, map white space to itself and part words where white space, or an ASCII
letter and another ASCII character, meet (but for an apostrophe and the letters of a contraction after it): then the
ids of a text are those of its units, one after another. Texts with the opening of a special token are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkernel as tk

MEMO = 600_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_OTHER = np.zeros(256, bool)
_OTHER[33:127] = ~_LETTER[33:127]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_APOSTROPHE = 39


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[int, int] = {}
        self.n, self.used = 0, 0
        self.off, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and start, end and row of the parts that are encoded on their own."""
        data = tk.LOWER[data]
        if not len(data):
            return (data, *tk.words(data, off))
        letter, other, full = _LETTER[data], _OTHER[data], ~_BLANK[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = (letter[:-1] & other[1:]) | (other[:-1] & (data[:-1] != _APOSTROPHE) & letter[1:]) | (~full[:-1] & full[1:])
        begin[off] = True
        finish = begin.copy()
        finish[1:-1] |= full[:-1] & ~full[1:]
        start, end = np.flatnonzero(begin[:-1] & full), np.flatnonzero(finish[1:] & full) + 1
        return data, start, end, np.searchsorted(off, start, "right") - 1

    def ids_of(self, chunks: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, keys: list[int], chunks: list[str]) -> None:
        for key, ids in zip(keys, self.ids_of(chunks), strict=True):
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            if self.n + 2 > len(self.off):
                self.off = np.concatenate([self.off, np.zeros_like(self.off)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.slot[key] = self.n
            self.n += 1
            self.off[self.n] = self.used

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        if not pc.any(special).as_py():
            yield from self.plain(texts)
            return
        rest = self.plain(pc.if_else(special, "", texts))
        for odd, text, ids in zip(special.to_pylist(), texts.to_pylist(), rest, strict=True):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32) if odd else ids

    def plain(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for a, b, data, off in tk.blocks(texts):
            if self.n > MEMO:
                self._reset()
            data, start, end, row = self.chunks(data, off)
            uniq, first, back = np.unique(tk.hashes(data, start, end), return_index=True, return_inverse=True)
            keys = uniq.tolist()
            slots = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
            for k in range(0, len(miss := np.flatnonzero(slots < 0)), 8192):
                part = miss[k : k + 8192]
                self._learn([keys[i] for i in part.tolist()], [data[start[w] : end[w]].tobytes().decode() for w in first[part].tolist()])
            if len(miss):
                slots = np.fromiter(map(self.slot.get, keys), np.int64, len(keys))
            word = slots[back]
            n = self.off[word + 1] - self.off[word]
            run = np.zeros(len(word) + 1, np.int64)
            np.cumsum(n, out=run[1:])
            flat = self.ids[np.repeat(self.off[word] - run[:-1], n) + np.arange(run[-1])]
            edge = run[np.searchsorted(row, np.arange(b - a + 1))]
            for r in range(b - a):
                yield flat[edge[r] : edge[r + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Sentences of a text as bags of hashed features, for a whole batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from loomdex.llm.text import _IS_SPACE, _OF_BYTE, mix, run_hashes, text_bytes

#: Lengths in bytes of the word beginnings that are features beside the whole word.
STEMS = (3, 4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
#: Bytes at either end of a word that don't belong to it.
_TRIM = np.zeros(256, bool)
_TRIM[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
FILTER_BITS = 20


class Features:
    """Sorted feature hashes; ``find`` gives the index of each hash or -1, most misses by one bit look-up."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self._bits(hashes)] = True

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.seen[self._bits(h)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out


def sentence_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence starts (byte positions), each row's bounds among the sentences, and for every feature its sentence and hash.

    Sentences end behind runs of ``.!?`` and newlines; a row has one at least.  Features are the words without
    punctuation at their ends, and their beginnings.
    """
    data, bounds = text_bytes(column)
    n = len(data)
    ends = _ENDS[data]
    last = ends.copy()
    last[:-1] &= ~ends[1:]
    inner = np.flatnonzero(last) + 1
    heads = np.unique(np.concatenate([inner[inner < n], bounds[:-1][bounds[:-1] < n]])).astype(np.int64)
    # rows without bytes have no head of their own; they get an empty sentence at their place
    empty = bounds[:-1][bounds[:-1] == bounds[1:]]
    starts = np.sort(np.concatenate([heads, empty]))
    counts = np.searchsorted(heads, bounds)
    rows = counts + np.concatenate([[0], np.cumsum(bounds[:-1] == bounds[1:])])
    inside = ~(_IS_SPACE | _TRIM)[data]
    first, close = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    close[:-1] &= ~inside[1:]
    edge = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)]
    first[edge], close[edge - 1] = inside[edge], inside[edge - 1]
    a, b = np.flatnonzero(first).astype(np.int64), np.flatnonzero(close).astype(np.int64) + 1
    where = np.searchsorted(heads, a, side="right") - 1
    # from the number among heads to the number among all sentences
    before = np.concatenate([[0], np.cumsum(bounds[:-1] == bounds[1:])])
    row_of = np.searchsorted(bounds, heads, side="right") - 1
    where = where + before[row_of[where]] if len(where) else where
    values = _OF_BYTE[data]
    hashes, whose = [run_hashes(values, a, b)], [where]
    for length in STEMS:
        long = b - a > length
        hashes.append(mix(run_hashes(values, a[long], a[long] + length) + np.uint64(length)))
        whose.append(where[long])
    return starts, rows, np.concatenate(whose), np.concatenate(hashes)

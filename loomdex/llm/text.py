"""Word, shingle and tokenizer helpers that run inside Python workers, vectorised over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes of text that are looked at together; only a single longer text goes over it.
SLICE_BYTES = 2 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = np.uint64(0x9E3779B97F4A7C15)
_S33, _S29 = np.uint64(33), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S33)


#: White space of word lists: space and the controls from tab to carriage return.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random value for each byte, the same for A-Z as for a-z.
_OF_BYTE = mix(np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + _P)
_powers = np.array([1], np.uint64)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``values[start:end]``: a polynomial in an odd base, finalised with the length.

    The runs are in order and don't overlap; ``values`` are random 64-bit images of the symbols.
    """
    global _powers
    lens = ends - starts
    if not len(lens):
        return np.empty(0, np.uint64)
    if (longest := int(lens.max())) > len(_powers):
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(longest, 64), _P)]), dtype=np.uint64)
    ahead = np.concatenate([[0], np.cumsum(lens)[:-1]])
    at = np.arange(int(lens.sum())) - np.repeat(ahead, lens)
    picked = values if len(at) == len(values) else values[at + np.repeat(starts, lens)]
    return mix(np.add.reduceat(picked * _powers[at], ahead) + lens.astype(np.uint64))


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch again, cut where a slice's ``column`` would pass ``most`` bytes (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end what the worker freed goes back to the system, as workers live on, idle, beside other tasks."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and each row's bounds in it; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z as a-z) of all rows, and each row's bounds among them."""
    data, bounds = text_bytes(column)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds[1:][bounds[1:] > 0] - 1] = inside[bounds[1:][bounds[1:] > 0] - 1]
    starts = np.flatnonzero(first)
    return run_hashes(_OF_BYTE[data], starts, np.flatnonzero(last) + 1), np.searchsorted(starts, bounds)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words are one shingle, no words none."""
    hashes, bounds = words(column)
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        h = hashes[i:j]
        if len(h):
            width = min(k, len(h))
            acc = h[: len(h) - width + 1]
            for d in range(1, width):
                acc = acc * _P + h[d : len(h) - width + 1 + d]
            h = np.sort(mix(acc + np.uint64(width)))
            h = h[np.concatenate([[True], h[1:] != h[:-1]])]
        yield h


_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: The White_Space property of Unicode.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_UNICODE = 0x110000


def _kinds_of(library: Tokenizer) -> np.ndarray:
    """The kind of every code point as the library's pre-tokeniser sees it; its Unicode may be newer than Python's.

    It splits the code points in order where kinds change, and the first of each piece is tried behind a letter and a mark.
    """
    split = library.pre_tokenizer.pre_tokenize_str
    kinds, spaces = np.full(_UNICODE, _OTHER, np.uint8), set(WHITE_SPACE)
    for low in range(0, _UNICODE, 0x10000):
        own = [c for c in range(low, low + 0x10000) if c not in spaces and not 0xD800 <= c < 0xE000]
        for _, (i, j) in split("".join(map(chr, own))):
            first = chr(own[i])
            kinds[own[i:j]] = _LETTER if len(split("a" + first)) == 1 else _OTHER if len(split("!" + first)) == 1 else _NUMBER
    kinds[WHITE_SPACE] = _SPACE
    return kinds


@cache
def _unassigned() -> np.ndarray:
    """Whether Python knows nothing about a code point, neither its small letter nor its composition."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(_UNICODE)])


class _Table:
    """Hash -> (start, length) in a pool of ids, by open addressing.

    A pre-token is known by its 64-bit hash alone: two different ones with one hash would share the first one's ids.  Among the
    2 ** 19 that the table holds at most the chance of that is below 1e-8.
    """

    def __init__(self, bits: int = 20):
        self.keys, self.slots, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1)
        self.pool, self.used, self.n = np.empty(1 << 20, np.uint16), 0, 0
        self.starts, self.lens = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)

    def full(self, more: int) -> bool:
        return 2 * (self.n + more) > len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.slots[slot[hit]]
            on = ~hit & (k != 0)
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """Distinct new hashes and their ids."""
        lens = np.array([len(x) for x in ids], np.int32)
        flat = np.array([x for own in ids for x in own], np.uint16)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        entry = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[entry], self.lens[entry] = self.used + np.cumsum(lens) - lens, lens
        self.used, self.n = self.used + len(flat), self.n + len(h)
        left, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            won = self.keys[slot] == h[left]
            self.slots[slot[won]] = entry[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & int(self.mask)


class Tokens:
    """A tokenizers file with a table of pre-tokens.

    Strings of special tokens in a text are ordinary text (``encode_special_tokens``, as the vocabularies' description says), so
    no text can forge a document's end.

    The pre-tokeniser's split is computed over whole batches; each distinct pre-token is encoded by the
    library once per worker (the table is bounded and starts anew when it is half full) and the ids of a
    text are those of its pre-tokens in turn.  ``spaced`` tells the two kinds of file apart: byte-level
    (a space joins the run that follows) and word-level (lower case, white space dropped, single digits).
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.spaced, self.table, self.kinds = spaced, _Table(), _kinds_of(self.library)
        if self.library.get_vocab_size() > 65_536:
            raise ValueError("ids are kept as unsigned 16-bit integers")

    def _split(self, cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of all rows."""
        n, kind = len(cps), self.kinds[cps]
        head = np.zeros(n + 1, bool)
        head[bounds] = True
        cut = head.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        if self.spaced:
            i = np.flatnonzero(cut[1:n] & ~head[1:n] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
            cut[i - 1] = True
            cut[i[cps[i - 1] == 32]] = False
        else:
            cut[:n] |= kind == _NUMBER
        # 's 't 'm 'd 're 've 'll, where the apostrophe begins a pre-token
        i = np.flatnonzero((cps == 39) & cut[:n])
        i = i[i + 1 < n]
        i = i[(kind[i + 1] == _LETTER) & ~head[i + 1]]
        a, j = cps[i + 1], np.minimum(i + 2, n - 1)
        b = np.where((i + 2 < n) & ~head[i + 2 - (i + 2 > n)], cps[j], 0)
        one, two = np.isin(a, [ord(c) for c in "stmd"]), np.isin(a * 0x110000 + b, [ord(x) * 0x110000 + ord(y) for x, y in ("re", "ve", "ll")])
        i, k = i[one | two], np.where(one, 1, 2)[one | two]
        cut[i + 1] = False
        cut[i + 1 + k] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        if not self.spaced and n:
            kept = kind[starts] != _SPACE
            starts, ends = starts[kept], ends[kept]
        return starts, ends

    def _entries(self, text: str, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        entry = self.table.find(h)
        if (new := np.flatnonzero(entry < 0)).size:
            distinct, first = np.unique(h[new], return_index=True)
            if self.table.full(len(distinct)):
                bits = max(20, int(2 * len(h)).bit_length() + 1)
                self.table = _Table(bits)
                distinct, new = np.unique(h, return_index=True)
            else:
                new = new[first]
            pieces, ids = [text[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], []
            collecting = gc.isenabled()
            gc.disable()  # encodings hold no cycles, but their number sets the collector off
            try:
                for i in range(0, len(pieces), 4096):
                    ids += [e.ids for e in self.library.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
            finally:
                if collecting:
                    gc.enable()
            self.table.add(distinct, ids)
            entry = self.table.find(h)
        return entry

    @staticmethod
    def _beyond(texts: list[str]) -> set[int]:
        """The texts with code points that are unassigned in Python."""
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(_unassigned()[cps])
        return set((np.searchsorted(np.cumsum([len(t) for t in texts]), at, side="right")).tolist()) if len(at) else set()

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 16-bit ids of every text; null counts as empty.  A part of the tokens is looked at together."""
        own = [t or "" for t in texts]
        if not self.spaced:
            new = self._beyond(own)
            own = [self.library.normalizer.normalize_str(t) if i in new else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for i, t in enumerate(own)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
        text = "".join(own)
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = self._split(cps.astype(np.int64), bounds) if len(cps) else (bounds[:0], bounds[:0])
        h = run_hashes(mix(cps.astype(np.uint64) + _P), starts, ends)
        h[h == 0] = 1
        entry = self._entries(text, h, starts, ends)
        lens = self.table.lens[entry].astype(np.int64)
        ends_at = np.cumsum(lens)
        total = int(ends_at[-1]) if len(lens) else 0
        ids = self.table.pool[np.arange(total) + np.repeat(self.table.starts[entry] - (ends_at - lens), lens)]
        of_row = np.concatenate([[0], ends_at])[np.searchsorted(starts, bounds)]
        return [ids[i:j] for i, j in zip(of_row[:-1], of_row[1:], strict=True)]


_loaded: dict[tuple[str, bool], Tokens] = {}


def tokens(path: str, spaced: bool) -> Tokens:
    """One ``Tokens`` a worker and file."""
    if (path, spaced) not in _loaded:
        _loaded[path, spaced] = Tokens(path, spaced)
    return _loaded[path, spaced]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)

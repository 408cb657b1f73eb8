"""Byte-level BPE by a ranks file: encoding each pre-token with a segment tree, and decoding.

The tree stands over a pre-token's byte positions.  A leaf holds the rank of the pair that begins at its position, or nothing where no live
part begins or its pair has no rank; an inner node holds the least of its two, and of equal ranks the leftmost.  So the root names
the next merge, and a merge updates three leaves: the merged part's, the part's that it swallowed, and its left neighbour's.
A pre-token of n bytes takes n log n steps however long it is.  Short ones, which are nearly all, have their trees in the rows of one matrix and
are merged side by side; longer ones each have a tree of their own.

Pre-tokens are split over whole batches, as for the other vocabularies, but by the letters, numbers and spaces of the ranks' own library, which are asked from
it.  A worker merges each distinct pre-token once; its table is bounded and starts anew when half full.

Defined cases: a null or empty text has no ids, and they decode to nothing; strings of special tokens are ordinary text; a text of any
length is taken whole; repeated rows are encoded each; ids that the ranks don't know, and nulls among ids, raise ValueError at decoding; columns not
named in ``keep`` are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomdex.llm.text import _LETTER, _NUMBER, _OTHER, _SPACE, _UNICODE, Tokens, _Table, sliced, trimmed

_NOTHING, _AT = 2**62, 2**32 - 1
#: Ids that are decoded together; only a single longer row goes over it.
SLICE_IDS = 1 << 20
#: Bytes of a pre-token that is merged side by side with others, and trees that are looked at together.
SHORT, TREES = 65, 4096


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: itself if it has a rank, else its bytes after all merges, least rank first, leftmost of equal ones."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    size = 1 << max(0, n - 2).bit_length()
    tree = array("q", [_NOTHING]) * (2 * size)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[size + i] = rank << 32 | i
    for j in range(size - 1, 0, -1):
        tree[j] = min(tree[2 * j], tree[2 * j + 1])
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # of the live parts, by their first byte

    def put(i: int, end: int | None) -> None:
        """The pair that begins at ``i`` now ends at ``end``, or is none."""
        rank = None if end is None else get(piece[i:end])
        j, value = size + i, _NOTHING if rank is None else rank << 32 | i
        while j and tree[j] != value:
            tree[j] = value
            a, b = tree[j], tree[j ^ 1]
            j >>= 1
            value = a if a < b else b

    while (least := tree[1]) != _NOTHING:
        i = least & _AT
        gone = after[i]
        end = after[i] = after[gone]
        if gone < n - 1:
            put(gone, None)
        if end < n:
            before[end] = i
            put(i, after[end])
        else:
            put(i, None)
        if (left := before[i]) >= 0:
            put(left, end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file of base64 and number a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("every byte must have a rank")
    if max(ranks.values()) > 65_535:
        raise ValueError("ids are kept as unsigned 16-bit integers")
    return ranks


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point as tiktoken's expressions see it: what a pattern doesn't match, it leaves out."""
    import tiktoken

    points = [c for c in range(_UNICODE) if not 0xD800 <= c < 0xE000]
    text, own = "".join(map(chr, points)), {bytes([b]): b for b in range(256)}
    kinds = np.full(_UNICODE, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        found = tiktoken.Encoding("kind", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        kinds[[ord(c) for c in found.decode(found.encode_ordinary(text))]] = kind
    return kinds


class Pairs:
    """The rank of two neighbouring tokens' bytes, for arrays of them; -1 stands for no token."""

    def __init__(self, ranks: dict[bytes, int]):
        of = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    of[a << 16 | b] = rank
        self.keys = np.array(sorted(of), np.int64)
        self.ranks = np.array([of[k] for k in self.keys.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What leaves hold of the pairs (a, b) that begin at ``at``."""
        if not len(self.keys):
            return np.full(len(a), _NOTHING)
        key = a << 16 | b
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & (a >= 0) & (b >= 0), self.ranks[found] << 32 | at, _NOTHING)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """``merged`` of pieces without a rank of their own, of 2 to ``SHORT`` bytes, all of whose trees have the same size."""
        lens = np.array([len(p) for p in pieces])
        size = 1 << max(0, int(lens.max()) - 2).bit_length()
        n, wide = len(pieces), size + 2
        ids = np.full((n, wide), -1, np.int64)
        ids[np.arange(wide) < lens[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((n, 2 * size), _NOTHING)
        at = np.broadcast_to(np.arange(size), (n, size))
        tree[:, size:] = self.leaves(ids[:, :size].ravel(), ids[:, 1 : size + 1].ravel(), at.ravel()).reshape(n, size)
        low = size
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        after = np.tile(np.arange(1, wide + 1), (n, 1)).ravel()
        before = np.tile(np.arange(-1, wide - 1), (n, 1)).ravel()
        flat, part = tree.ravel(), ids.ravel()
        live = np.flatnonzero(tree[:, 1] != _NOTHING)
        while len(live):
            row, top = live * wide, live * 2 * size
            least = flat[top + 1]
            i = least & _AT
            gone = after[row + i]
            end = after[row + gone]
            after[row + i] = end
            before[row + end] = i
            part[row + i] = least >> 32
            part[row + gone] = -1
            left = before[row + i]
            has = left >= 0
            left = np.where(has, left, i)
            now = part[row + i]
            # a leaf that there is not, the last byte's or a left neighbour's, is written to the unused place 0, and its path is the merged part's
            leaf = top + size
            flat[np.where(gone < size, leaf + gone, top)] = _NOTHING
            flat[leaf + i] = self.leaves(now, part[row + end], i)
            flat[np.where(has, leaf + left, top)] = self.leaves(part[row + left], now, left)
            path = np.concatenate([np.where(gone < size, gone, i), i, left]) + size
            base = np.tile(top, 3)
            while path[0] > 1:
                path >>= 1
                flat[base + path] = np.minimum(flat[base + 2 * path], flat[base + 2 * path + 1])
            live = live[flat[top + 1] != _NOTHING]
        kept = ids >= 0
        out, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class ByteTokens(Tokens):
    """A ranks file with a table of pre-tokens."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pairs = Pairs(self.ranks)
        self.library, self.spaced, self.table, self.kinds = self, True, _Table(), _kinds()

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """``merged`` of each piece."""
        out: list[list[int] | None] = [None if (rank := self.ranks.get(p)) is None else [rank] for p in pieces]
        by_size: dict[int, list[int]] = {}
        for k, (piece, found) in enumerate(zip(pieces, out, strict=True)):
            if found is None and len(piece) <= SHORT:
                by_size.setdefault(max(0, len(piece) - 2).bit_length(), []).append(k)
            elif found is None:
                out[k] = merged(piece, self.ranks)
        for own in by_size.values():
            for low in range(0, len(own), TREES):
                some = own[low : low + TREES]
                for k, ids in zip(some, self.pairs.merge([pieces[k] for k in some]), strict=True):
                    out[k] = ids
        return out

    def encode_batch_fast(self, pieces: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        """As the library of the other vocabularies encodes new pre-tokens."""
        return [SimpleNamespace(ids=ids) for ids in self.encode([p.encode() for p in pieces])]


@cache
def tokens(path: str) -> ByteTokens:
    """One a worker and file."""
    return ByteTokens(path)


class Pool:
    """The bytes of all ids in one array."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        most = max(ranks.values()) + 1
        self.known, self.lens = np.zeros(most, bool), np.zeros(most, np.int64)
        for token, rank in ranks.items():
            self.known[rank], self.lens[rank] = True, len(token)
        self.starts = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of the rows ``ids[bounds[i]:bounds[i + 1]]``."""
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.lens) or not self.known[ids].all()):
            raise ValueError("an id that the ranks don't know")
        lens = self.lens[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        data = self.data[np.arange(int(ends[-1])) + np.repeat(self.starts[ids] - ends[:-1], lens)]
        offsets = pa.py_buffer(ends[bounds].astype("<i8").tobytes())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data.tobytes())])


@cache
def pool(path: str) -> Pool:
    return Pool(path)


def _schema(df: DataFrame, keep: Sequence[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), into: str = "ids") -> DataFrame:
    """``docs(keep...)`` with ``into array<int>``, the ids of ``text`` by the ranks file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path)
        for batch in batches:
            for part in sliced(batch, text):
                rows = own.batch(part.column(text).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32) if rows else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids], [*keep, into])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lambda b: trimmed(run(b)), _schema(docs, keep, into, T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",), into: str = "decoded") -> DataFrame:
    """``rows(keep...)`` with ``into binary``, the bytes of ``ids``; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pool(path)
        for batch in batches:
            lens = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lens), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_IDS, side="right")))
                part = batch.slice(at, to - at)
                flat = part.column(ids).flatten()
                if flat.null_count:
                    raise ValueError("a null among ids")
                bounds = np.concatenate([[0], np.cumsum(lens[at:to])]).astype(np.int64)
                out = own.decode(flat.to_numpy(zero_copy_only=False).astype(np.int64), bounds)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], out.cast(pa.binary())], [*keep, into])
                at = to

    return rows.select(*dict.fromkeys([*keep, ids])).mapInArrow(lambda b: trimmed(run(b)), _schema(rows, keep, into, T.BinaryType()))

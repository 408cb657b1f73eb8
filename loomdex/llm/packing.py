"""Packing of documents into fixed-length sequences along a space-filling curve.

Each document's token counts are hashed into ``BUCKETS`` cells, damped, normalised and projected to
``DIMS`` random directions.  The cell of the projection on a Hilbert curve is its place: documents are
range-sorted by it and laid end to end, so a sequence holds neighbours.  A prefix sum over the ranges
gives every document its global position; cutting at multiples of the length leaves padding in the last
sequence alone.

Defined cases: null or empty text is a document of the end id alone; a null doc_id stays null and is hashed by its ids; rows with equal
curve cells are spread by a hash of doc_id below the cell (a hot cell can be split over ranges), ties beyond go by doc_id, then ids; repeated rows are laid
out one after the other; a very long text goes through as many sequences as it fills; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.text import mix, sliced, tokens, trimmed

BUCKETS, DIMS, BITS, SPREAD_BITS = 256, 4, 12, 15
#: Coordinates of unit vectors are placed on [-REACH, REACH).
REACH = 4.0
TOKENISED = "doc_id long, place long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of each row of non-negative integer cells below ``2**bits``.

    Gray-code walk from the high bit down: at each level the current corner's bits decide which axes are
    reflected or exchanged for the levels below.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(dims):
            high = (x[d] & level) != 0
            x[0] = np.where(high, x[0] ^ low, x[0])
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= swap
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[-1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[d] >> b & 1)
    return out


def places(ids: list[np.ndarray], doc_ids: np.ndarray) -> np.ndarray:
    """Sort keys: the Hilbert index of each document's projection, then a hash of its doc_id in the low bits."""
    directions = np.random.default_rng(0).standard_normal((BUCKETS, DIMS))
    cell = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.array([np.bincount(cell[x], minlength=BUCKETS) for x in ids], float).reshape(-1, BUCKETS)
    v = np.log1p(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    at = np.clip(((v @ directions) + REACH) / (2 * REACH) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_index(at, BITS) << SPREAD_BITS | (mix(doc_ids.astype(np.uint64)) >> np.uint64(64 - SPREAD_BITS)).astype(np.int64)


def tokenise(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """``TOKENISED`` rows of ``docs(doc_id, text)``: u16 ids with the end id, and the place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens(vocabulary, spaced=False), np.array([end_id], np.uint16)
        for batch in batches:
            for part in sliced(batch, "text"):
                ids = [np.concatenate([x, end]) for x in encoder.batch(part.column("text").to_pylist())]
                doc = part.column("doc_id")
                keys = np.array([zlib.crc32(x.tobytes()) if d is None else d for d, x in zip(doc.to_pylist(), ids, strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc,
                        pa.array(places(ids, keys)),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "place", "n_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), TOKENISED)


def pack(tokenised: DataFrame, length: int = 4096, ranges: int | None = None, id_bytes: int = 4) -> DataFrame:
    """``PIECES`` of a stored ``TOKENISED`` table: ids little-endian of ``id_bytes`` each, every one in exactly one piece.

    ``tokenised`` must be written rows (a file or checkpoint), as it is read three times: for the range
    bounds (places alone), for the ranges' sums (places and counts) and for the pieces.
    """
    n = ranges or int(tokenised.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = tokenised.agg(F.percentile_approx("place", [i / n for i in range(1, n)] or [0.5], 10_000)).head()[0] or []
    bounds = np.unique(np.array(bounds if n > 1 else [], np.int64))

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="right").astype(np.int32))

    ranged = tokenised.withColumn("range", range_of("place"))
    sums = dict(ranged.groupBy("range").agg(F.sum("n_tokens")).collect())  # one number a range
    bases, total = {}, 0
    for k in sorted(sums):
        bases[k], total = total, total + sums[k]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            for part in sliced(batch, "ids"):
                rows = []
                for doc, own, size, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "range", "n_tokens", "ids")), strict=True):
                    if own != current:
                        current, at = own, bases[own]
                    ids, start = np.frombuffer(data, "<u2").astype(f"<u{id_bytes}"), 0
                    while start < size:
                        take = min(size - start, length - at % length)
                        rows.append({"doc_id": doc, "start": start, "length": take, "ids": ids[start : start + take].tobytes(), "doc_tokens": size, "sequence_id": at // length, "offset": at % length})
                        start, at = start + take, at + take
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    laid = ranged.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "place", "doc_id", "ids")
    return laid.select("doc_id", "range", "n_tokens", "ids").mapInArrow(lambda batches: trimmed(cut_up(batches)), PIECES)


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0, id_bytes: int = 4) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: pieces joined in order and padded with ``pad_id``, but for lengths that are powers of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.when(F.expr("bit_count(n_tokens) = 1"), F.lit(0)).otherwise(F.lit(length) - F.col("n_tokens"))
    one = F.lit(int(pad_id).to_bytes(id_bytes, "little"))
    return whole.select("sequence_id", "n_tokens", F.concat(joined, F.unhex(F.repeat(F.hex(one), pad.cast("int")))).alias("ids"))

"""Token ids as length-delimited binary records with masked checksums and an offset index.

A record file holds, for each sequence: the payload's length (u64), its masked checksum (u32), the
payload, and the payload's masked checksum (u32), all little-endian.  The payload is a flag byte (1 if
the row has a doc_id), the doc_id (i64) and the ids (u16 each).  Beside each ``.rec`` file an ``.idx``
file lists every record's byte offset and the end of the file as u64, so that a reader may fetch records
in any order by range reads.  The mask is ``rotate_right(crc32, 15) + 0xa282ead8`` over zlib's CRC-32: a checksum
that is stored beside data which itself holds checksums must not be the plain one.

Defined cases: null or empty text is a sequence of the end id alone; rows with a null doc_id come first;
rows of one doc_id come in order of a hash of their text, then the text, so reruns agree, and one id's many rows may be parted between files; repeated
rows give repeated records; a very long text is one record, made by itself; an empty table gives no files and no rows.  Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.files import opened, unique_name
from loomdex.llm.text import sliced, tokens, trimmed
from loomdex.plans.lineage import cut

READ_BYTES = 8 << 20
MANIFEST = "shard int, path string, records long, tokens long"
ROWS = "doc_id long, shard int, ordinal long, local_start long, n_tokens long, ids binary"


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(data: bytes | memoryview) -> memoryview:
    """The payload of one record; a wrong length or checksum raises ValueError."""
    data = memoryview(data)
    if len(data) < 16:
        raise ValueError("record is cut short")
    (size, of_size), payload, (of_payload,) = struct.unpack("<QI", data[:12]), data[12:-4], struct.unpack("<I", data[-4:])
    if masked(zlib.crc32(data[:8])) != of_size or size != len(payload) or masked(zlib.crc32(payload)) != of_payload:
        raise ValueError("record fails its checksum")
    return payload


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` in ascending doc_id order; one ``MANIFEST`` row a file, in order of ``shard``.

    Texts are range-partitioned by doc_id once and tokenised after that shuffle; a file is as large as its
    partition and is written as it is made, so memory holds one slice of a batch.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, (files, top) = tokens(vocabulary, spaced=True), opened(folder)
        path, out, at, ends, total = f"{top}/{unique_name('tokens', '.rec')}", None, 0, [], 0
        end = np.array([end_id], "<u2")
        for batch in batches:
            for part in sliced(batch, "text"):
                out = out or files.open_output_stream(path)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.batch(part.column("text").to_pylist()), strict=True):
                    record = frame(b"".join((struct.pack("<?q", doc is not None, doc or 0), ids.astype("<u2").tobytes(), end.tobytes())))
                    ends.append(at)
                    at += out.write(record)
                    total += len(ids) + 1
        if out:
            out.close()
            with files.open_output_stream(path.removesuffix(".rec") + ".idx") as index:
                index.write(np.array([*ends, at], "<u8").tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "path": path.rpartition("/")[2], "records": len(ends), "tokens": total}], schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").drop("_hash")
    return cut(ordered.mapInArrow(lambda batches: trimmed(put(batches)), MANIFEST))


def records(folder: str, path: str, ordinals: list[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(ordinal, doc_id, ids) of a file's records: all of them in order, or the given ones by range reads in their order."""
    files, top = opened(folder)
    with files.open_input_file(f"{top}/{path.removesuffix('.rec')}.idx") as f:
        at = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with files.open_input_file(f"{top}/{path}") as f:

        def parsed(i: int, record: memoryview) -> tuple[int, int | None, np.ndarray]:
            payload = unframe(record)
            known, doc = struct.unpack("<?q", payload[:9])
            return i, doc if known else None, np.frombuffer(payload[9:], "<u2")

        if ordinals is not None:
            for i in ordinals:
                f.seek(int(at[i]))
                yield parsed(i, memoryview(f.read(int(at[i + 1] - at[i]))))
            return
        i = 0
        while i + 1 < len(at):
            j = max(i + 1, int(np.searchsorted(at, at[i] + READ_BYTES, side="right")) - 1)
            f.seek(int(at[i]))
            block = memoryview(f.read(int(at[j] - at[i])))
            for k in range(i, j):
                yield parsed(k, block[at[k] - at[i] : at[k + 1] - at[i]])
            i = j


def read(manifest: DataFrame, folder: str, shuffle_seed: int | None = None) -> DataFrame:
    """``ROWS`` of the files in ``manifest``: ids as little-endian u32, ``local_start`` counts the file's ids before.

    With a seed the files' records come in an order drawn from it, fetched through the index (``local_start`` is null then).
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                order = None if shuffle_seed is None else np.random.default_rng([shuffle_seed, f["shard"]]).permutation(f["records"]).tolist()
                rows, size, start = [], 0, 0
                for i, doc, ids in records(folder, f["path"], order):
                    rows.append({"doc_id": doc, "shard": f["shard"], "ordinal": i, "local_start": start if order is None else None, "n_tokens": len(ids), "ids": ids.astype("<u4").tobytes()})
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("ordinal", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    # the manifest has one row a file; each file is a task of its own
    files = manifest.select("shard", "path", "records")
    return files.repartition(max(1, files.count()), "shard").mapInArrow(get, ROWS)


def starts(manifest: DataFrame) -> DataFrame:
    """``(shard, base)``: ids in all files before; a running sum over one row a file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

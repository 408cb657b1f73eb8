"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit RGB PNG of ``WIDTH`` pixels a row.  Rows carry the stored form's
SHA-256, and shard, offset and length of its bytes inside a tar file; the member's name is the digest, so a
shard can be unpacked with any tar.  A task writes a digest once; over all shards each digest has one
canonical place (the least shard and offset).  ``metadata`` fills columns from the image header alone by
range reads, ``contents`` reads whole members.

Defined cases: null text is empty; the payload is padded with spaces to a positive multiple of ``ROW``
bytes; equal texts share digest and place; repeated rows give repeated rows; an empty table gives no shards
and no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.files import opened, unique_name, written
from loomdex.llm.text import SLICE_BYTES, sliced, trimmed

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk.
HEADER_BYTES = 33
#: Columns of a member's place and of its image header.
PLACE, HEADER = ("shard", "offset", "length"), ("width", "height", "bit_depth", "colour_type")
MANIFEST = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % ROW if data else ROW), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # a filter byte of 0 leads each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return b"".join((PNG_SIGNATURE, _chunk(b"IHDR", header), _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)), _chunk(b"IEND", b"")))


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type; ValueError if it isn't a PNG's start."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> bytes:
    """The samples of an image that ``encode_png`` wrote; checksums and sizes are verified."""
    width, height, depth, colour = png_header(data)
    if (depth, colour) != (8, 2):
        raise ValueError("only 8-bit RGB")
    at, packed = HEADER_BYTES, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("chunk fails its checksum")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * CHANNELS + 1)
    if rows[:, 0].any():
        raise ValueError("only filter 0")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Channel means and a 16-bin histogram of the samples, in thousandths."""
    samples = np.frombuffer(payload, np.uint8)
    means = samples.reshape(-1, CHANNELS).mean(axis=0)
    share = np.bincount(samples >> 4, minlength=16) / len(samples)
    return ",".join(f"{round(float(x) * 1000)}" for x in [*means, *share])


def write(docs: DataFrame, folder: str, shard_bytes: int = 256 << 20) -> DataFrame:
    """Store every text of ``docs(doc_id, text)``; ``MANIFEST`` rows with canonical places.

    Texts are not shuffled: each task fills its own shards, which it closes at ``shard_bytes``.
    """
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = opened(folder)
        out, name, at, placed = None, "", 0, {}
        for batch in batches:
            for part in sliced(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    payload, size = payload_of(text)
                    media = encode_png(payload)
                    digest = hashlib.sha256(media).hexdigest()
                    if digest not in placed:
                        if out is None:
                            name, at = unique_name("media", ".tar"), 0
                            out = files.open_output_stream(f"{top}/{name}")
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(media)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % tarfile.BLOCKSIZE))
                        placed[digest] = (name, at + tarfile.BLOCKSIZE, len(media))
                        at += tarfile.BLOCKSIZE + len(media) + -len(media) % tarfile.BLOCKSIZE
                        if at >= shard_bytes:
                            out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
                            out.close()
                            out = None
                    shard, offset, length = placed[digest]
                    rows.append({"doc_id": doc, "n_bytes": size, "digest": digest, "shard": shard, "offset": offset, "length": length})
                yield pa.RecordBatch.from_pylist(rows, schema)
        if out:
            out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            out.close()

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: trimmed(put(batches)), MANIFEST), "media-manifest")
    place = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return rows.select("doc_id", "n_bytes", "digest").join(place, "digest").select("doc_id", "n_bytes", "digest", "place.shard", "place.offset", "place.length")


def places(manifest: DataFrame) -> DataFrame:
    """The distinct stored members, in reading order: dealt by stretches of the shards, sorted by offset."""
    members = manifest.select("digest", "shard", "offset", "length").distinct()
    return members.repartition("shard", F.shiftright("offset", 24)).sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], folder: str, most: int | None) -> Iterator[tuple[dict, bytes]]:
    files, top = opened(folder)
    name, source = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != name:
                if source:
                    source.close()
                name, source = row["shard"], files.open_input_file(f"{top}/{row['shard']}")
            source.seek(row["offset"])
            yield row, source.read(min(row["length"], most or row["length"]))
    if source:
        source.close()


def _mapped(members: DataFrame, folder: str, most: int | None, fields: list[tuple[str, pa.DataType, str]], fill) -> DataFrame:
    schema = pa.schema([(n, t) for n, t, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row, data in _ranges(batches, folder, most):
            rows.append(fill(row, data))
            size += len(data) + 256
            if size >= SLICE_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return members.mapInArrow(lambda batches: trimmed(run(batches)), ", ".join(f"{n} {s}" for n, _, s in fields))


def metadata(members: DataFrame, folder: str) -> DataFrame:
    """``places`` rows with width, height, bit depth and colour type, from ``HEADER_BYTES`` of each member."""
    fields = [("digest", pa.string(), "string"), ("shard", pa.string(), "string"), ("offset", pa.int64(), "long"), ("length", pa.int64(), "long")]
    fields += [(c, pa.int32(), "int") for c in HEADER]

    def fill(row: dict, head: bytes) -> dict:
        return row | dict(zip(HEADER, png_header(head), strict=True))

    return _mapped(members, folder, HEADER_BYTES, fields, fill)


def contents(members: DataFrame, folder: str) -> DataFrame:
    """Per stored member what its read-back bytes hold: digests, checksums and the feature; place and, where given, header columns stay."""
    given = [c for c in HEADER if c in members.columns]
    fields = [("digest", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long")]
    fields += [("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]
    fields += [("shard", pa.string(), "string"), ("offset", pa.int64(), "long"), ("length", pa.int64(), "long"), *((c, pa.int32(), "int") for c in given)]

    def fill(row: dict, media: bytes) -> dict:
        payload = decode_png(media)
        return {
            "digest": row["digest"],
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-16:]),
            "media_bytes": len(media),
            "media_sha256": hashlib.sha256(media).hexdigest(),
            "feature": feature_of(payload),
            **{c: row[c] for c in (*PLACE, *given)},
        }

    return _mapped(members.select("digest", *PLACE, *given), folder, None, fields, fill)

"""Media shards, token records and packing: exact round trips."""

import hashlib
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest

from loomdex.llm import files, media, packing, token_records
from tests.llm.test_text import unaltered


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/out"


def test_media_round_trip(messy, folder, tmp_path):
    manifest = media.write(messy, folder, shard_bytes=20_000)
    members = media.places(manifest)
    heads = media.metadata(members, folder).collect()
    read = {r["digest"]: r for r in media.contents(members, folder).collect()}
    rows = manifest.collect()
    texts = {r["doc_id"]: r["text"] for r in messy.select("doc_id", "text").collect()}
    assert len(rows) == messy.count() and len({(r["shard"], r["offset"]) for r in rows}) == len({t or "" for t in texts.values()})
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        got = read[r["digest"]]
        assert (r["n_bytes"], got["payload_bytes"], got["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert got["tail_crc32"] == zlib.crc32(payload[-16:]) and got["media_sha256"] == r["digest"] and got["media_bytes"] == r["length"]
        shard = (tmp_path / "out" / r["shard"]).read_bytes()
        assert media.decode_png(shard[r["offset"] :][: r["length"]]) == payload
    assert all(h["width"] == 64 and h["bit_depth"] == 8 and h["height"] * 192 == read[h["digest"]]["payload_bytes"] for h in heads)
    names = [m.name for p in (tmp_path / "out").iterdir() for m in tarfile.open(p)]
    assert {n.removesuffix(".png") for n in names} >= {r["digest"] for r in rows}


def plain_media(data):
    """An image's samples by its format's rules alone, and the feature by hand."""
    import struct

    at, packed, size = 8, b"", None
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        size = struct.unpack(">IIBB", body[:10]) if kind == b"IHDR" else size
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, stride = zlib.decompress(packed), size[0] * 3 + 1
    samples = b"".join(raw[i + 1 : i + stride] for i in range(0, len(raw), stride))
    assert all(raw[i] == 0 for i in range(0, len(raw), stride))
    means = [sum(samples[c::3]) / len(samples[c::3]) for c in range(3)]
    shares = [sum(1 for x in samples if x >> 4 == b) / len(samples) for b in range(16)]
    return samples, ",".join(str(round(1000 * x)) for x in [*means, *shares]), size


def test_media_query(messy, spark, tmp_path, monkeypatch):
    from loomdex.llm import queries

    messy.select("doc_id", "text", "lang").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op1_media_shards"](spark, f"file://{tmp_path}").collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in messy.select("doc_id", "text").collect()}
    assert len(rows) == messy.count()
    for r in rows:
        data = texts[r["doc_id"]]
        payload = data + b" " * (-len(data) % 192 if data else 192)
        stored = media.encode_png(payload)
        samples, feature, (width, height, depth, colour) = plain_media(stored)
        assert samples == payload and r["feature"] == feature and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert (r["width"], r["height"], r["bit_depth"], r["colour_type"]) == (width, height, depth, colour) == (64, len(payload) // 192, 8, 2)
        assert r["shard"].endswith(".tar") and r["offset"] >= 512 and r["length"] == r["media_bytes"] == len(stored)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_media_of_nothing(empty, folder):
    assert media.write(empty, folder).count() == 0


def test_damaged_png_is_refused():
    data = bytearray(media.encode_png(b"a" * 192))
    data[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(data))
    with pytest.raises(ValueError):
        media.png_header(b"GIF89a" + b"\0" * 40)


def test_records_round_trip(messy, folder, byte_bpe):
    written = token_records.write(messy, folder, byte_bpe, partitions=3)
    rows = token_records.read(written, folder).join(token_records.starts(written), "shard").collect()
    library = unaltered(byte_bpe)
    rows.sort(key=lambda r: (r["shard"], r["ordinal"]))
    want = sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in messy.select("doc_id", "text").collect()))
    start = 0
    for r, (doc, ids) in zip(rows, want, strict=True):
        assert (r["doc_id"], r["base"] + r["local_start"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc, start, ids)
        start += len(ids)
    mixed = token_records.read(written, folder, shuffle_seed=3).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in mixed) == Counter((r["doc_id"], bytes(r["ids"])) for r in rows)


def test_records_with_null_ids_and_none(spark, empty, folder, byte_bpe):
    assert token_records.write(empty, folder, byte_bpe, partitions=2).count() == 0
    df = spark.createDataFrame([(None, "a"), (3, "b")], "doc_id long, text string")
    written = token_records.write(df, folder, byte_bpe, partitions=1)
    assert [r["doc_id"] for r in token_records.read(written, folder).orderBy("ordinal").collect()] == [None, 3]


def test_records_of_one_id_come_in_a_fixed_order(spark, tmp_path, byte_bpe):
    texts = [f"text {i % 40}" for i in range(120)] + [None, ""]
    orders = []
    for k, parts in enumerate((3, 5)):
        df = spark.createDataFrame([(7, t) for t in texts] + [(9, "last")], "doc_id long, text string").repartition(parts)
        folder = f"file://{tmp_path}/{k}"
        written = token_records.write(df, folder, byte_bpe, partitions=4)
        rows = token_records.read(written, folder).join(token_records.starts(written), "shard").collect()
        orders.append([(r["doc_id"], bytes(r["ids"])) for r in sorted(rows, key=lambda r: r["base"] + r["local_start"])])
        assert written.filter("records > 0").count() > 1
    assert orders[0] == orders[1] and orders[0][-1][0] == 9 and len(orders[0]) == 123


def test_damaged_record_is_refused():
    data = bytearray(token_records.frame(b"payload"))
    for i in range(len(data)):
        data[i] ^= 4
        with pytest.raises(ValueError):
            token_records.unframe(bytes(data))
        data[i] ^= 4
    assert bytes(token_records.unframe(bytes(data))) == b"payload"


@pytest.mark.parametrize("ranges", [1, 5])
def test_packing(messy, word_bpe, ranges, spark):
    length = 256
    made = packing.tokenise(messy, word_bpe).persist()
    pieces = packing.pack(made, length, ranges).collect()
    library = unaltered(word_bpe)
    docs = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in messy.select("doc_id", "text").collect()}
    uses = Counter(r["doc_id"] for r in messy.select("doc_id").collect())
    ends, total = Counter(), 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * length + p["offset"] == total and p["offset"] + p["length"] <= length
        assert np.frombuffer(p["ids"], "<u4").tolist() == docs[p["doc_id"]][p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(docs[p["doc_id"]])
        total += p["length"]
        ends[p["doc_id"]] += p["length"]
    assert ends == {d: uses[d] * len(ids) for d, ids in docs.items()}
    whole = packing.sequences(packing.pack(made, length, ranges), length).collect()
    assert all(len(s["ids"]) == 4 * (length if s["n_tokens"] & (s["n_tokens"] - 1) else s["n_tokens"]) for s in whole)


def test_packing_of_nothing(empty, word_bpe):
    assert packing.pack(packing.tokenise(empty, word_bpe)).count() == 0


def test_hilbert_is_a_walk():
    n = 8
    cells = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    d = packing.hilbert_index(cells, 3)
    assert sorted(d.tolist()) == list(range(n**3))
    assert (np.abs(np.diff(cells[np.argsort(d)], axis=0)).sum(axis=1) == 1).all()


def test_copies_lie_together(spark, word_bpe):
    texts = ["alpha beta gamma delta " * 30, "one two three four five " * 30, "rot grün blau gelb weiß " * 30]
    df = spark.createDataFrame([(i, texts[i % 3]) for i in range(60)], "doc_id long, text string")
    order = [r["doc_id"] % 3 for r in packing.pack(packing.tokenise(df, word_bpe).persist(), 1 << 20, 1).orderBy("sequence_id", "offset").collect()]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) == 2


def test_scratch_is_removed(spark):
    seen = []

    def make(folder):
        seen.append(folder)
        files.opened(folder)[0].create_dir(files.opened(folder)[1])
        return spark.range(3)

    assert files.kept(spark, "x", make).count() == 3
    assert files.opened(seen[0])[0].get_file_info(files.opened(seen[0])[1]).type.name == "NotFound"

"""Byte-level BPE against the library that the ranks are made for."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm import byte_bpe, queries
from loomdex.llm.text import vocabulary

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers  # noqa: E402

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
HARD = "ab 's't're'll \n\t  é中1²٣😀\U000e0067​İ\U000f0000<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_every_code_point_and_random_mixes(library):
    r = random.Random(3)
    texts = ["".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000), "", " ", "\n\n", "it's 'so"]
    texts += ["".join(r.choice(HARD) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), r.randrange(0x4E00, 0x9000), r.randrange(0x1F300, 0x1F700)])) for _ in range(80)) for _ in range(300)]
    assert [ids.tolist() for ids in byte_bpe.tokens(PATH).batch(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 66, 67, 1000, 30_000])
def test_long_runs(library, n):
    for piece in ("x" * n, "é" * n, ("abcdefgh" * n)[:n]):
        want = library.encode_ordinary(piece)
        assert byte_bpe.merged(piece.encode(), byte_bpe.load_ranks(PATH)) == want
        assert byte_bpe.tokens(PATH).encode([piece.encode()]) == [want]


def plain(piece, ranks):
    """The rule without any tree: the leftmost pair of least rank, until none has one."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return [ranks[p] for p in parts]
        _, i = min(known)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_trees_against_the_plain_rule_on_small_ranks(tmp_path):
    r = random.Random(8)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 400:  # pairs in no order of length, so that ties and lost merges are many; some tokens can't be merged to
        a, b = r.choice([k for k in ranks if k.isalpha() and k.islower() and len(k) < 9]), r.choice("abc").encode()
        if set(a) <= set(b"abc"):
            ranks.setdefault(a + b, len(ranks) + r.randrange(3) * 1000)
    assert byte_bpe.Pairs({bytes([b]): b for b in range(256)}).merge([b"ab", b"aa"]) == [[97, 98], [97, 97]]
    pairs = byte_bpe.Pairs(ranks)
    for n in (2, 3, 5, 9, 17, 40, 65):
        pieces = [p for p in (bytes(r.choice(b"abc") for _ in range(n)) for _ in range(60)) if p not in ranks]
        assert pairs.merge(pieces) == [plain(p, ranks) for p in pieces] == [byte_bpe.merged(p, ranks) for p in pieces]


def test_query_on_hard_rows(spark, messy, empty, library, tmp_path):
    folder = f"file://{tmp_path}"
    messy.withColumns({"ids": F.lit("x"), "decoded": F.lit(1)}).write.parquet(f"{folder}/documents.parquet")
    rows = queries.op11_byte_bpe(spark, folder).collect()
    want = []
    for d in messy.select("doc_id", "text").collect():
        ids = library.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in rows) == sorted(want)
    assert byte_bpe.encode(empty, PATH).count() == 0


def test_decoding(spark):
    rows = spark.createDataFrame([(1, [72, 105], 5), (2, [], 5), (3, None, 5)], "doc_id long, ids array<int>, decoded int")
    ranks = byte_bpe.load_ranks(PATH)
    of = {v: k for k, v in ranks.items()}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(rows, PATH).collect()} == {1: of[72] + of[105], 2: b"", 3: b""}
    for bad in ([50_300], [-1], [None]):
        with pytest.raises(Exception, match="don't know|null among"):
            byte_bpe.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), PATH).collect()

"""Tiered search against plain code, and the proofs that let queries end early."""

import math
import random
import re

import pyarrow as pa
import pytest

from loomdex.llm import tiered_search
from loomdex.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, queries, k):
    """(item, rank, doc_id, score), every document scored."""
    own = [(i, terms(t)) for i, t in docs]
    documents, total = sum(1 for _, t in own if t), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in queries:
        found = []
        for i, t in own:
            score = 0
            for x in terms(text):
                if tf := t.count(x):
                    m = 100 - 25 + (25 * len(t) * documents) // total
                    score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(200)], k=r.choice([3, 20, 20, 60, 900])))) for i in range(n)]
    queries = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 5, 30])))) for i in range(30)]
    return rows, queries, words


def searched(spark, folder, rows, queries, k):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = tiered_search.build(docs, f"file://{folder}/index")
    return index, tiered_search.search(index, spark.createDataFrame(queries, "item_id long, text string"), k).collect()


def test_against_plain_code_at_every_tier(spark, tmp_path):
    rows, queries, words = corpus(400, 1)
    # a term that few short documents repeat is proven in the first tier; long documents alone hold the last words
    rows += [(1000 + i, "peak peak peak") for i in range(9)] + [(2000 + i, " ".join(["deep", *words * 40])) for i in range(6)]
    queries += [(100, "peak"), (101, "deep"), (102, "peak deep w0 w0"), (103, "unknown"), (104, None), (105, " -- "), (106, "w0 PEAK w0"), (107, "peak"), (107, "deep")]
    _, got = searched(spark, tmp_path, rows, queries, 5)
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == plain(rows, queries, 5)
    tiers = {r["item_id"]: r["tier"] for r in got}
    assert tiers[100] == 1 and tiers[101] == 4


def test_hard_rows(spark, tmp_path):
    rows = [(None, "alpha beta"), (None, "alpha beta"), (1, None), (2, ""), (3, " \n- "), (4, "Alpha"), (4, "ALPHA alpha"), (5, "Äpfel alpha"), (6, "äpfel"), (7, "x" * 100_000 + " alpha"), (8, "a-b_c\x7fd €5"), (9, "alpha beta"), (10, "\x00alpha\x00")]
    queries = [(1, "alpha"), (2, "Äpfel äpfel"), (3, "b d €5"), (4, "beta alpha beta"), (None, "c"), (1, "beta")]
    _, got = searched(spark, tmp_path, rows, queries, 20)
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == plain(rows, queries, 20)


def test_blocks_of_queries_and_small_shards(spark, tmp_path, monkeypatch):
    rows, queries, _ = corpus(120, 2)
    monkeypatch.setattr(tiered_search, "BLOCK_TERMS", 40)
    _, got = searched(spark, tmp_path, rows, queries, 3)
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == plain(rows, queries, 3)


def test_index_holds_every_posting_in_its_tier(spark, tmp_path):
    rows, queries, _ = corpus(80, 3)
    index, _ = searched(spark, tmp_path, rows, queries[:1], 3)
    docs, bounds = {}, (10**9, *tiered_search.EDGES, 0)
    for r in index.rows([0]).collect():
        docs[r["shard"]] = (r["ids"], r["lengths"])
    assert sorted(i for ids, _ in docs.values() for i in ids) == sorted(i for i, _ in rows)
    found = {}
    for r in index.rows(range(1, 5)).collect():
        ids, lengths = docs[r["shard"]]
        for word, top, a, b in zip(r["terms"], r["tops"], [0, *r["ends"]], r["ends"]):
            values = [(10**9 * u) // (1000 * u + 12 * lengths[d]) for d, u in zip(r["docs"][a:b], r["uses"][a:b])]
            assert max(values) == top and all(bounds[r["tier"]] <= v < bounds[r["tier"] - 1] for v in values)
            for d, u in zip(r["docs"][a:b], r["uses"][a:b]):
                assert (ids[d], word) not in found
                found[ids[d], word] = u
    assert found == {(i, w): terms(t).count(w) for i, t in rows for w in terms(t)}


def test_shards_are_cut_and_joined(monkeypatch):
    monkeypatch.setattr(tiered_search, "SHARD_BYTES", 10)
    batches = [pa.RecordBatch.from_pydict({"id": ids, "text": texts}) for ids, texts in (([1, 2, 3], ["aaaa", "bbbb", "cccc"]), ([4], ["d"]), ([5, 6], ["e" * 50, None]))]
    assert [s.column("id").to_pylist() for s in tiered_search._shards(iter(batches), "text")] == [[1, 2], [3, 4], [5], [6]]
    assert [i for s in tiered_search._shards(iter(batches), "text") for i in s.column("id").to_pylist()] == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("empty_one", ["docs", "queries"])
def test_empty_tables(spark, tmp_path, empty_one):
    rows, queries, _ = corpus(5, 4)
    docs = spark.createDataFrame(rows if empty_one != "docs" else [], "doc_id long, text string")
    index = tiered_search.build(docs, f"file://{tmp_path}/index")
    assert tiered_search.search(index, spark.createDataFrame(queries if empty_one != "queries" else [], "item_id long, text string"), 3).count() == 0


def test_query_is_registered():
    assert "op12_ranked_search" in QUERIES

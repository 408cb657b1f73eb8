"""Every query of the operators, and the pipeline, over tables of hard rows and over empty ones."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import queries
from tests.llm.conftest import messy_rows
from tests.llm.test_joins import brute
from tests.llm.test_text import unaltered

pipeline = pytest.importorskip("corpus_pipeline")
NEW = ("host string, rule string, verdict string, digest string, license string, size long, target double, keep int, rank int, component_id long, row long, _salt int, place long, y int, part int")


def written(spark, folder, documents, labels, pages, embeddings, items=()):
    extra = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in NEW.split(", ")]
    documents.select("*", *extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("*", F.lit("x").alias("text"), F.lit(1).alias("y")).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").select("*", F.lit("x").alias("host"), F.lit(0).alias("_salt")).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(embeddings, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("rank"), F.lit(1).alias("score")).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(items, "item_id long, text string").select("*", F.lit("x").alias("doc_id"), F.lit(1).alias("terms")).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def documents_of(spark):
    rows = messy_rows()
    rows += [(None, "no id", "en", "s1", 5, None, None, None), (None, None, None, None, None, None, None, None), (None, "no id", "en", "s1", 5, None, None, None), (5, "another text under a known id", "de", "s2", 3, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, path string, copies int").repartition(3)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    r = random.Random(9)
    labels = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(25)] + [(3, 0, 1), (None, 1, 1), (7, None, None), (999, 1, 0)]
    pages = [(i, f"http://h{i % 3}.example.org/en/{i}", "x") for i in range(20)] + [(3, None, None), (None, "http://null.example.org/", None), (4, "junk", ""), (4, "junk", ""), (30, "https://" + "a" * 5000 + ".com/de/1", None)]
    vectors = [(i, [r.choice([0.0, 0.5, -1.25]) for _ in range(6)], 0) for i in range(120)] + [(50, None, 0), (None, [1.0] * 6, 0), (7, [float("nan")] * 6, 0), (100, [0.5, None, 1.0], 0), (8, [], 0), (9, [1.0] * 9, 0)]
    return written(spark, f"file://{tmp_path_factory.mktemp('hard')}", documents_of(spark), labels, pages, vectors, [(1, "one two words"), (None, "id"), (2, None), (3, "zzzz"), (3, "TWO")])


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return written(spark, f"file://{tmp_path_factory.mktemp('nothing')}", documents_of(spark).limit(0), [], [], [])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_empty_tables_through_the_pipeline(spark, nothing):
    assert pipeline.run(spark, nothing).count() == 0


def test_a_row_for_every_row(spark, hard):
    documents, pages = spark.read.parquet(f"{hard}/documents.parquet"), spark.read.parquet(f"{hard}/pages.parquet")
    n, ids = documents.count(), sorted((r["doc_id"] for r in documents.select("doc_id").collect()), key=lambda x: (x is None, x))
    for name in ("op1_media_shards", "op2_token_records", "op4_license_scan", "op6_quality_classifier", "op8_toxicity", "op9_source_mix", "op11_byte_bpe"):
        rows = queries.QUERIES[name](spark, hard).collect()
        assert len(rows) == n and sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ids, name
    urls = queries.QUERIES["op10_url_reputation"](spark, hard).collect()
    assert len(urls) == pages.count() and {r["verdict"] for r in urls} <= {"allow", "block"}


def test_records_and_pieces_hold_the_library_s_ids(spark, hard, byte_bpe, word_bpe):
    documents = spark.read.parquet(f"{hard}/documents.parquet").select("doc_id", "text").collect()

    def crc(library, text):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        return len(ids), ids

    library = unaltered(byte_bpe)
    want = sorted((d["doc_id"] is not None, d["doc_id"] or 0, *(lambda n, ids: (n, zlib.crc32(np.array(ids, "<u4").tobytes())))(*crc(library, d["text"]))) for d in documents)
    rows = queries.QUERIES["op2_token_records"](spark, hard).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None] == sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)

    library = unaltered(word_bpe)
    whole = sorted(tuple(crc(library, d["text"])[1]) for d in documents)
    by_doc, sequences = {}, {}
    for p in queries.QUERIES["op3_packing"](spark, hard).collect():
        by_doc.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for ps in by_doc.values() for p in ps) == sum(map(len, whole))
    for ps in sequences.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= 4096
    texts = {}
    for d in documents:
        texts.setdefault(d["doc_id"], []).append(crc(library, d["text"])[1])
    for doc, ps in by_doc.items():
        spans = {(p["start"], p["length"], p["ids_crc32"]) for p in ps}
        assert all(any(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for ids in texts[doc]) for s, n, c in spans)
    assert len(sequences) == -(-sum(map(len, whole)) // 4096)


def test_join_query_against_brute_force(spark, hard):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{hard}/documents.parquet").select("doc_id", "text").collect() if r["doc_id"] is not None]
    once = [(i, t) for i, t in rows if [d for d, _ in rows].count(i) == 1]
    want = brute(once, 3, 90, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op5_ngram_jaccard_join"](spark, hard).collect() if r["doc_id"] in want}
    twice = {i for i, _ in rows} - want.keys()
    assert got.keys() == want.keys()
    for i, (n, component, _) in want.items():
        # ids that stand on several rows may lead on to a smaller one
        assert got[i][0] == n and (got[i][1] == component or got[i][1] in twice)


def test_scores_are_chances(spark, hard):
    rows = queries.QUERIES["op8_toxicity"](spark, hard).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in queries.QUERIES["op6_quality_classifier"](spark, hard).collect())


def test_reruns_agree(spark, hard):
    for name in ("op2_token_records", "op8_toxicity", "op9_source_mix"):
        first, again = (sorted(map(str, queries.QUERIES[name](spark, hard).collect())) for _ in range(2))
        assert first == again, name


def test_hard_rows_through_the_pipeline(spark, hard):
    pieces = pipeline.run(spark, hard).collect()
    assert pieces and all(p["offset"] + p["length"] <= 4096 for p in pieces)

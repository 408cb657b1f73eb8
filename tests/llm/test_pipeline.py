"""The pipeline's stages on messy rows and as a whole."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder_of(spark, tmp_path, docs, labels):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_stages_keep_columns_and_copies_go(messy, spark, tmp_path):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1.5).alias("score"), F.lit("x").alias("host"))
    sf = folder_of(spark, tmp_path, docs, [(i, 1, 0) for i in range(20)])
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
    assert pipeline.drop_toxic(spark, docs, sf).count() == docs.count()
    assert pipeline.keep_good(spark, docs, sf).count() == docs.count()
    ids = sorted(r["doc_id"] for r in pipeline.one_of_each_group(spark, docs, sf).collect())
    assert 7 not in ids and ids.count(6) == 1 and {0, 1, 2, 3, 4, 6, 10} <= set(ids)


def test_values_of_further_columns_stay(messy, spark, tmp_path):
    names = ["host", "path", "_host", "_path", "_copy", "_digest", "_row", "_mean", "keep", "copies", "size", "target", "y"]
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    sf = folder_of(spark, tmp_path, docs, [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(20)])
    for _, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf)
        assert rows.columns == docs.columns
        own = rows.collect()
        assert own and all(r[n] == f"{n}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in own for n in names)


def test_nothing_goes_through(empty, spark, tmp_path):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    sf = folder_of(spark, tmp_path, docs, [])
    assert pipeline.run(spark, sf).count() == 0


def test_toxic_and_bad_documents_go(spark, tmp_path):
    from tests.llm.test_models import quality_rows, toxic_rows

    toxic, shape = toxic_rows(500, 7), quality_rows(300)
    rows = [(i, t, "en", "s1", len(t)) for i, t, _ in toxic] + [(1000 + i, t, "en", "s2", len(t)) for i, t, *_ in shape]
    labels = [(i, 1, y) for i, _, y in toxic] + [(1000 + i, y, 0) for i, *_, y in shape]
    sf = folder_of(spark, tmp_path, spark.createDataFrame(rows, DOCS), labels)
    packed = {r["doc_id"] for r in pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert not packed & {i for i, q, t in labels if t or not q} or len(packed & {i for i, q, t in labels if t or not q}) < 8
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in pipeline.keep_good(spark, pipeline.drop_toxic(spark, docs, sf), sf).select("doc_id").collect()}
    assert len({i for i, q, t in labels if q and not t} - kept) < 8


def test_rows_are_judged_by_their_text_not_their_id(spark, tmp_path):
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [(1, words("a")), (1, words("b")), (1, words("a")), (2, words("b")), (3, words("c")), (None, words("c")), (None, words("d")), (None, words("d")), (None, words("e")), (4, ""), (4, ""), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()), key=str)
    want = [(1, words("a")), (1, words("b")), (3, words("c")), (None, words("d")), (None, words("e")), (4, ""), (5, None), (None, "")]
    assert got == sorted(want, key=str)


def test_size_estimates_stay_small_on_a_chain_of_near_copies(spark, tmp_path, monkeypatch):
    """A chain of near copies takes many rounds, and no round multiplies the planner's size of what it leaves."""
    from loomdex.operators import components
    from loomdex.plans.lineage import cut

    bits = []

    def watched(df):
        out = cut(df)
        bits.append(out._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(components, "cut", watched)
    n = 300
    docs = spark.createDataFrame([(i * 77 % n, " ".join(f"w{j}" for j in range(i, i + 30)), "en", "s", 1) for i in range(n)], DOCS)
    assert [r["doc_id"] for r in pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()] == [0]
    assert len(bits) > 8 and max(bits) < 3_000, bits

"""The segmented index against one made anew, and what its searches read."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import retrieval, search_index, segments

WORDS = ["alpha", "beta", "gamma", "delta", "user", "users", "get_user", "Ünï", "x9"]


def texts(r, n):
    return " ".join(r.choices(WORDS, [9, 5, 3, 1, 1, 1, 1, 1, 1], k=n))


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in sorted(rows.items())], "id long, title string, body string")


def rounded(df):
    return [(r["key"], round(r["score"], 9)) for r in df.collect()]


def same_as_fresh(spark, index, rows, folder, weights=None, **options):
    """Searches of ``index`` are those of an index of ``rows`` alone, and of BM25 over their texts."""
    docs = frame(spark, rows)
    fresh = segments.build(docs, "id", ["title", "body"], folder, stripe=index.state()["stripe"], **options)
    own = weights or {"title": 1.0, "body": 1.0}
    for query in ("beta delta", "user ünï x9 absent"):
        want = rounded(fresh.search(query, own))
        assert rounded(index.search(query, own)) == want, query
        if not options:
            plain = rounded(retrieval.bm25(docs, "id", query, own).withColumnRenamed("id", "key"))
            assert sorted(want) == sorted(plain)
        for k in (7, 1000):
            got = rounded(index.search(query, own, limit=k))
            assert len(got) == min(k, len(want)) and [s for _, s in got] == [s for _, s in want[:k]], (query, k)
            assert got == want[:k]
        every = rounded(index.search(query, own, limit=5, all_terms=True))
        assert every == rounded(fresh.search(query, own, all_terms=True))[:5]


def test_changes_leave_what_a_fresh_index_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FIRST", 2)
    r = random.Random(1)
    rows = {i: (texts(r, r.randint(0, 3)), texts(r, r.choice([1, 5, 40]))) for i in range(60)}
    index = segments.build(frame(spark, rows), "id", ["title", "body"], f"file://{tmp_path}/i", stripe=8, buckets=4)
    for step in range(3):
        changed = {r.randrange(90): (None if step == 1 else texts(r, 2), texts(r, r.choice([1, 9, 60]))) for _ in range(12)}
        index.add(frame(spark, changed), "id")
        rows |= {k: (t or "", b) for k, (t, b) in changed.items()}
        gone = [r.randrange(90) for _ in range(8)]
        index.delete(spark.createDataFrame([(g,) for g in gone], "key long"))
        rows = {k: v for k, v in rows.items() if k not in gone}
        index.maintain(fanout=3)
    state = index.state()
    assert len(state["segments"]) < 6 and state["version"] > 6
    assert sorted(x["key"] for x in index.live().collect()) == sorted(rows)
    same_as_fresh(spark, index, rows, f"file://{tmp_path}/fresh", {"title": 10.0, "body": 1.0})


def test_edges(spark, tmp_path):
    index = segments.create(spark, f"file://{tmp_path}/i", ["title", "body"], stripe=4, buckets=2)
    assert index.search("alpha").count() == 0 and index.search("alpha", limit=3).count() == 0
    index.delete(spark.createDataFrame([(1,)], "key long")).maintain()
    index.add(frame(spark, {}), "id")
    assert index.state()["version"] == 1  # nothing to publish
    index.add(spark.createDataFrame([(1, None, "alpha"), (2, "beta", None), (None, "alpha", "alpha"), (3, None, None)], "id long, title string, body string"), "id")
    assert [x["key"] for x in index.search("alpha beta").collect()] == [1, 2]
    assert index.search("!?").count() == 0 and index.search("alpha", limit=0).count() == 0
    among = spark.createDataFrame([(2, "r")], "key long, repo string")
    assert [tuple(x)[::2] for x in index.search("alpha beta", among=among, limit=5).collect()] == [(2, "r")]
    for k in (1, 2, 3):
        index.delete(spark.createDataFrame([(k,)], "key long"))
    index.maintain()
    assert index.state()["segments"] == {} and index.search("alpha", limit=2).count() == 0


def test_stems_and_string_keys(spark, tmp_path):
    rows = spark.createDataFrame([("a", "users connecting"), ("b", "a user Café"), ("c", "plain connect connections")], "id string, t string")
    index = segments.build(rows, "id", ["t"], f"file://{tmp_path}/i", stem_words=True, buckets=2)
    plain = search_index.build(rows, "id", ["t"], f"file://{tmp_path}/p", 2, stem_words=True)
    for query in ("connected", "cafe user", "users"):
        assert rounded(index.search(query)) == rounded(search_index.search(plain, query)) == rounded(index.search(query, limit=9))
    index.delete(spark.createDataFrame([("c",)], "key string"))
    fresh = search_index.build(rows.filter("id <> 'c'"), "id", ["t"], f"file://{tmp_path}/q", 2, stem_words=True)
    assert rounded(index.search("connected user")) == rounded(search_index.search(fresh, "connected user"))


def test_second_writer_of_a_version_is_refused(spark, tmp_path):
    index = segments.build(frame(spark, {1: ("a", "alpha")}), "id", ["title", "body"], f"file://{tmp_path}/i")
    old = index.state()
    index.add(frame(spark, {2: ("b", "beta")}), "id")
    with pytest.raises(RuntimeError, match="another writer"):
        index._publish(old)
    (tmp_path / "i/versions/version=4/_temporary").mkdir(parents=True)  # a writer that ended before its file was in place
    index.add(frame(spark, {3: ("c", "gamma")}), "id")
    assert index.state()["version"] == 4 and [x["key"] for x in index.search("gamma").collect()] == [3]


def rows_read(df):
    """Rows that scans of posting arrays gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    read, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        elif node.nodeName().startswith("Scan parquet") and "keys" in node.simpleString(9999):
            read += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.length())]
    return read


def test_top_k_reads_few_of_the_posting_rows(spark, tmp_path, monkeypatch):
    """Long documents and rare uses can't reach the best score, so their stripes are not read."""
    monkeypatch.setattr(segments, "FIRST", 4)
    monkeypatch.setattr(segments, "PAGE_ROWS", 32)
    docs = spark.range(12_000).select(F.col("id"), F.concat(F.lit("common "), F.repeat(F.lit("common "), F.when(F.col("id") % 1000 == 7, 6).otherwise(0)), F.repeat(F.lit("filler "), (F.col("id") % 50).cast("int"))).alias("t"))
    index = segments.build(docs.repartition(4), "id", ["t"], f"file://{tmp_path}/i", stripe=4, buckets=2)
    every, few = index.search("common"), index.search("common", limit=10)
    assert rounded(few) == rounded(every)[:10]
    assert rows_read(few) * 2 < rows_read(every)

"""N-gram joins and vector search against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm import ngram_join, va_search
from tests.llm.test_text import plain_words


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = plain_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids, parent, links = sorted(sets), {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def family(seed, n, length, changes):
    """Texts some edits away from one another, around a passage that all share."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    base = [f"w{r.randrange(10_000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, changes)):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice([[], [f"x{r.randrange(99)}"], [t[i], f"y{r.randrange(99)}"]])
        out.append(" ".join(t + passage * r.randint(0, 1)))
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 1, 2), (1, 1, 1)])
def test_join_is_exact(spark, k, num, den, monkeypatch):
    texts = [None, "", "a", "a", "a b", "A B", " a\tb "]
    for seed, length in enumerate((8, 12, 30, 80, 200)):
        texts += family(seed, 14, length, 6)
    texts += family(9, 8, 2500, 100)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_join(df, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_large_blocks_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_DOCS", 7)
    rows = list(enumerate(family(3, 60, 60, 5)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_join(df, 3, 80, 100).collect()}
    assert got == brute(rows, 3, 80, 100)


@pytest.mark.parametrize("least", [2, 5])
def test_hot_signatures_pass_through(spark, monkeypatch, least):
    """Families around one passage, with exact copies in every partition: signatures that many sets of a batch share are held by no task."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", least)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 4)
    monkeypatch.setattr(ngram_join, "GATHERED", 300)
    texts = [*family(21, 40, 60, 3), *family(22, 20, 25, 3), *family(23, 12, 300, 12)]
    rows = list(enumerate(texts + texts[::3] + texts[:9]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    packed = ngram_join.packed(df, 3, 80, 100, 4)
    assert packed.filter(F.col("bucket") == ngram_join.HOT).count() > 0
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_join(df, 3, 80, 100).collect()}
    assert got == brute(rows, 3, 80, 100)


def test_join_on_messy_rows(messy, empty, spark):
    rows = ngram_join.jaccard_join(messy).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_shingles"] == 0 and by[0]["component_id"] == 0 and by[0]["n_links"] == 0
    assert by[5]["component_id"] == 4 and by[9]["component_id"] == 9 or by[9]["component_id"] == 6
    assert by[7]["component_id"] == 6 and by[7]["n_links"] >= 2  # its two rows of id 6
    assert ngram_join.jaccard_join(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert [r["doc_id"] for r in ngram_join.jaccard_join(nulls).collect()] == [1]


def test_signatures_keep_the_promise():
    import numpy as np

    for num in (50, 80, 90):
        b = ngram_join.Bounds(num, 100)
        for n in (b.first, b.first + 1, 17, 100, 999):
            k = b.class_of(n)
            parts, spare = b.parts(k)
            assert parts - b.difference(b.starts[k] - 1) == spare + 1 if k else True
        assert np.all([b.overlap(a, a) <= a for a in range(1, 50)])


def exact_top(vectors, queries, k):
    out = {}
    for q, a in queries:
        scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), v) for v, b in vectors if v != q))[:k]
        out[q] = [(v, -s) for s, v in scores]
    return out


@pytest.mark.parametrize(("n", "rows", "spread"), [(300, 64, 1.0), (120, 1000, 0.01), (4, 1000, 1.0)])
def test_top_k_is_exact(spark, tmp_path, monkeypatch, n, rows, spread):
    monkeypatch.setattr(va_search, "FILE_ROWS", rows)
    r = random.Random(n)
    data = [(i, [r.gauss(0, spread) for _ in range(8)]) for i in range(n)]
    data[1] = (1, data[0][1])
    bad = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (1050, None)]
    df = spark.createDataFrame([*data, *bad], "vec_id long, embedding array<double>").repartition(3)
    v = va_search.usable(df, 256.0)
    got = {}
    for x in va_search.top_k(v, v.filter("vec_id % 50 = 0"), f"file://{tmp_path}/va", 5).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    import math

    whole = [(i, [math.floor(256 * x) for x in e]) for i, e in data]
    assert got == exact_top(whole, [q for q in whole if q[0] % 50 == 0], 5)


def test_top_k_of_nothing_and_short_vectors(spark, tmp_path):
    v = va_search.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"), 256.0)
    assert va_search.top_k(v, v, f"file://{tmp_path}/a", 5).count() == 0
    v = va_search.usable(spark.createDataFrame([(0, [1.0, 1.0, 5.0]), (1, [2.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>"), 1.0)
    got = va_search.top_k(v, v.filter("vec_id = 0"), f"file://{tmp_path}/b", 5).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(2, 3), (2, 3), (1, 2)]


def test_top_k_query_ties_repeats_and_large_components(spark, tmp_path, monkeypatch):
    """The query itself against brute force: ties, repeated ids, a hot vector, components near and beyond 2 ** 53, clashing columns."""
    import math

    from loomdex.llm.queries import QUERIES

    monkeypatch.setattr(va_search, "FILE_ROWS", 40)
    r = random.Random(3)
    data = [(i, [r.choice([-1.0, 0.0, 0.5]) for _ in range(4)]) for i in range(160)] + [(i, [1.0, 0.5, 0.0, 0.0]) for i in range(160, 260)]
    data += [(300, [2.0**46, 1.0, 2.0**46 + 0.125, 0.0]), (301, [2.0**46, -1.0, 2.0**46, 0.0]), (302, [-(2.0**50), 2.0**49, 1.0, 3.0]), (50, [0.25, 0.0, 0.0, 1.0]), (7, [0.25, 0.0, 0.0, 1.0])]
    rows = [(i, v, 0, 1, "x") for i, v in [*data, (400, None)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int, v string").repartition(3).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {}
    for x in QUERIES["op7_exact_top_k"](spark, f"file://{tmp_path}").orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    whole = [(i, [math.floor(256 * x) for x in e]) for i, e in data]
    asked = {}
    for i, v in whole:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    # 64 bits hold no more
    want = {q: sorted(((max(-(2**63), min(2**63 - 1, s)), v) for v, s in found), key=lambda x: (-x[0], x[1])) for q, found in exact_top(whole, list(asked.items()), 5).items()}
    assert {q: [s for _, s in found] for q, found in got.items()} == {q: [s for s, _ in found] for q, found in want.items()}
    assert {q: v for q, v in got.items() if q < 300} == {q: [(v, s) for s, v in found] for q, found in want.items() if q < 300}


def test_bounds_hold_in_floats():
    import numpy as np

    r = np.random.default_rng(0)
    for scale in (10, 2**30, 2**52, 2**62):
        x = r.integers(-scale, scale, (200, 6))
        cells, edges = va_search.quantised(x)
        lo, width = edges.astype(float)
        q = r.integers(-scale, scale, (20, 6))
        lower, upper = va_search.bounds(q.astype(float), lo + cells * width, lo + cells * width + width - 1)
        exact = q.astype(object) @ x.T.astype(object)
        assert all(int(lower[i, j]) <= exact[i, j] + 1 and exact[i, j] <= int(upper[i, j]) + 1 for i in range(20) for j in range(200))

"""Searches of the vector index against every distance computed."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import vector_index


def plain(rows, queries, k, metric, keep=lambda key, label: True, others=False):
    def distance(a, b):
        if metric == "l2":
            return math.dist(a, b)
        size = math.hypot(*a) * math.hypot(*b)
        return 1 - (sum(x * y for x, y in zip(a, b)) / size if size else 0.0)

    out = []
    for i, q in queries:
        near = sorted((round(distance(v, q), 9), key) for key, v, label in rows if keep(key, label) and not (others and key == i))[:k]
        out += [(i, r + 1, key, d) for r, (d, key) in enumerate(near)]
    return sorted(out)


def points(seed, n, dims, groups=12):
    r = random.Random(seed)
    middles = [[r.gauss(0, 5) for _ in range(dims)] for _ in range(groups)]
    return [(i, [x + r.gauss(0, 0.3) for x in middles[i % groups]], i % 3) for i in range(n)]


def got(found):
    return sorted((r["query_id"], r["rank"], r["key"], round(r["distance"], 9)) for r in found.rows.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_with_few_cells_read(spark, tmp_path, metric):
    rows = points(1, 900, 5)
    rows += [(1000 + i, rows[4][1], 1) for i in range(40)] + [(2000, [0.0] * 5, 0)]  # copies beyond k, and no direction
    table = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(4)
    index = vector_index.build(table, "id", "v", f"file://{tmp_path}/i", 5, metric, keep=["label"])
    queries = [(i, v) for i, v, _ in rows[:6]] + [(5000, [0.0] * 5), (5001, [100.0] * 5)]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    found = index.search(asked, 7)
    assert got(found) == plain(rows, queries, 7, metric)
    filtered = index.search(asked, 7, F.col("label") == 2, others=True)
    assert got(filtered) == plain(rows, queries, 7, metric, lambda key, label: label == 2, True)
    assert got(index.search(asked, 5000)) == plain(rows, queries, 5000, metric)
    one = index.search(asked.filter("query_id = 1"), 5)
    assert got(one) == plain(rows, queries[1:2], 5, metric) and one.cells_read * 3 < one.cells and one.vectors_read * 3 < one.vectors


def test_added_batches_and_blocks_of_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    rows = points(2, 300, 4)
    table = spark.createDataFrame(rows, "id long, v array<double>, label int")
    index = vector_index.build(table.filter("id < 200"), "id", "v", f"file://{tmp_path}/i", 4).add(table.filter("id >= 200 and id < 250"), "1").add(table.filter("id >= 250"), "2").add(table.filter("id >= 250"), "2")
    queries = [(i, v) for i, v, _ in rows[::30]]
    assert got(index.search(spark.createDataFrame(queries, "query_id long, embedding array<double>"), 4)) == plain(rows, queries, 4, "l2")


def test_edges(spark, tmp_path):
    fields = "id string, v array<float>, label int"
    bad = [("a", None, 0), (None, [1.0, 2.0], 0), ("c", [float("nan"), 1.0], 0), ("d", [1.0], 0), ("e", [None, 1.0], 0)]
    asked = spark.createDataFrame([("q", [1.0, 1.0]), ("bad", [1.0]), ("none", None)], "query_id string, embedding array<double>")
    for n, rows in enumerate(([], bad)):
        index = vector_index.build(spark.createDataFrame(rows, fields), "id", "v", f"file://{tmp_path}/{n}", 2)
        assert index.search(asked, 3).rows.count() == 0
    index = vector_index.build(spark.createDataFrame([*bad, ("x", [1.0, 1.0], 0), ("y", [4.0, 5.0], 0)], fields), "id", "v", f"file://{tmp_path}/x", 2)
    assert got(index.search(asked, 3)) == [("q", 1, "x", 0.0), ("q", 2, "y", 5.0)]

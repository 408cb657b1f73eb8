"""Centroid clustering against plain integer arithmetic."""

import hashlib
import random

import numpy as np
import pytest

from loomdex.llm import centroids

FIELDS = "vec_id long, embedding array<float>, label int, cluster string, v int, x string"


def plain(rows, k, rounds):
    """(id, components) of usable rows -> what ``cluster`` returns, without arrays."""
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    now = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(now)):
            if mine := [v for (_, v), o in zip(rows, own) if o == j]:
                now[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [near(v) for _, v in rows]
    by = [sum(d for d, c in found if c == j) for j in range(len(now))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i is not None, i or 0), c, d, by[c], sum(by), digest[c]) for (i, _), (d, c) in zip(rows, found))


def got(df):
    return sorted(((r["vec_id"] is not None, r["vec_id"] or 0), *r[1:]) for r in df.collect())


def hard_rows(r, dims, scale):
    rows = [(i, [r.uniform(-scale, scale) for _ in range(dims)]) for i in range(300)]
    rows += [rows[7], (7, rows[8][1]), (None, rows[9][1]), (400, rows[9][1])]  # copies, a repeated id, a null id
    return rows


@pytest.mark.parametrize("scale", [1.0, 5e5])
def test_against_plain_arithmetic(spark, scale):
    r = random.Random(4)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in hard_rows(r, 6, scale)]
    bad = [(500, None), (501, [float("nan")] * 6), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [float("inf")] * 6), (504, []), (505, [1.0] * 7)]
    table = spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows + bad], FIELDS).repartition(5)
    whole = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows]
    assert got(centroids.cluster(centroids.usable(table, 6, 64.0), 5, 3)) == plain(whole, 5, 3)


def test_ties_few_rows_and_empty_clusters(spark):
    rows = [(i, [float(i % 2)] * 3) for i in range(9)]
    table = spark.createDataFrame([(i, v, 0, "", 0, "") for i, v in rows], FIELDS)
    own = centroids.usable(table, 3, 64.0)
    whole = [(i, [int(64 * x) for x in v]) for i, v in rows]
    assert got(centroids.cluster(own, 4, 3)) == plain(whole, 4, 3)  # equal starts: the later ones stay empty
    assert got(centroids.cluster(own, 50, 2)) == plain(whole, 50, 2)
    assert centroids.cluster(own.limit(0), 4, 3).count() == 0


def test_products_are_exact_up_to_the_bound_and_beyond_it():
    r = np.random.default_rng(2)
    for most in (10, 2**21, 2**22, 2**40, 2**62):
        x, c = r.integers(-most, most, (50, 8)), r.integers(-most, most, (4, 8)).tolist()
        want = [min((sum((a - b) ** 2 for a, b in zip(v, o)), j) for j, o in enumerate(c)) for v in x.tolist()]
        cluster, distance = centroids.nearest(x, c)
        assert [(int(d), int(j)) for d, j in zip(distance, cluster)] == want
        total = centroids.sums(x, cluster, 4)
        assert total.tolist() == [[*(sum(col) for col in zip(*([[0] * 8] + [v for v, j in zip(x.tolist(), cluster) if j == i]))), int((cluster == i).sum())] for i in range(4)]


def test_saturation(spark):
    table = spark.createDataFrame([(1, [3e38], 0, "", 0, ""), (2, [-3e38], 0, "", 0, "")], FIELDS)
    out = {r["vec_id"]: r for r in centroids.cluster(centroids.usable(table, 1, 64.0), 1, 1).collect()}
    assert out[1]["distance"] == out[1]["inertia"] == 2**63 - 1

"""The positional rank against known values and its definition in plain code."""

import math
import random

import numpy as np
import pytest

from loomdex.operators import ts_rank

FIELDS = "id long, title string, body string"


def one(x):
    return [np.array(x)]


def test_known_values():
    """Values that the database gives."""
    w = np.array([0.1])
    assert round(ts_rank.each([w], 1), 8) == 0.06079271
    assert round(ts_rank.together(one([1]) + one([2]), [w, w]), 7) == 0.0991032
    assert round(ts_rank.normalised(0.0607927, 3, 3, ts_rank.SELF), 6) == round(0.0607927 / 1.0607927, 6)


def plain(docs, terms, weights, flags, every):
    """The definition's loops."""
    out = {}
    for key, *fields in docs:
        places, at, n = {}, 0, 0
        for label, text in zip("AD", fields):
            for word in (text or "").split():
                at += 1
                own = places.setdefault(word, {})
                own[min(at, 16383)] = max(own.get(min(at, 16383), 0), weights[label])
        places = {w: sorted(p.items())[:256] for w, p in places.items()}
        n = sum(len(p) for p in places.values())
        found = [places[t] for t in terms if t in places]
        if not found or (every and len(found) < len(terms)):
            continue
        res = -1.0
        if every and len(terms) > 1:
            for i in range(len(found)):
                for k in range(i):
                    for p, a in found[i]:
                        for q, b in found[k]:
                            if d := abs(p - q):
                                cur = math.sqrt(a * b * (1e-30 if d > 100 else 1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                                res = cur if res < 0 else 1.0 - (1.0 - res) * (1.0 - cur)
            res = 1e-20 if res < 0 else res
        else:
            res = 0.0
            for own in found:
                total, best, at_best = 0.0, -1.0, 0
                for j, (_, a) in enumerate(own):
                    total += a / ((j + 1) * (j + 1))
                    if a > best:
                        best, at_best = a, j
                res += (best + total - best / ((at_best + 1) * (at_best + 1))) / 1.64493406685
            res /= len(terms)
        if flags & 1:
            res /= math.log(n + 1) / math.log(2)
        if flags & 2:
            res /= n
        if flags & 8:
            res /= len(places)
        if flags & 16:
            res /= math.log(len(places) + 1) / math.log(2)
        out[key] = round(res / (res + 1) if flags & 32 else res, 9)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def docs():
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "xx"] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 4))), " ".join(r.choices(words, k=r.choice([0, 3, 40, 300])))) for i in range(80)]
    return [*rows, (100, None, None), (101, "alpha", "beta " * 400 + "alpha"), (102, None, "xx " * 17_000 + "alpha beta gamma"), (103, "gamma", "alpha")]


def test_search(spark, docs, tmp_path):
    index = ts_rank.build(spark.createDataFrame(docs, FIELDS).repartition(3), "id", {"title": "A", "body": "D"}, f"file://{tmp_path}/i", 4)
    for query, flags, every in (("alpha", 0, True), ("alpha beta", 0, True), ("beta alpha gamma", 2, True), ("alpha beta", 1 | 16, False), ("gamma absent", 8, False), ("gamma absent", 0, True), ("alpha", 32, True)):
        got = [(r["key"], round(r["rank"], 9)) for r in index.search(query, every, flags=flags).collect()]
        assert got == plain(docs, sorted(query.split()), ts_rank.WEIGHTS, flags, every), query
    some = spark.createDataFrame([(101, "r"), (5, "s"), (100, "t")], "key long, repo string")
    assert {r["key"]: r["repo"] for r in index.search("alpha", among=some).collect()}[101] == "r"
    assert index.search("!?").count() == 0


def test_stems_and_no_rows(spark, tmp_path):
    index = ts_rank.build(spark.createDataFrame([(1, "Connecting users", "x"), (2, "connect", "user")], FIELDS), "id", {"title": "B", "body": "C"}, f"file://{tmp_path}/s", stem_words=True)
    assert [r["key"] for r in index.search("connected user").collect()] == [1, 2]
    assert ts_rank.build(spark.createDataFrame([], FIELDS), "id", {"title": "A"}, f"file://{tmp_path}/e").search("x y").count() == 0

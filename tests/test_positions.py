"""Positions in a large order against windows over all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdex.operators import positions, retrieval


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [(i, r.choice([None, 1, 2, 2, 2, 7]), r.choice([None, 0, 3, 50])) for i in range(500)]
    return spark.createDataFrame(data, "id long, v int, cost int").repartition(7)


def test_ranks_and_running_sums(rows):
    order = [F.col("v").desc_nulls_last(), "id"]
    w = Window.orderBy(*order)
    want = {r["id"]: (r["n"], r["s"]) for r in rows.withColumns({"n": F.row_number().over(w) - 1, "s": F.sum(F.coalesce("cost", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))}).collect()}
    assert {r["id"]: r["rank"] for r in positions.numbered(rows, order).collect()} == {k: v[0] for k, v in want.items()}
    assert {r["id"]: r["running"] for r in positions.running(rows, order, F.col("cost")).collect()} == {k: v[1] for k, v in want.items()}
    assert sorted(r["rank"] for r in positions.numbered(rows, ["v"]).collect()) == list(range(500))  # ties in any order, but one


def test_pages(rows):
    ordered = [r["id"] for r in rows.orderBy(F.desc("id")).collect()]
    for number in (1, 3, 20, 21):
        own, pages = positions.page(rows, [F.desc("id")], number, 25)
        assert pages == 20 and [r["id"] for r in own.collect()] == ordered[(number - 1) * 25 : number * 25]
    with pytest.raises(ValueError):
        positions.page(rows, ["id"], 0, 25)


@pytest.mark.parametrize("most", [0, 120, 3000, 10**9])
def test_budgets(rows, most):
    order = [F.col("v").asc_nulls_last(), F.desc("id")]
    want = retrieval.token_budget(rows, order, F.coalesce("cost", F.lit(0)), most)
    got = positions.budget(rows, order, F.col("cost"), most)
    assert got.columns == rows.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty(rows):
    none = rows.limit(0)
    assert positions.numbered(none, ["id"]).count() == 0 and positions.running(none, ["id"], F.col("cost")).count() == 0
    own, pages = positions.page(none, ["id"], 1, 10)
    assert pages == 0 and own.count() == 0


def test_no_task_has_all_rows(rows):
    plan = positions.numbered(rows, ["id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan

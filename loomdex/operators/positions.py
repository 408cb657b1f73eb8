"""Positions in a large order: ranks, pages and running sums without a window over all rows.

Rows are dealt into ranges of the order and sorted in each, which is what a global sort does, and written.  The ranges' counts and sums, a row each, are gathered, and
what lies before a range is added to what lies before a row in it.  An order should decide between all rows; among rows that it leaves equal any order may come out, but one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.names import fresh
from loomdex.plans.lineage import cut

#: How many rows a partition's part of ``monotonically_increasing_id`` has room for.
_PART = 1 << 33


def _ordered(rows: DataFrame, order: Sequence[Column | str], number: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()))


def _before(totals: dict[int, float | int], part: Column, zero: Column) -> Column:
    """What all ranges before one add up to."""
    ahead, sums = 0, {}
    for p in sorted(totals):
        sums[p] = ahead
        ahead += totals[p]
    entries = [x for p, s in sums.items() for x in (F.lit(p), F.lit(s))]
    return F.coalesce(F.create_map(*entries)[part], zero) if entries else zero


def numbered(rows: DataFrame, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """``rows`` with their rank from 0 in the order, in as many tasks as there are shuffle partitions."""
    n = fresh([*rows.columns, rank], "_number")["_number"]
    ordered = _ordered(rows, order, n)
    part = F.floor(F.col(n) / _PART)
    counts = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    return ordered.withColumn(rank, _before(counts, part, F.lit(0).cast("long")) + F.pmod(F.col(n), F.lit(_PART))).drop(n)


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int) -> tuple[DataFrame, int]:
    """The rows of page ``number``, from 1, in order, and how many pages there are."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    placed = numbered(rows, order, "_rank")
    total = placed.count()
    own = placed.filter(F.col("_rank").between((number - 1) * size, number * size - 1))
    return own.orderBy("_rank").drop("_rank"), -(-total // size)


def running(rows: DataFrame, order: Sequence[Column | str], cost: Column, total: str = "running") -> DataFrame:
    """``rows`` with the sum of an integer ``cost``, null counting 0, over the rows up to and with each one."""
    names = fresh([*rows.columns, total], "_number", "_cost")
    n, c = names["_number"], names["_cost"]
    ordered = _ordered(rows.withColumn(c, F.coalesce(cost, F.lit(0)).cast("long")), [*order], n)
    part = F.floor(F.col(n) / _PART)
    sums = {r["part"]: r["s"] for r in ordered.groupBy(part.alias("part")).agg(F.sum(c).alias("s")).collect()}  # a row a partition
    here = Window.partitionBy(part).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn(total, _before(sums, part, F.lit(0).cast("long")) + F.sum(c).over(here)).drop(n, c)


def budget(rows: DataFrame, order: Sequence[Column | str], cost: Column, most: int) -> DataFrame:
    """As ``retrieval.token_budget``, of any number of rows: in order while their running cost, none of it negative, is within ``most``; the first row always."""
    names = fresh(rows.columns, "_rank", "_sum")
    rank, total = names["_rank"], names["_sum"]
    placed = running(numbered(rows, order, rank), [rank], cost, total)
    return placed.filter((F.col(rank) == 0) | (F.col(total) <= most)).drop(rank, total)

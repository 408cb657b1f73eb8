"""Snapshot and version differences, overlays and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.plans.lineage import cut


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, status)``: added, removed, changed or unchanged."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "full")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(*keys, status.alias("status"))


def breaking_risk(diff: DataFrame) -> DataFrame:
    """One row: counts by status and ``high`` if anything was removed or changed."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")}
    return diff.agg(*n.values()).withColumn("breaking_risk", F.when(F.col("removed") + F.col("changed") > 0, "high").otherwise("low"))


def capped(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], most: int) -> DataFrame:
    """At most ``most`` rows of each category, with the category's full number as ``total``: a report's feature, not a filter."""
    w = Window.partitionBy(*by)
    out = rows.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "total": F.count(F.lit(1)).over(w)})
    return out.filter(F.col("_rn") <= most).drop("_rn")


def overlay(rows: DataFrame, key: str, scope: str, priority: Sequence[str]) -> DataFrame:
    """One row a key: that of the last scope in ``priority``."""
    level = F.array_position(F.array(*map(F.lit, priority)), F.col(scope))
    w = Window.partitionBy(key).orderBy(level.desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def version_drift(installed: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(manager, name, installed, status)``: up_to_date, outdated (other versions are indexed) or not_indexed."""
    have = indexed.groupBy("manager", "name").agg(F.collect_set("version").alias("versions"))
    status = F.when(F.col("versions").isNull(), "not_indexed").when(F.array_contains("versions", F.col("version")), "up_to_date").otherwise("outdated")
    return installed.join(have, ["manager", "name"], "left").select("manager", "name", F.col("version").alias("installed"), status.alias("status"))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def distinct_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.dropDuplicates([src, dst])


def ordinal_ids(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Second and later rows of a key get ``~1``, ``~2``, ... behind it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn(key, F.when(n > 0, F.concat(F.col(key), F.lit("~"), n.cast("string"))).otherwise(F.col(key)))


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _grams(text: Column) -> Column:
    """Distinct pieces, of up to three characters, of the text."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)))

    def pieces(n: int) -> Column:
        return F.transform(at, lambda i: F.substr(text, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *map(pieces, (1, 2, 3))))


def _keys(part: Column, wild: bool) -> Column:
    """Of the pieces of a text that whatever contains it contains too, those of the greatest length up to three characters; ``_`` and ``%`` may be no character of theirs."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(part)))

    def pieces(n: int) -> Column:
        own = F.filter(F.transform(at, lambda i: F.substr(part, i, F.lit(n))), lambda x: F.length(x) == n)
        return F.array_distinct(F.filter(own, lambda x: ~x.rlike("[_%]")) if wild else own)

    three, two, one = map(pieces, (3, 2, 1))
    return F.when(F.size(three) > 0, three).when(F.size(two) > 0, two).when(F.size(one) > 0, one).otherwise(F.array(F.lit("")))


def containing(whole: DataFrame, part: DataFrame, wild: bool = False) -> DataFrame:
    """``(whole, part)`` of the distinct texts where one contains the other, or with ``wild`` is LIKE something with the other in it.

    The two meet by the part's rarest three characters, counted over all wholes, and are then compared; so a beginning that all have in common
    brings nothing together, and a part with characters that no whole has meets none.
    """
    sought = cut(part.select("part", F.explode(_keys(F.col("part"), wild)).alias("gram")))
    grams = whole.select("whole", F.explode(_grams(F.col("whole"))).alias("gram"))
    met = cut(grams.join(sought.select("gram").distinct(), "gram", "left_semi"))
    uses = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = sought.join(uses, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    test = F.expr("whole LIKE concat('%', replace(part, '\\\\', '\\\\\\\\'), '%')") if wild else F.contains("whole", F.col("part"))
    return met.join(rarest, "gram").filter(test).select("whole", "part")

"""Mutations as functions from DataFrames to DataFrames; writing the result is the caller's step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delete(base: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; unknown counts as not true."""
    return base.filter(~F.coalesce(condition, F.lit(False)))


def update(base: DataFrame, condition: Column, **values) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    return base.withColumns({c: F.when(hit, v.cast(base.schema[c].dataType)).otherwise(F.col(c)) for c, v in new.items()})


def increment(base: DataFrame, condition: Column, column: str, amount=1, **extra) -> DataFrame:
    return update(base, condition, **{column: F.col(column) + amount}, **extra)


def decrement(base: DataFrame, condition: Column, column: str, amount=1, **extra) -> DataFrame:
    return increment(base, condition, column, -amount, **extra)


def last_wins(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row with the highest ``position`` of each key, without that column."""
    w = Window.partitionBy(*keys).orderBy(F.col(position).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", position)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Insert new keys; of known ones replace ``columns`` (all but the keys by default).  Keys of ``incoming`` are distinct."""
    columns = [c for c in incoming.columns if c not in keys] if columns is None else list(columns)
    new = incoming.withColumn("_new", F.lit(True))
    joined = base.withColumn("_old", F.lit(True)).alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"o.{c}", f"n.{c}")
        if c not in incoming.columns:
            return F.col(f"o.{c}")
        taken = F.col("_new") if c in columns else F.col("_old").isNull()
        return F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[pick(c).alias(c) for c in base.columns])


def insert_or_ignore(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.unionByName(incoming.join(base, _same(incoming, base, keys), "left_anti"), allowMissingColumns=True)


def insert_or_replace(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(incoming, _same(base, incoming, keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def first_or_create(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return insert_or_ignore(base, incoming, keys)


def update_or_create(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return upsert(base, incoming, keys)


def bulk_upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``upsert`` of rows that may repeat a key: the one with the highest ``position`` wins."""
    return upsert(base, last_wins(incoming, keys, position), keys, columns)


def bulk_update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set the columns of ``changes`` by key; a null there is written too."""
    new = changes.withColumn("_hit", F.lit(True)).alias("n")
    joined = base.alias("o").join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in changes.columns and c != key else F.col(f"o.{c}") for c in base.columns])


def add_counters(base: DataFrame, increments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive merge: counters of equal keys are summed, missing ones count 0."""
    counters = [c for c in base.columns if c not in keys]
    both = base.unionByName(increments, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def attach(pivot: DataFrame, links: DataFrame) -> DataFrame:
    return insert_or_ignore(pivot, links.distinct(), pivot.columns)


def detach(pivot: DataFrame, links: DataFrame) -> DataFrame:
    return pivot.join(links, list(links.columns), "left_anti")


def cascade(parents: DataFrame, children: Sequence[tuple[str, DataFrame, str]], key: str = "id") -> dict[str, DataFrame]:
    """Each child table without the rows of the deleted ``parents``; ``children`` are (name, rows, foreign key)."""
    gone = parents.select(F.col(key).alias("_gone")).distinct()
    return {name: rows.join(gone, rows[fk] == gone["_gone"], "left_anti") for name, rows, fk in children}


def cascade_tree(parents: DataFrame, levels: Sequence[tuple[str, DataFrame, str, str | None]], key: str = "id") -> dict[str, DataFrame]:
    """Each table of a chain without what hangs on the deleted ``parents``; ``levels`` are (name, rows, foreign key, own key), each on the one before."""
    gone, out = parents.select(F.col(key).alias("_gone")).distinct(), {}
    for name, rows, fk, own in levels:
        out[name] = rows.join(gone, F.col(fk) == F.col("_gone"), "left_anti")
        if own is not None:
            gone = rows.join(gone, F.col(fk) == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone")).distinct()
    return out


def dirty(base: DataFrame, edited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, changed, is_new)`` of edited rows that differ from the stored ones: the names of the columns that do."""
    columns = [c for c in edited.columns if c not in keys]
    stored = base.select(*[F.col(c).alias(f"_{c}") for c in [*keys, *columns]]).withColumn("_known", F.lit(True))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    joined = edited.join(stored, on, "left")
    names = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]), lambda n: n.isNotNull())
    out = joined.select(*keys, names.alias("changed"), F.col("_known").isNull().alias("is_new"))
    return out.filter(F.col("is_new") | (F.size("changed") > 0))


def save(base: DataFrame, edited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the edited rows that are new or differ; equal ones are not written anew."""
    changed = edited.join(dirty(base, edited, keys).select(*keys), list(keys), "left_semi").select(*edited.columns)
    return upsert(base, changed, keys)

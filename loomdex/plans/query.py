"""An immutable fluent query over DataFrames; Catalyst does the planning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.operators.predicates import Conditions


#: Logical plans of compiled queries while the log is on.
QUERY_LOG: list[str] | None = None


def enable_query_log() -> None:
    global QUERY_LOG
    QUERY_LOG = []


def query_log(stop: bool = False) -> list[str]:
    """The plans logged so far."""
    global QUERY_LOG
    found = list(QUERY_LOG or ())
    if stop:
        QUERY_LOG = None
    return found


@dataclass(frozen=True)
class Relation:
    """How a table's rows relate to those of ``other``: belongs_to, has_many, has_one or belongs_to_many (over ``pivot``)."""

    kind: str
    other: DataFrame
    local: str
    foreign: str
    pivot: DataFrame | None = None
    pivot_local: str = ""
    pivot_foreign: str = ""

    def keys(self) -> DataFrame:
        """Distinct local keys that have a related row, as ``_key``."""
        if self.pivot is None:
            return self.other.select(F.col(self.foreign).alias("_key")).filter("_key IS NOT NULL").distinct()
        matched = self.pivot.join(self.other, self.pivot[self.pivot_foreign] == self.other[self.foreign], "left_semi")
        return matched.select(F.col(self.pivot_local).alias("_key")).filter("_key IS NOT NULL").distinct()

    #: Relations of ``other``'s own rows, for nested loading ("a.b").
    relations: dict[str, Relation] | None = None

    def related(self, *nested: str) -> DataFrame:
        """Related rows, with their own ``nested`` relations loaded, and the local key they belong to, as ``_key``."""
        other = Query(self.other, relations=self.relations).with_(*nested).df() if nested else self.other
        if self.pivot is None:
            return other.withColumn("_key", F.col(self.foreign))
        link = self.pivot.select(F.col(self.pivot_local).alias("_key"), F.col(self.pivot_foreign).alias("_other"))
        return other.join(link, F.col(self.foreign) == F.col("_other")).drop("_other")


class Agg:
    """Aggregate factories; sums, averages and extremes of nothing are 0."""

    @staticmethod
    def sum(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    @staticmethod
    def avg(c: str) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    @staticmethod
    def max(c: str) -> Column:
        return F.max(c)

    @staticmethod
    def min(c: str) -> Column:
        return F.min(c)

    @staticmethod
    def count(c: str = "*", distinct: bool = False) -> Column:
        return F.count_distinct(F.col(c)) if distinct else F.count(F.lit(1) if c == "*" else F.col(c))


@dataclass(frozen=True)
class Page:
    data: DataFrame
    total: int
    page: int
    per_page: int

    @property
    def pages(self) -> int:
        return max(1, math.ceil(self.total / self.per_page))


@dataclass(frozen=True)
class Query:
    """Selections, conditions, joins, grouping, order and limits; ``df()`` compiles them.

    Every condition method of ``Conditions`` (where, or_where_in, where_group, ...) is a method here.
    """

    base: DataFrame
    relations: dict[str, Relation] | None = None
    scopes: dict[str, Callable[..., Query]] | None = None
    conditions: Conditions = Conditions()
    joins: tuple[tuple[str, str, DataFrame, Column], ...] = ()
    columns: tuple[str | Column, ...] = ()
    groups: tuple[str | Column, ...] = ()
    havings: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()
    most: int | None = None
    skip: int = 0
    eager: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def __getattr__(self, name: str):
        if name.startswith(("where", "or_where")) and hasattr(Conditions, name):
            return lambda *a, **k: replace(self, conditions=getattr(self.conditions, name)(*a, **k))
        if not name.startswith("_") and name in (object.__getattribute__(self, "scopes") or {}):
            return lambda *a, **k: self.scopes[name](self, *a, **k)
        raise AttributeError(name)

    # projection and order
    def select(self, *columns: str | Column) -> Query:
        return replace(self, columns=(*self.columns, *columns))

    def select_raw(self, expression: str) -> Query:
        return replace(self, columns=(*(self.columns or ("*",)), F.expr(expression)))

    def order_by(self, column: str | Column, direction: str = "asc") -> Query:
        c = F.col(column) if isinstance(column, str) else column
        return replace(self, order=(*self.order, c.desc() if direction.lower() == "desc" else c.asc()))

    def order_by_desc(self, column: str | Column) -> Query:
        return self.order_by(column, "desc")

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def for_page(self, page: int, per_page: int = 15) -> Query:
        return replace(self, most=per_page, skip=(page - 1) * per_page)

    def when(self, condition: Any, build: Callable[[Query], Query]) -> Query:
        return build(self) if condition else self

    # joins
    def join(self, name: str, other: DataFrame, on: Column, how: str = "inner") -> Query:
        """Join ``other`` under ``name``; the same (how, name) twice counts once."""
        if any((h, n) == (how, name) for h, n, _, _ in self.joins):
            return self
        return replace(self, joins=(*self.joins, (how, name, other.alias(name), on)))

    def left_join(self, name: str, other: DataFrame, on: Column) -> Query:
        return self.join(name, other, on, "left")

    def _filtered_by(self, other: DataFrame, on: Callable[[DataFrame, DataFrame], Column], how: str) -> Query:
        return replace(self, steps=(*self.steps, lambda df: df.join(other, on(df, other), how)))

    def where_exists(self, other: DataFrame, on: Column) -> Query:
        return self._filtered_by(other, lambda *_: on, "left_semi")

    def where_in_subquery(self, column: str, other: DataFrame) -> Query:
        keys = other.toDF("_in")
        return self._filtered_by(keys, lambda *_: F.col(column) == F.col("_in"), "left_semi")

    def where_not_in_subquery(self, column: str, other: DataFrame) -> Query:
        """NOT IN: a null among the values leaves no rows, an empty list all.

        Two emptiness checks at compile time leave a plain anti join, which needs no broadcast of the values.
        """
        keys = other.toDF("_in")

        def step(df: DataFrame) -> DataFrame:
            if not keys.filter("_in IS NULL").isEmpty():
                return df.limit(0)
            if keys.isEmpty():
                return df
            return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_in"), "left_anti")

        return replace(self, steps=(*self.steps, step))

    def _relation(self, name: str) -> Relation:
        if not self.relations or name not in self.relations:
            raise ValueError(f"unknown relation: {name!r}")
        return self.relations[name]

    def has(self, relation: str) -> Query:
        r = self._relation(relation)
        return self._filtered_by(r.keys(), lambda *_: F.col(r.local) == F.col("_key"), "left_semi")

    def doesnt_have(self, relation: str) -> Query:
        r = self._relation(relation)
        return self._filtered_by(r.keys(), lambda *_: F.col(r.local) == F.col("_key"), "left_anti")

    def with_(self, *relations: str) -> Query:
        return replace(self, eager=(*self.eager, *relations))

    def with_count(self, *relations: str) -> Query:
        return replace(self, counts=(*self.counts, *relations))

    # grouping
    def group_by(self, *columns: str | Column) -> Query:
        return replace(self, groups=(*self.groups, *columns))

    def having(self, condition: str | Column) -> Query:
        return replace(self, havings=(*self.havings, F.expr(condition) if isinstance(condition, str) else condition))

    # compilation
    def rows(self) -> DataFrame:
        """Joined and filtered rows, before projection and limits."""
        df = self.base
        for how, _, other, on in self.joins:
            df = df.join(other, on, how)
        df = self.conditions.apply(df)
        for step in self.steps:
            df = step(df)
        return df

    def _loaded(self, df: DataFrame) -> DataFrame:
        for name in self.counts:
            r = self._relation(name)
            if r.kind not in ("has_many", "belongs_to_many"):
                raise ValueError(f"{name!r} can't be counted")
            n = r.related().groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
            df = df.join(n, df[r.local] == n["_key"], "left").withColumn(f"{name}_count", F.coalesce("_n", F.lit(0))).drop("_key", "_n")
        nested: dict[str, list[str]] = {}
        for path in self.eager:
            name, _, rest = path.partition(".")
            nested.setdefault(name, []).extend([rest] if rest else [])
        for name, inner in nested.items():
            r = self._relation(name)
            own = r.related(*inner)
            row = F.struct(*[own[c] for c in own.columns if c != "_key"])
            if r.kind in ("has_many", "belongs_to_many"):
                got = own.groupBy("_key").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
                df = df.join(got, df[r.local] == got["_key"], "left").withColumn(name, F.coalesce("_rows", F.array().cast(got.schema["_rows"].dataType))).drop("_key", "_rows")
            else:
                got = own.groupBy("_key").agg(F.min(row).alias("_row"))
                df = df.join(got, df[r.local] == got["_key"], "left").withColumnRenamed("_row", name).drop("_key")
        return df

    def df(self) -> DataFrame:
        df = self._compiled()
        if QUERY_LOG is not None:
            QUERY_LOG.append(df._jdf.queryExecution().logical().toString())
        return df

    def _compiled(self) -> DataFrame:
        df = self._loaded(self.rows())
        distinct = bool(self.columns) and isinstance(self.columns[0], str) and self.columns[0].upper().startswith("DISTINCT ")
        columns = [self.columns[0][9:], *self.columns[1:]] if distinct else list(self.columns)
        if self.order and columns and not distinct:
            df = df.orderBy(*self.order)
        if columns:
            df = df.select(*[F.expr(c) if isinstance(c, str) and c != "*" else c for c in columns])
        if distinct:
            df = df.distinct()
        if self.order and (not columns or distinct):
            df = df.orderBy(*self.order)
        df = df.offset(self.skip) if self.skip else df
        return df if self.most is None else df.limit(self.most)

    def to_subquery(self, column: str) -> DataFrame:
        """The query's values of one column, for ``where_in_subquery``."""
        return replace(self, columns=(column,), order=(), eager=(), counts=()).df()

    def to_plan(self, mode: str = "formatted") -> str:
        """Text of the compiled plan, Spark's counterpart of the SQL text."""
        df = self.df()
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    # results
    def aggregates(self, **named: Column) -> DataFrame:
        """One row of aggregates, or one a group; numbers of nothing are 0."""
        out = self.rows().groupBy(*self.groups).agg(*[c.alias(n) for n, c in named.items()])
        for h in self.havings:
            out = out.filter(h)
        numeric = {n: 0 for n in named if dict(out.dtypes)[n] not in ("string", "date", "timestamp", "timestamp_ntz")}
        out = out.fillna(numeric) if numeric else out
        return out.orderBy(*self.order) if self.order else out

    def count(self) -> int:
        return self.rows().count()

    def grouped_count(self) -> DataFrame:
        return self.aggregates(count=F.count(F.lit(1)))

    def scalar(self, aggregate: Column) -> Any:
        return self.rows().agg(F.coalesce(aggregate, F.lit(0))).head()[0]

    def exists(self) -> bool:
        return not self.rows().isEmpty()

    def pluck(self, column: str) -> DataFrame:
        return replace(self, columns=(column,)).df()

    def first(self):
        return self.limit(1).df().head()

    def find(self, key: Any, column: str = "id"):
        return replace(self, conditions=self.conditions.where(column, key)).first()

    def find_or_fail(self, key: Any, column: str = "id"):
        if (row := self.find(key, column)) is None:
            raise LookupError(f"no row with {column} = {key!r}")
        return row

    def paginate(self, page: int = 1, per_page: int = 15) -> Page:
        return Page(self.for_page(page, per_page).df(), self.count(), page, per_page)

    def chunk(self, size: int) -> Iterator[list]:
        """Lists of ``size`` rows in order, streamed partition by partition."""
        held: list = []
        for row in self.df().toLocalIterator():
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

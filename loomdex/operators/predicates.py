"""Predicate algebra with SQL precedence and three-valued logic."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """Anchored Java regex of a case-sensitive glob: ``*`` any run, ``?`` any character, ``[...]`` a class, ``[^...]`` its complement."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "^"))) > 0:
            body = glob[i + 1 : end]
            lead = "^" if body[:1] == "^" else ""
            out.append("[" + lead + re.sub(r"([\\\[&~^])", r"\\\1", body[len(lead) :]) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s/])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(c: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters alone; a backslash in the pattern is a backslash."""
    return F.translate(c.cast("string"), UPPER, LOWER).like(pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\"))


def _is(c: Column, v: Any) -> Column:
    return c.isNull() if v is None else c == v


def _is_not(c: Column, v: Any) -> Column:
    return c.isNotNull() if v is None else c != v


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": _is,
    "is": _is,
    "!=": _is_not,
    "<>": _is_not,
    "is not": _is_not,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "like": lambda c, v: like(c, v),
    "not like": lambda c, v: ~like(c, v),
    "like binary": lambda c, v: c.like(v),
    "glob": lambda c, v: c.rlike(glob_pattern(v)),
    "in": lambda c, v: is_in(c, v),
    "not in": lambda c, v: ~is_in(c, v) if list(v) else F.lit(True),
}
_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*")


def column(name: str | Column) -> Column:
    if isinstance(name, Column):
        return name
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a column name: {name!r}")
    return F.col(name)


def is_in(c: Column, values: Iterable) -> Column:
    """IN with an empty list being false."""
    values = list(values)
    return c.isin(values) if values else F.lit(False)


def compare(name: str | Column, op: str, value: Any) -> Column:
    made = OPERATORS.get(op.strip().lower())
    if made is None:
        raise ValueError(f"unknown operator: {op!r}")
    return made(column(name), value)


@dataclass(frozen=True)
class Where:
    """Conditions in the order they were added: ``a AND b OR c`` means ``(a AND b) OR c``; the first connector counts for nothing."""

    groups: tuple[tuple[Column, ...], ...] = ()

    def add(self, condition: Column, connector: str = "AND") -> Where:
        if connector.upper() == "OR" or not self.groups:
            return Where((*self.groups, (condition,)))
        return Where((*self.groups[:-1], (*self.groups[-1], condition)))

    def column(self) -> Column | None:
        return reduce(operator.or_, (reduce(operator.and_, g) for g in self.groups)) if self.groups else None

    def apply(self, df: DataFrame) -> DataFrame:
        c = self.column()
        return df if c is None else df.filter(c)


@dataclass(frozen=True)
class Conditions:
    """A builder of ``Where``; every method returns a new one."""

    where_: Where = field(default_factory=Where)

    def _with(self, c: Column, connector: str = "AND") -> Conditions:
        return Conditions(self.where_.add(c, connector))

    def where(self, *args: Any, connector: str = "AND", **equal: Any) -> Conditions:
        """``where(name=v)``, ``where(col, v)``, ``where(col, op, v)`` or ``where({col: v})``; None compares as IS NULL."""
        out = self
        pairs = {**(args[0] if len(args) == 1 and isinstance(args[0], dict) else {}), **equal}
        for k, v in pairs.items():
            out = out._with(compare(k, "=", v), connector)
        if len(args) == 1 and isinstance(args[0], Column):
            out = out._with(args[0], connector)
        elif len(args) == 2:
            out = out._with(compare(args[0], "=", args[1]), connector)
        elif len(args) == 3:
            out = out._with(compare(*args), connector)
        return out

    def or_where(self, *args: Any, **equal: Any) -> Conditions:
        return self.where(*args, connector="OR", **equal)

    def where_in(self, col: str, values: Iterable, connector: str = "AND") -> Conditions:
        return self._with(is_in(column(col), values), connector)

    def where_not_in(self, col: str, values: Iterable, connector: str = "AND") -> Conditions:
        values = list(values)
        return self._with(~column(col).isin(values), connector) if values else self

    def where_not(self, connector: str = "AND", **unequal: Any) -> Conditions:
        out = self
        for k, v in unequal.items():
            out = out._with(compare(k, "!=", v), connector)
        return out

    def where_like(self, col: str, pattern: str, connector: str = "AND") -> Conditions:
        return self._with(compare(col, "like", pattern), connector)

    def where_not_like(self, col: str, pattern: str, connector: str = "AND") -> Conditions:
        return self._with(compare(col, "not like", pattern), connector)

    def where_glob(self, col: str, glob: str, connector: str = "AND") -> Conditions:
        return self._with(compare(col, "glob", glob), connector)

    def where_null(self, col: str, connector: str = "AND") -> Conditions:
        return self._with(column(col).isNull(), connector)

    def where_not_null(self, col: str, connector: str = "AND") -> Conditions:
        return self._with(column(col).isNotNull(), connector)

    def where_between(self, col: str, low: Any, high: Any, connector: str = "AND") -> Conditions:
        return self._with(column(col).between(low, high), connector)

    def where_raw(self, expression: str, connector: str = "AND") -> Conditions:
        return self._with(F.expr(expression), connector)

    def where_column(self, a: str, op: str, b: str | None = None, connector: str = "AND") -> Conditions:
        a, op, b = (a, "=", op) if b is None else (a, op, b)
        return self._with(compare(a, op, column(b)), connector)

    def _each(self, cols: Iterable[str], args: tuple) -> list[Column]:
        op, v = ("=", args[0]) if len(args) == 1 else args
        return [compare(c, op, v) for c in cols]

    def where_any(self, cols: Iterable[str], *args: Any, connector: str = "AND") -> Conditions:
        return self._with(reduce(operator.or_, self._each(cols, args)), connector)

    def where_all(self, cols: Iterable[str], *args: Any, connector: str = "AND") -> Conditions:
        return self._with(reduce(operator.and_, self._each(cols, args)), connector)

    def where_none(self, cols: Iterable[str], *args: Any, connector: str = "AND") -> Conditions:
        return self._with(~reduce(operator.or_, self._each(cols, args)), connector)

    def where_group(self, build: Callable[[Conditions], Conditions], connector: str = "AND") -> Conditions:
        inner = build(Conditions()).where_.column()
        return self if inner is None else self._with(inner, connector)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.where_.apply(df)


def _or(name: str):
    def method(self: Conditions, *args: Any, **options: Any) -> Conditions:
        return getattr(Conditions, name)(self, *args, connector="OR", **options)

    method.__name__ = f"or_{name}"
    method.__doc__ = f"``{name}`` joined by OR."
    return method


for _name in ("where_in", "where_not_in", "where_not", "where_like", "where_not_like", "where_null", "where_not_null", "where_between", "where_raw", "where_group"):
    setattr(Conditions, f"or_{_name}", _or(_name))

"""A small cache of query results on the driver: bounded, with a time to live, dropped by table."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterable

from pyspark.sql import DataFrame

ENTRIES, SECONDS = 512, 30.0


class ResultCache:
    """Persisted results by key; the one used longest ago goes first, and none outlives ``seconds``.

    A result names the tables that it read; ``invalidate`` drops those of a table that was written.
    """

    def __init__(self, entries: int = ENTRIES, seconds: float = SECONDS, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.held: OrderedDict[Hashable, tuple[float, DataFrame, frozenset[str]]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable, make: Callable[[], DataFrame], tables: Iterable[str] = ()) -> DataFrame:
        """The result kept under ``key``, or a new one of ``make()``, persisted."""
        found = self.held.get(key)
        if found and self.clock() - found[0] < self.seconds:
            self.held.move_to_end(key)
            self.hits += 1
            return found[1]
        if found:
            self._drop(key)
        self.misses += 1
        df = make().persist()
        self.held[key] = (self.clock(), df, frozenset(tables))
        while len(self.held) > self.entries:
            self._drop(next(iter(self.held)))
        return df

    def _drop(self, key: Hashable) -> None:
        self.held.pop(key)[1].unpersist()

    def invalidate(self, table: str | None = None) -> None:
        """Drop the results that read ``table``, or all."""
        for key in [k for k, (_, _, tables) in self.held.items() if table is None or table in tables]:
            self._drop(key)

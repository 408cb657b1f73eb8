"""Tables that are merged into where they lie: bucketed by key, only touched buckets written anew, versions published in one move.

A table's rows are dealt into buckets by a hash of their keys.  A merge reads the buckets that its rows' keys fall into, applies a change to them, which any
operator of ``mutate`` may be, since equal keys share a bucket, and writes those buckets into a new folder.  A version says which folder holds each bucket.  Readers
of the old version aren't disturbed, a merge that fails leaves no trace in the table, and of two writers of one version the second is refused.

A merge may name its origin and number, as a micro-batch of a stream does; one that the table has already is passed over, so a batch that comes again counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators import mutate
from loomdex.plans.versions import publish, remove, state_of

BUCKETS = 64


@dataclass(frozen=True)
class StoredTable:
    """A table in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def state(self, version: int | None = None) -> dict:
        return state_of(self.spark, self.folder, version)

    def _rows(self, state: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of the buckets, all by default, from the folders that hold them."""
        by_folder: dict[str, list[int]] = {}
        for b, name in state["buckets"].items():
            if buckets is None or int(b) in buckets:
                by_folder.setdefault(name, []).append(int(b))
        held = F.lit(False)
        for name, own in sorted(by_folder.items()):
            held = held | ((F.col("_write") == name) & F.col("_bucket").isin(own))
        rows = self.spark.read.schema(f"{state['schema']}, _write string, _bucket int").parquet(f"{self.folder}/rows")
        return rows.filter(held).drop("_write", "_bucket")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its last version, or of one that is kept."""
        return self._rows(self.state(version))

    def change(self, incoming: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], origin: str | None = None, number: int | None = None) -> StoredTable:
        """Replace the rows of the buckets that ``incoming`` touches by ``apply(rows, incoming)``, whose keys are those of either.

        Null keys share a bucket, and it is ``apply`` that says what equals what; nothing is published where nothing comes in.
        """
        state = self.state()
        if origin is not None and state["origins"].get(origin, -1) >= number:
            return self
        bucket = _bucket(state)
        known = incoming.withColumn("_bucket", bucket).select("_bucket").distinct().collect()  # a row a bucket
        touched = sorted(r["_bucket"] for r in known)
        if not touched and origin is None:
            return self
        buckets = dict(state["buckets"])
        if touched:
            name = uuid.uuid4().hex
            rows = apply(self._rows(state, touched), incoming).select(*self._rows(state, []).columns).withColumn("_bucket", bucket)
            rows.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.folder}/rows/_write={name}")
            buckets |= {str(b): name for b in touched}
        origins = state["origins"] if origin is None else {**state["origins"], origin: number}
        publish(self.spark, self.folder, {**state, "buckets": buckets, "origins": origins})
        return self

    def upsert(self, incoming: DataFrame, columns: Sequence[str] | None = None) -> StoredTable:
        """Insert new keys, of known ones replace ``columns``; keys of ``incoming`` are distinct."""
        keys = self.state()["keys"]
        return self.change(incoming, lambda rows, new: mutate.upsert(rows, new, keys, columns))

    def insert_or_ignore(self, incoming: DataFrame) -> StoredTable:
        keys = self.state()["keys"]
        return self.change(incoming, lambda rows, new: mutate.insert_or_ignore(rows, new, keys))

    def update(self, changes: DataFrame) -> StoredTable:
        """Set the columns of ``changes``, which holds the one key, in rows that are there."""
        (key,) = self.state()["keys"]
        return self.change(changes, lambda rows, new: mutate.bulk_update(rows, new, key))

    def add(self, increments: DataFrame, origin: str | None = None, number: int | None = None) -> StoredTable:
        """Add counters by key, missing ones counting 0."""
        keys = self.state()["keys"]
        return self.change(increments, lambda rows, new: mutate.add_counters(rows, new, keys), origin, number)

    def delete(self, gone: DataFrame) -> StoredTable:
        """Remove rows by their keys."""
        keys = self.state()["keys"]
        return self.change(gone, lambda rows, old: rows.join(old.select(*keys).distinct(), keys, "left_anti"))

    def vacuum(self, keep: int = 1) -> StoredTable:
        """Delete the folders that none of the last ``keep`` versions reads, and the versions before those; for when no reader or writer is at work."""
        last = self.state()["version"]
        kept = [self.state(v) for v in range(max(1, last - keep + 1), last + 1)]
        used = {name for s in kept for name in s["buckets"].values()}
        there = self.spark.read.schema("_write string, _bucket int").parquet(f"{self.folder}/rows").select("_write").distinct().collect()  # a row a folder
        for name in sorted({r["_write"] for r in there} - used):
            remove(self.spark, f"{self.folder}/rows/_write={name}")
        for r in self.spark.read.schema("version int").parquet(f"{self.folder}/versions").distinct().collect():
            if r["version"] <= last - keep:
                remove(self.spark, f"{self.folder}/versions/version={r['version']}")
        return self

    def sink(self, origin: str) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that adds each micro-batch's counters once."""

        def run(batch: DataFrame, number: int) -> None:
            StoredTable(batch.sparkSession, self.folder).add(batch, origin, number)

        return run


def _bucket(state: dict) -> Column:
    return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["number"])).cast("int")


def create(rows: DataFrame, keys: Sequence[str], folder: str, buckets: int = BUCKETS) -> StoredTable:
    """Write ``rows`` as a table in a new folder."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    state = {"version": 0, "keys": list(keys), "number": buckets, "schema": schema, "origins": {}}
    dealt = rows.withColumn("_bucket", _bucket(state))
    dealt.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{folder}/rows/_write={name}")
    publish(spark, folder, {**state, "buckets": {str(b): name for b in range(buckets)}})
    return StoredTable(spark, folder)

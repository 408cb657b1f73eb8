"""Stored tables against the operators on whole DataFrames."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import mutate, stored

FIELDS = "id long, name string, calls long"


def frame(spark, rows, fields=FIELDS):
    return spark.createDataFrame(rows, fields)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merges_equal_whole_rewrites_and_touch_their_buckets(spark, tmp_path):
    r = random.Random(2)
    whole = frame(spark, [(i, f"n{i}", i) for i in range(200)])
    table = stored.create(whole, ["id"], f"file://{tmp_path}/t", 16)
    assert rows_of(table.read()) == rows_of(whole)
    new = frame(spark, [(i, "new", None) for i in (3, 5, 500)])
    before = table.state()["buckets"]
    table.upsert(new, ["name"])
    whole = mutate.upsert(whole, new, ["id"], ["name"])
    after = table.state()["buckets"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 3
    more = frame(spark, [(r.randrange(600), "x", 1) for _ in range(1)] + [(700, "y", 2)])
    table.insert_or_ignore(more)
    whole = mutate.insert_or_ignore(whole, more, ["id"])
    changes = frame(spark, [(5, None), (9999, "absent")], "id long, name string")
    table.update(changes)
    whole = mutate.bulk_update(whole, changes, "id")
    gone = frame(spark, [(7,), (8,), (8,), (12345,)], "id long")
    table.delete(gone)
    whole = whole.filter("id NOT IN (7, 8)")
    assert rows_of(table.read()) == rows_of(whole)
    assert rows_of(table.read(1)) == rows_of(frame(spark, [(i, f"n{i}", i) for i in range(200)]))
    version = table.state()["version"]
    table.upsert(frame(spark, []))
    assert table.state()["version"] == version == 5
    table.vacuum()
    assert rows_of(table.read()) == rows_of(whole)
    with pytest.raises(ValueError, match="no version"):
        table.read(1)
    assert len([p for p in (tmp_path / "t/rows").iterdir() if p.name.startswith("_write")]) <= 5


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    table = stored.create(frame(spark, [(1, 5)], "id long, calls long"), ["id"], f"file://{tmp_path}/t", 4)
    put = table.sink("usage")
    batch = frame(spark, [(1, 2), (2, 1), (2, None), (None, 1)], "id long, calls long")
    put(batch, 0)
    put(batch, 0)
    put(batch.limit(0), 1)
    assert rows_of(table.read()) == [(1, 7), (2, 1), (None, 1)]
    put(batch, 1)
    assert rows_of(table.read()) == [(1, 7), (2, 1), (None, 1)]
    put(batch, 2)
    assert rows_of(table.read()) == [(1, 9), (2, 2), (None, 2)]


def test_the_second_writer_of_a_version_is_refused_and_leaves_no_trace(spark, tmp_path):
    table = stored.create(frame(spark, [(1, "a", 1)]), ["id"], f"file://{tmp_path}/t", 2)

    def meanwhile(rows, new):
        stored.StoredTable(spark, table.folder).upsert(frame(spark, [(2, "b", 1)]))
        return mutate.upsert(rows, new, ["id"])

    with pytest.raises(RuntimeError, match="another writer"):
        table.change(frame(spark, [(1, "lost", 1)]), meanwhile)
    assert rows_of(table.read()) == [(1, "a", 1), (2, "b", 1)]


def test_a_stream_into_a_table(spark, tmp_path):
    events = frame(spark, [(i % 5, 1) for i in range(40)], "id long, calls long")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    table = stored.create(events.limit(0), ["id"], f"file://{tmp_path}/t", 4)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    source.writeStream.foreachBatch(table.sink("in")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert rows_of(table.read()) == [(i, 8) for i in range(5)] and table.state()["version"] == 5
    assert table.read().agg(F.sum("calls")).head()[0] == 40

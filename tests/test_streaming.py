"""Streams against their batch results."""

import datetime as dt

from pyspark.sql import functions as F

from loomdex.streaming import usage


def rows(spark, n=60):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(hours=i), i % 3, float(i)) for i in range(n)], "event_id long, ts timestamp, user_id long, value double")


def test_streams_equal_batch(spark, tmp_path):
    df = rows(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = usage.events(spark, str(tmp_path / "in"), df.schema)
    counters = {"calls": F.count(F.lit(1)), "total": F.sum("value")}
    assert sorted(usage.drained(usage.daily_usage(stream, ["user_id"], counters)).collect()) == sorted(usage.daily_usage(df, ["user_id"], counters).collect())
    assert sorted(usage.drained(usage.last_access(stream, "user_id")).collect()) == sorted(usage.last_access(df, "user_id").collect())
    assert sorted(usage.drained(usage.sessions(stream, "user_id", "2 hours")).collect()) == sorted(usage.sessions(df, "user_id", "2 hours").collect())


def test_retention_and_staleness(spark):
    t = dt.datetime(2024, 1, 20)
    df = spark.createDataFrame([(1, None), (2, t - dt.timedelta(days=8)), (3, t - dt.timedelta(days=1))], "id long, ended_at timestamp")
    assert sorted(r["id"] for r in usage.purge_ended(df, F.lit(t)).collect()) == [1, 3]
    assert spark.range(1).select(usage.stale(F.lit(t - dt.timedelta(seconds=11)), F.lit(t))).head()[0]

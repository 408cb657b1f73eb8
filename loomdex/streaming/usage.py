"""Streams over event files.

Increments count by event time under a watermark; late rows within it revise their own day.  Sinks that
must equal the batch result run in complete or update mode, as append mode holds the last windows back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.plans.lineage import shared_dir


def events(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """A stream of the parquet files of a folder, with a watermark on ``ts``."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def daily_usage(rows: DataFrame, keys: list[str], counters: dict[str, Column], ts: str = "ts") -> DataFrame:
    return rows.groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(*[c.alias(n) for n, c in counters.items()]).select(F.col("w.start").cast("date").alias("date"), *keys, *counters)


def last_access(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return rows.groupBy(key).agg(F.max(ts).alias("last_access"))


def category_counts(rows: DataFrame, session: str, category: str, counters: dict[str, Column]) -> DataFrame:
    return rows.groupBy(session, category).agg(*[c.alias(n) for n, c in counters.items()])


def sessions(rows: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """``(key, started_at, ended_at, events)`` of runs of events less than ``gap`` apart."""
    own = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"))
    return own.select(key, "started_at", "ended_at", "events")


def first_of_key(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Each key once within the watermark: the job queue's rule that a queued key isn't queued again."""
    return rows.dropDuplicatesWithinWatermark([key])


def purge_ended(rows: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Rows not ended, or ended within the days before ``now``."""
    return rows.filter(F.col("ended_at").isNull() | (F.col("ended_at") >= now - F.expr(f"INTERVAL {days} DAYS")))


def stale(last_heartbeat: Column, now: Column, seconds: int = 10) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(last_heartbeat) > seconds


def watch(spark: SparkSession, folder: str, glob: str, handle, debounce: str = "2 seconds"):
    """Start a query that hands each micro-batch of changed files to ``handle(batch, batch_id)``."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.writeStream.foreachBatch(handle).trigger(processingTime=debounce).option("checkpointLocation", f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}").start()


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all files that are there, written to the shared folder and read back."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{top}/rows")

    stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{top}/state").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")


def emit(stream: DataFrame, folder: str, partition_by: tuple[str, ...] = ()):
    """Start a query that appends a stream's rows to Parquet files exactly once, as far as there are rows; the sink of an event source."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def queued(jobs: DataFrame, most_done: int = 50) -> DataFrame:
    """The queue's view of ``jobs(id, key, status, priority, queued_at, ended_at)``: of a key that waits or runs the first job alone, by priority, and the ``most_done`` jobs ended last."""
    from pyspark.sql import Window

    waits = jobs.filter(F.col("status").isin("queued", "running"))
    first = Window.partitionBy("key").orderBy((F.col("status") == "running").desc(), "queued_at", "id")
    live = waits.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    done = jobs.filter(~F.col("status").isin("queued", "running")).orderBy(F.col("ended_at").desc(), "id").limit(most_done)
    return live.unionByName(done)


def live_nodes(nodes: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """``nodes(node_id, role, last_heartbeat)`` with ``alive``; the leader is the longest-lived of those alive if the one named so is not."""
    from pyspark.sql import Window

    seen = nodes.withColumn("alive", ~stale(F.col("last_heartbeat"), now, seconds))
    rank = F.row_number().over(Window.orderBy(F.col("alive").desc(), (F.col("role") == "leader").desc(), "started_at", "node_id"))  # a row a node
    return seen.withColumn("role", F.when((rank == 1) & F.col("alive"), "leader").otherwise("follower"))


def closed_sessions(sessions: DataFrame, instances: DataFrame, now: Column) -> DataFrame:
    """``sessions(id, ended_at, ...)`` with an end for those that have instances, none of which still runs."""
    own = instances.groupBy(F.col("coding_session_id").alias("_key")).agg(F.count_if(F.col("ended_at").isNull()).alias("_live"))
    ended = F.when(F.col("ended_at").isNull() & (F.col("_live") == 0), now).otherwise(F.col("ended_at"))
    return sessions.join(own, F.col("id") == F.col("_key"), "left").withColumn("ended_at", ended).drop("_key", "_live")


def claim(lock: DataFrame, claims: DataFrame, now: Column, seconds: int = 10) -> DataFrame:
    """The one-row lease ``lock(holder, taken_at)`` after ``claims(node_id, at)``: the holder's own renewal counts first, and a lease
    that is absent or stale goes to the earliest claim.  A compare-and-set for one micro-batch, whose driver writes the row."""
    best = claims.agg(F.min(F.struct("at", "node_id")).alias("first"), F.collect_set("node_id").alias("all"))  # nodes are few
    joined = best.join(lock, F.lit(True), "left")
    keeps = F.array_contains("all", F.col("holder"))
    free = F.col("holder").isNull() | stale(F.col("taken_at"), now, seconds)
    taken = F.when(keeps, F.col("holder")).when(free & F.col("first").isNotNull(), F.col("first.node_id")).otherwise(F.col("holder"))
    at = F.when(keeps | (free & F.col("first").isNotNull()), now).otherwise(F.col("taken_at"))
    return joined.select(taken.alias("holder"), at.alias("taken_at")).filter("holder IS NOT NULL")


def fan_out(events: DataFrame, queue: str, order: str, capacity: int = 256) -> tuple[DataFrame, DataFrame]:
    """What bounded queues hold of undelivered events, the first ``capacity`` each, and ``(queue, dropped)`` for the rest."""
    from pyspark.sql import Window

    numbered = events.withColumn("_rn", F.row_number().over(Window.partitionBy(queue).orderBy(order)))
    dropped = numbered.groupBy(queue).agg(F.count_if(F.col("_rn") > capacity).alias("dropped"))
    return numbered.filter(F.col("_rn") <= capacity).drop("_rn"), dropped

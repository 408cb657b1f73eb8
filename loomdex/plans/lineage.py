"""Cutting lineage in storage that every executor can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where the session names none, a local master gets a temporary one; a cluster is refused."""
    sc = spark.sparkContext
    if found := sc.getCheckpointDir():
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomdex-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    A reliable checkpoint outlives the executors that computed it, so iterative operators
    neither replay their history nor depend on one executor's disk.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(spark: SparkSession) -> None:
    """Let the driver collect its garbage now, for loops of many small queries.

    Shuffles, broadcasts and plans of finished queries stay until the driver's next full collection, which a heap
    with room to grow puts off: it grows to its bound instead, and shuffle files stay on the executors' disks.
    """
    spark.sparkContext._jvm.System.gc()

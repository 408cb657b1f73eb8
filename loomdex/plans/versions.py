"""Published versions of what lies in a folder: one row each, that appears under its number in one move."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def state_of(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The last published version, or the one of a number."""
    rows = spark.read.schema("state string, version int").parquet(f"{folder}/versions")
    row = rows.orderBy("version", ascending=False).head() if version is None else rows.filter(rows["version"] == version).head()
    if row is None:
        raise ValueError(f"no version {version}")
    return json.loads(row["state"])


def publish(spark: SparkSession, folder: str, state: dict) -> dict:
    """Make ``state`` the version behind the one that it was made from; RuntimeError where another writer has."""
    state = {**state, "version": state["version"] + 1}
    rows = spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write
    place = f"{folder}/versions/version={state['version']}"
    try:
        rows.mode("errorifexists").parquet(place)
    except AnalysisException:
        if state_of(spark, folder)["version"] >= state["version"]:
            raise RuntimeError(f"another writer has published version {state['version']}") from None
        rows.mode("overwrite").parquet(place)  # a writer that ended in the middle
    return state


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

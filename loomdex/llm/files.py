"""Binary files in folders that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from loomdex.plans.lineage import shared_dir


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared checkpoint folder."""
    top = shared_dir(spark).rstrip("/")
    return f"{top if ':' in top else 'file://' + top}/loomdex-{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, name: str) -> str:
    """A scratch folder that rows still to be computed read; it goes when the driver ends."""
    folder = scratch(spark, name)
    atexit.register(remove, folder)
    return folder


def remove(uri: str) -> None:
    files, path = opened(uri)
    if files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as compressed Parquet and read back: a checkpoint of less size."""
    folder = passing(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def kept(spark: SparkSession, name: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """``make(folder)``'s rows, written, after which the folder goes."""
    folder = scratch(spark, name)
    try:
        return written(make(folder), f"{name}-rows")
    finally:
        remove(folder)


def unique_name(stem: str, ending: str) -> str:
    """A file name of this task attempt's own: a repeated task never writes into a file that readers were told of."""
    from pyspark import TaskContext

    return f"{stem}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}{ending}"

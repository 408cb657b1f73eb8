"""Table access: parquet, JDBC, SQL with parameters, JSON export."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.plans.lineage import shared_dir
from loomdex.schema import TABLES

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
_KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR(32672)"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder; index tables are read with their declared schema."""
    reader = spark.read
    if name in TABLES:
        reader = reader.schema(TABLES[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def raw(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None, **params: Any) -> DataFrame:
    """SQL text with bound parameters (``:name``) over DataFrames (``{name}``); values are never pasted into the text."""
    return spark.sql(sql, args=params or None, **(views or {}))


def jdbc(spark: SparkSession, url: str, name: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 10, **options: str) -> DataFrame:
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def derby(df: DataFrame, name: str, key: str | None = None) -> str:
    """The JDBC URL of a read-only Derby database with ``df`` as its table ``name``, which driver and executors can open at once.

    Executors write the rows as text, and the database, which runs beside the driver, loads the files one after the other; what it stores is then packed into
    an archive in the shared folder, which has to be mounted.  ``key`` gets an index, for reads in ranges of it.  Integers, doubles and strings of up to 32,672 characters are known.
    """
    spark = df.sparkSession
    top = shared_dir(spark).removeprefix("file:")
    top = "/" + top.lstrip("/")
    if not os.path.isdir(top):
        raise ValueError("a Derby archive needs a mounted folder as spark.checkpoint.dir")
    made, folder, archive = tempfile.mkdtemp(prefix="derby-"), f"{top}/{name}-{uuid.uuid4().hex}", f"{top}/{name}-{uuid.uuid4().hex}.jar"
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else F.col(c).cast("string") for c, kind in df.dtypes]
    df.select(F.concat_ws(",", *[F.coalesce(x, F.lit("")) for x in quoted]).alias("value")).write.text(f"file://{folder}")  # nothing stands for null
    spark._jvm.java.lang.Class.forName(DERBY)
    connect = spark._jvm.java.sql.DriverManager.getConnection
    try:
        connection = connect(f"jdbc:derby:{made}/{name};create=true")
        statement = connection.createStatement()
        statement.execute(f'CREATE TABLE "{name}" ({", ".join(f"{chr(34)}{c}{chr(34)} {_KINDS[kind]}" for c, kind in df.dtypes)})')
        for file in sorted(f for f in os.listdir(folder) if f.startswith("part-") and os.path.getsize(f"{folder}/{f}")):
            statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name}', '{folder}/{file}', NULL, NULL, 'UTF-8', 0)")
        if key:
            statement.execute(f'CREATE INDEX "{name}_{key}" ON "{name}" ("{key}")')
        connection.close()
        try:
            connect(f"jdbc:derby:{made}/{name};shutdown=true")
        except Exception as e:
            if "08006" not in str(e):  # the state that says it went well
                raise
        with zipfile.ZipFile(archive, "w") as z:
            for at, _, files in os.walk(f"{made}/{name}"):
                for file in files:
                    z.write(f"{at}/{file}", os.path.relpath(f"{at}/{file}", made))
    finally:
        shutil.rmtree(made, ignore_errors=True)
        shutil.rmtree(folder, ignore_errors=True)
    return f"jdbc:derby:jar:({archive}){name}"


def export_repo(repos: DataFrame, files: DataFrame, symbols: DataFrame, sections: DataFrame) -> DataFrame:
    """One JSON text a repo: its row, and its files with their symbols and sections."""
    syms = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("symbol_id", "name", "kind", "signature"))).alias("symbols"))
    secs = sections.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("section_id", "title", "level"))).alias("sections"))
    own = files.join(syms, files["id"] == syms["file_id"], "left").drop("file_id").join(secs, files["id"] == secs["file_id"], "left").drop("file_id")
    by_repo = own.groupBy(F.col("repo_id").alias("_repo")).agg(F.array_sort(F.collect_list(F.struct("path", "language", "content_hash", "symbols", "sections"))).alias("files"))
    joined = repos.join(by_repo, F.col("id") == F.col("_repo"), "left")
    return joined.select("id", F.to_json(F.struct(*[c for c in repos.columns], "files")).alias("json"))


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet; with partitions and ``overwrite`` only the partitions of ``df`` are replaced."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)

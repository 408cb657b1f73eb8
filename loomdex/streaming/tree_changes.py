"""Changes of a tree of files as a stream, vanished files among them.

An offset is the number of a listing: the paths, sizes and times of a moment, kept beside the stream's checkpoint while a batch may still need it.  What a batch
brings is the difference of two listings, so a batch that is run again brings the same paths; contents are read by the tasks, and a file that
has gone meanwhile comes with a later listing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators.segments import Segments

SCHEMA = "path string, change string, length long, modified long, content binary"
#: Files that a task reads.
FILES = 256


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


class Files(InputPartition):
    """Some of a batch's changes: path, change, length, time."""

    def __init__(self, changes: list[tuple[str, str, int, int]]):
        self.changes = changes


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.tree, self.listings = options["path"], options["listings"]
        self.endings = tuple(e for e in options.get("endings", "").split(",") if e)

    def _listed(self) -> dict[str, list[int]]:
        files, top = _opened(self.tree)
        infos = files.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        own = [i for i in infos if i.type == fs.FileType.File and (not self.endings or i.path.endswith(self.endings))]
        return {i.path.removeprefix(top).lstrip("/"): [i.size, i.mtime_ns] for i in sorted(own, key=lambda i: i.path)}

    def _numbers(self) -> list[int]:
        files, top = _opened(self.listings)
        infos = files.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return sorted(int(i.base_name.removesuffix(".json")) for i in infos if i.base_name.endswith(".json"))

    def _listing(self, number: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        files, top = _opened(self.listings)
        with files.open_input_stream(f"{top}/{number}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        now, last = self._listed(), max(self._numbers(), default=0)
        if now == self._listing(last):
            return {"listing": last}
        files, top = _opened(self.listings)
        files.create_dir(top, recursive=True)
        draft = f"{top}/{uuid.uuid4().hex}.draft"
        with files.open_output_stream(draft) as f:
            f.write(json.dumps(now).encode())
        files.move(draft, f"{top}/{last + 1}.json")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before, after = self._listing(start["listing"]), self._listing(end["listing"])
        changes = [(p, "added" if p not in before else "changed", *after[p]) for p in after if before.get(p) != after[p]]
        changes += [(p, "deleted", *before[p]) for p in before if p not in after]
        return [Files(changes[i : i + FILES]) for i in range(0, len(changes), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, top = _opened(self.tree)
        for path, change, length, modified in partition.changes:
            if change == "deleted":
                yield path, change, length, modified, None
                continue
            try:
                with files.open_input_stream(f"{top}/{path}") as f:
                    content = f.read()
            except FileNotFoundError:
                continue  # the next listing tells
            yield path, change, length, modified, content

    def commit(self, end: dict) -> None:
        files, top = _opened(self.listings)
        for number in self._numbers():
            if number < end["listing"]:
                files.delete_file(f"{top}/{number}.json")


class TreeChanges(DataSource):
    """``format("tree_changes")`` with the options ``path``, ``listings`` (a folder for them) and ``endings`` (of names, by commas; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def changes(spark: SparkSession, tree: str, listings: str, endings: str = "") -> DataFrame:
    """A stream of ``SCHEMA``: paths within the tree; ``change`` is added, changed or deleted."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", tree).option("listings", listings).option("endings", endings).load()


def into(index: Segments, text: str, fanout: int = 4) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps an index, whose keys are the paths, like the tree; a batch that comes again changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        own = Segments(batch.sparkSession, index.folder)
        kept = batch.persist()  # a batch reads its files once
        try:
            gone = kept.filter(F.col("change") == "deleted").select(F.col("path").alias("key"))
            here = kept.filter(F.col("change") != "deleted").select("path", F.col("content").cast("string").alias(text))
            own.delete(gone)
            own.add(here, "path")
            own.maintain(fanout)
        finally:
            kept.unpersist()

    return run


def keep_like(spark: SparkSession, tree: str, index: Segments, text: str, folder: str, endings: str = "", debounce: str = "2 seconds") -> StreamingQuery:
    """Start a query that keeps an index like a tree; ``folder`` holds its checkpoint and listings, from which it goes on when it is started again."""
    rows = changes(spark, tree, f"{folder}/listings", endings)
    return rows.writeStream.foreachBatch(into(index, text)).trigger(processingTime=debounce).option("checkpointLocation", f"{folder}/checkpoint").start()

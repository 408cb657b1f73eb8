"""The index of a source tree, made or brought up to date in one plan.

Files whose size or time isn't that of the index are read, judged and compared with it by content hash, and only new and changed ones are parsed; rows of
unchanged files are carried over, those of vanished ones go.  Imports are resolved over all files, since a new file may be what an old
import meant, and references follow from them.  Ids are hashes of repository and path, so a file keeps its id from run to run.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import keywords, summary
from loomdex.operators import graph
from loomdex.plans.lineage import cut
from loomdex.sources import code, documents
from loomdex.sources import files as S

DOCUMENTS = ("markdown", "html", "json", "yaml", "toml")


@dataclass(frozen=True)
class Snapshot:
    """An index's tables, and the files that a scan left out, by reason."""

    files: DataFrame
    blobs: DataFrame
    symbols: DataFrame
    sections: DataFrame
    imports: DataFrame
    calls: DataFrame
    references: DataFrame
    left_out: DataFrame

    def write(self, folder: str) -> None:
        """Every table as Parquet in a new folder; readers of an older one are not disturbed."""
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{folder}/{f.name}")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Snapshot:
        return Snapshot(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(Snapshot)})


def file_id(repo: str, path: Column) -> Column:
    return F.xxhash64(F.lit(repo), path)


def _carried(old: DataFrame | None, new: DataFrame, stays: DataFrame) -> DataFrame:
    """Rows of files that stay as they are, and the new ones."""
    return new if old is None else old.select(*new.columns).join(stays, "path", "left_semi").unionByName(new)


def index(tree: DataFrame, repo: str, repo_id: int = 1, before: Snapshot | None = None, most_files: int | None = None, trust_times: bool = True) -> Snapshot:
    """The snapshot of ``tree(path, byte_size, mtime, content)``; with the one ``before``, only what changed is parsed.

    A file whose size and time are those of the snapshot before isn't read, unless ``trust_times`` is false, when its content's hash decides.
    Contents that were read are written once; of the others the snapshot before has them.
    """
    same = None
    if before is not None and trust_times:
        same = before.files.join(tree.select("path", "byte_size", "mtime"), ["path", "byte_size", "mtime"], "left_semi")
    kept, left_out = S.discover(tree if same is None else tree.join(same.select("path"), "path", "left_anti"))
    read = cut(kept.withColumns({"id": file_id(repo, F.col("path")), "repo_id": F.lit(repo_id).cast("long")}))
    now = read.drop("content")
    now = now if same is None else now.unionByName(same.select(*now.columns))
    now = cut(now if most_files is None else now.orderBy("path").limit(most_files))
    read = read.join(now.select("path"), "path", "left_semi")
    changed = read if before is None else S.changed(read, before.files)
    stays = now.select("path", "content_hash").join(changed.select("path"), "path", "left_anti").select("path")
    parsed = changed.select("path", "language", F.col("content").cast("string").alias("content"))
    blobs = read.select("content_hash", "content").dropDuplicates(["content_hash"])
    if before is not None:
        held = before.blobs.join(now.select("content_hash").distinct(), "content_hash", "left_semi")
        blobs = held.unionByName(blobs.join(held.select("content_hash"), "content_hash", "left_anti"))
    symbols = code.symbols(parsed, repo)
    symbols = symbols.withColumns({"keywords": keywords(F.col("name"), F.col("docstring"), F.col("decorators")), "summary": summary(F.col("docstring"), F.col("signature"), F.col("name"))})
    sections = documents.sections(parsed.filter(F.col("language").isin(*DOCUMENTS)))
    symbols, sections, imports, calls = (
        cut(_carried(getattr(before, name, None), rows, stays)) for name, rows in (("symbols", symbols), ("sections", sections), ("imports", code.imports(parsed)), ("calls", code.calls(parsed, repo)))
    )
    ids = now.select("path", F.col("id").alias("file_id"))
    numbered = imports.join(ids, "path").withColumn("id", F.xxhash64("path", "specifier", F.to_json("names"))).withColumn("repo_id", F.lit(repo_id).cast("long")).dropDuplicates(["id"])
    resolved = cut(graph.resolve_imports(numbered, now.select("repo_id", "path", "id")))
    of_files = symbols.join(ids, "path").withColumn("id", F.xxhash64("symbol_id"))
    refs = graph.reference_graph(now.select("id", "path", "content_hash"), of_files.select("id", "file_id", "symbol_id", "name"), resolved, blobs)
    targets = graph.resolve_calls(calls.select("caller_symbol_id", "callee", "line"), of_files.select("id", "name", "qualified_name", "symbol_id"))
    called = targets.filter("target_symbol_id IS NOT NULL").select(F.col("caller_symbol_id").alias("source_symbol_id"), "target_symbol_id", F.col("callee").alias("target_specifier"), "line")
    references = refs.withColumn("line", F.lit(None).cast("int")).unionByName(called)
    return Snapshot(now, blobs, symbols, sections, resolved.select("id", "file_id", "path", "specifier", "names", "candidates", "resolved_file_id"), calls, cut(references.distinct()), left_out)

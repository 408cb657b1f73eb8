"""Named filters and projections of the index tables, for ``Query.scopes`` or by themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.plans.query import Query


def _kind(*kinds: str) -> Callable[[Query], Query]:
    return lambda q: q.where_in("kind", kinds)


def symbol_scopes(files: DataFrame, repos: DataFrame, workspace_repos: DataFrame) -> dict[str, Callable[..., Query]]:
    """Scopes of symbols: by kind, and by file, repository or workspace through joins that a query makes once."""
    f = files.select(F.col("id").alias("_file"), F.col("path").alias("file_path"), F.col("repo_id").alias("file_repo"))

    def with_files(q: Query) -> Query:
        return q.join("files", f, F.col("file_id") == F.col("_file"))

    def in_file(q: Query, path: str) -> Query:
        return with_files(q).where("file_path", path)

    def in_repo(q: Query, name: str) -> Query:
        r = repos.select(F.col("id").alias("_repo"), F.col("name").alias("repo_name"))
        return with_files(q).join("repos", r, F.col("file_repo") == F.col("_repo")).where("repo_name", name)

    def in_workspace(q: Query, workspace_id: int) -> Query:
        w = workspace_repos.select(F.col("repo_id").alias("_member"), "workspace_id").distinct()
        return with_files(q).join("workspace_repos", w, F.col("file_repo") == F.col("_member")).where("workspace_id", workspace_id)

    kinds = {"functions": "function", "methods": "method", "classes": "class", "constants": "constant", "types": "type"}
    return {**{name: _kind(kind) for name, kind in kinds.items()}, "in_file": in_file, "in_repo": in_repo, "in_workspace": in_workspace}


def section_scopes(files: DataFrame, repos: DataFrame) -> dict[str, Callable[..., Query]]:
    scopes = symbol_scopes(files, repos, files.select(F.lit(None).cast("long").alias("workspace_id"), "repo_id").limit(0))
    return {"in_repo": scopes["in_repo"], "in_doc": scopes["in_file"]}


REPO_SCOPES: dict[str, Callable[..., Query]] = {
    "libraries": lambda q: q.where(repo_type="library"),
    "local_repos": lambda q: q.where("repo_type", "!=", "library"),
}
INSTANCE_SCOPES: dict[str, Callable[..., Query]] = {"active": lambda q: q.where_null("ended_at")}
NODE_SCOPES: dict[str, Callable[..., Query]] = {"leader": lambda q: q.where(role="leader"), "followers": lambda q: q.where(role="follower")}


def _text(name: str, own: str | None = None) -> str:
    return f"coalesce({own or name}, '') AS {name}"


def _list(name: str) -> str:
    return f"coalesce({name}, CAST(array() AS array<string>)) AS {name}"


#: Projections by table and name as SQL expressions; missing texts are "", missing lists empty.
PRESENTERS: dict[tuple[str, str], tuple[str, ...]] = {
    ("symbol", "brief"): ("symbol_id", "name", "kind", _text("file", "file_path"), "line_start"),
    ("symbol", "standard"): ("symbol_id", "name", "qualified_name", "kind", "language", _text("file", "file_path"), _text("signature"), _text("summary"), "line_start"),
    ("symbol", "full"): (
        "symbol_id", "name", "qualified_name", "kind", "language", _text("file", "file_path"), _text("signature"), _text("summary"), _text("docstring"), _list("decorators"), _text("source"), "line_start", "line_end",
    ),
    ("symbol", "sibling"): ("symbol_id", "name", "kind", _text("signature"), "line_start"),
    ("symbol", "outline"): ("symbol_id", "name", "kind", _text("signature"), "line_start", "line_end", "parent_symbol_id"),
    ("file", "brief"): ("path", "language"),
    ("file", "with_counts"): ("path", "language", "coalesce(symbol_count, 0) AS symbol_count"),
    ("import", "standard"): ("specifier", _list("names")),
    ("section", "brief"): ("section_id", "title", "level", _text("doc_path", "file_path")),
    ("section", "standard"): ("section_id", "title", "level", _text("doc_path", "file_path"), _text("summary"), _list("tags")),
    ("section", "full"): ("section_id", "title", "level", _text("doc_path", "file_path"), _text("summary"), _list("tags"), _text("content")),
    ("reference", "caller"): (_text("symbol_id", "source_symbol_id"), _text("name"), _text("kind"), _text("file", "file_path"), _text("signature"), "line"),
    ("reference", "callee"): (_text("symbol_id", "target_symbol_id"), _text("name"), _text("kind"), _text("file", "file_path"), _text("signature"), "line"),
}
#: Columns that come from joins, or that a table may lack.
OPTIONAL = {
    "file_path": "string", "source": "string", "content": "string", "symbol_count": "long", "summary": "string", "signature": "string", "docstring": "string", "name": "string", "kind": "string",
    "decorators": "array<string>", "tags": "array<string>", "names": "array<string>", "line": "int", "parent_symbol_id": "string",
}


def present(rows: DataFrame, table: str, name: str) -> DataFrame:
    """``rows`` in the named shape; optional columns that ``rows`` doesn't have count as null."""
    if (table, name) not in PRESENTERS:
        raise ValueError(f"unknown presenter: {table} {name}")
    absent = {c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in rows.columns}
    return rows.withColumns(absent).selectExpr(*PRESENTERS[table, name])

"""Table schemas of the code index.  Nothing is inferred from data; foreign keys are not enforced."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark DDL of each table; readers take it as it is.
TABLES: dict[str, str] = {
    "repos": ("id LONG, name STRING, source_path STRING, github_url STRING, indexed_at TIMESTAMP, git_head STRING, repo_type STRING, package_manager STRING, package_name STRING, version STRING, briefing STRING"),
    "files": ("id LONG, repo_id LONG, path STRING, language STRING, content_hash STRING, byte_size LONG, mtime DOUBLE"),
    "blobs": ("content_hash STRING, content BINARY"),
    "symbols": ("id LONG, file_id LONG, symbol_id STRING, name STRING, qualified_name STRING, kind STRING, language STRING, signature STRING, docstring STRING, summary STRING, "
        "decorators ARRAY<STRING>, keywords ARRAY<STRING>, parent_symbol_id STRING, line_start INT, line_end INT, byte_offset LONG, byte_length LONG, content_hash STRING, cyclomatic INT, max_nesting INT, param_count INT"
    ),
    "sections": ("id LONG, file_id LONG, section_id STRING, title STRING, level INT, parent_section_id STRING, byte_start LONG, byte_end LONG, summary STRING, tags ARRAY<STRING>, refs ARRAY<STRING>, content_hash STRING, body_text STRING"
    ),
    "file_imports": ("id LONG, file_id LONG, specifier STRING, names ARRAY<STRING>, resolved_file_id LONG"),
    "references": ("id LONG, source_symbol_id STRING, target_symbol_id STRING, target_specifier STRING, target_names ARRAY<STRING>, line INT"),
    "usage_stats": ("repo_id LONG, date DATE, sessions LONG, tool_calls LONG, tokens_returned LONG, tokens_avoided LONG, symbols_retrieved LONG, sections_retrieved LONG, "
        "tokens_returned_search LONG, tokens_equivalent_search LONG, tokens_returned_retrieval LONG, tokens_equivalent_retrieval LONG"
    ),
    "quality": ("symbol_id STRING, has_tests BOOLEAN, has_docs BOOLEAN, has_types BOOLEAN, complexity INT, change_frequency INT, last_changed STRING"),
    "blame_cache": ("file_id LONG, line_start INT, line_end INT, author STRING, commit_hash STRING, commit_date TIMESTAMP"),
    "workspaces": ("id LONG, name STRING, created_at TIMESTAMP, description STRING"),
    "workspace_repos": ("workspace_id LONG, repo_id LONG"),
    "memories": ("id LONG, repo_id LONG, content STRING, tags ARRAY<STRING>, embedding ARRAY<FLOAT>, created_at TIMESTAMP, updated_at TIMESTAMP"),
    "preferences": ("id LONG, scope STRING, scope_id LONG, key STRING, instruction STRING, created_at TIMESTAMP, updated_at TIMESTAMP"),
    "coding_sessions": ("id LONG, started_at TIMESTAMP, ended_at TIMESTAMP, tool_calls LONG, tokens_returned LONG, tokens_equivalent LONG, category_data MAP<STRING, STRUCT<calls: LONG, returned: LONG, equivalent: LONG>>"),
    "instances": ("instance_id STRING, node_id STRING, coding_session_id LONG, started_at TIMESTAMP, ended_at TIMESTAMP, tool_calls LONG, tokens_returned LONG, tokens_equivalent LONG, cache_hits LONG, cache_misses LONG, "
        "category_data MAP<STRING, STRUCT<calls: LONG, returned: LONG, equivalent: LONG>>"
    ),
    "cluster_nodes": ("node_id STRING, role STRING, started_at TIMESTAMP, last_heartbeat TIMESTAMP"),
}

#: What a symbol may be.
SYMBOL_KINDS = ("function", "class", "method", "constant", "type", "template", "import")


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` in a table's declared columns, order and types; missing ones are null, others are left out."""
    declared = T.StructType.fromDDL(TABLES[table])
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared])


Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Migration:
    """A numbered change of the tables, and its undoing."""

    number: int
    name: str
    up: Callable[[Tables], Tables]
    down: Callable[[Tables], Tables] | None = None


def migrate(tables: Tables, migrations: Sequence[Migration], at: int, to: int | None = None) -> tuple[Tables, int]:
    """The tables at version ``to`` (by default the last), from version ``at``; writing them is the caller's step.

    Migrations run in order of their numbers, or back from the last one applied; one without a way back stops a rollback by an error.
    """
    steps = sorted(migrations, key=lambda m: m.number)
    if len({m.number for m in steps}) < len(steps):
        raise ValueError("migrations share a number")
    to = steps[-1].number if to is None and steps else at if to is None else to
    out = dict(tables)
    for m in steps if to >= at else reversed(steps):
        if at < m.number <= to:
            out = m.up(out)
        elif to < m.number <= at:
            if m.down is None:
                raise ValueError(f"migration {m.number} ({m.name}) can't be undone")
            out = m.down(out)
    return out, to


def add_column(table: str, column: str, kind: str) -> Callable[[Tables], Tables]:
    return lambda t: {**t, table: t[table].withColumn(column, F.lit(None).cast(kind))}


def drop_column(table: str, column: str) -> Callable[[Tables], Tables]:
    return lambda t: {**t, table: t[table].drop(column)}


def rename_column(table: str, old: str, new: str) -> Callable[[Tables], Tables]:
    return lambda t: {**t, table: t[table].withColumnRenamed(old, new)}


def rename_table(old: str, new: str) -> Callable[[Tables], Tables]:
    return lambda t: {new if n == old else n: df for n, df in t.items()}


def drop_table(name: str) -> Callable[[Tables], Tables]:
    return lambda t: {n: df for n, df in t.items() if n != name}

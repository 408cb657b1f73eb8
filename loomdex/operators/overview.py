"""Counts and summaries of repositories, libraries, workspaces and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import directory

MANIFEST_CHARS = 5_000


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(name))


def repo_stats(repos: DataFrame, files: DataFrame, symbols: DataFrame, sections: DataFrame) -> DataFrame:
    """``repos(id, ...)`` with ``files, symbols, sections``: each a count of its own, 0 where there are none.

    Symbols and sections are counted by file first, so what is joined to the repositories is a row a repository.
    """
    by_file = _counted(symbols, "file_id", "symbols").join(_counted(sections, "file_id", "sections"), "_key", "full")
    own = files.select(F.col("id").alias("_key"), "repo_id").join(by_file, "_key", "left")
    sums = own.groupBy(F.col("repo_id").alias("_repo")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("sections"), F.lit(0)).alias("sections"))
    return repos.join(sums, F.col("id") == F.col("_repo"), "left").drop("_repo").fillna(0, ["files", "symbols", "sections"])


def library_list(repos: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(id, manager, package, version, files, symbols)`` of the repositories that are libraries."""
    libraries = repos.filter(F.col("repo_type") == "library")
    stats = repo_stats(libraries, files, symbols, symbols.limit(0))
    return stats.select("id", F.col("package_manager").alias("manager"), F.col("package_name").alias("package"), "version", "files", "symbols")


def workspace_rollup(workspaces: DataFrame, workspace_repos: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(id, name, repos, files, symbols)``: a workspace's repositories and the sums over them."""
    stats = repo_stats(workspace_repos.select(F.col("repo_id").alias("id")).distinct(), files, symbols, symbols.limit(0))
    sums = (
        workspace_repos.distinct()
        .join(stats.withColumnRenamed("id", "repo_id"), "repo_id")
        .groupBy(F.col("workspace_id").alias("_key"))
        .agg(F.count(F.lit(1)).alias("repos"), F.sum("files").alias("files"), F.sum("symbols").alias("symbols"))
    )
    return workspaces.join(sums, F.col("id") == F.col("_key"), "left").select("id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("repos", "files", "symbols")])


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """``(column, n)``, the most frequent first, ties by value; nulls don't count."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def efficiency(returned: Column, equivalent: Column) -> Column:
    """Share of the equivalent tokens that weren't returned, in per cent; 0 without any."""
    return F.when(equivalent > 0, F.round((1 - returned / equivalent) * 100, 1)).otherwise(0.0)


def overview(repos: DataFrame, files: DataFrame, symbols: DataFrame, sections: DataFrame, sessions: DataFrame, instances: DataFrame) -> DataFrame:
    """One row: grand totals of the index, and calls and efficiency over sessions and the instances that still live.

    Instances that ended are part of their session's counters, so only those without an end are added.
    """
    stats = repo_stats(repos, files, symbols, sections).agg(F.count(F.lit(1)).alias("repos"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "symbols", "sections")])
    counters = ("tool_calls", "tokens_returned", "tokens_equivalent")
    both = sessions.select(*counters).union(instances.filter("ended_at IS NULL").select(*counters))
    used = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]).withColumn("reduction", efficiency(F.col("tokens_returned"), F.col("tokens_equivalent")))
    return stats.crossJoin(used)  # a row each


def merge_categories(rows: DataFrame, key: str | None = None, data: str = "category_data") -> DataFrame:
    """``(key, category_data)``: nested counters ``map<string, struct<calls, returned, equivalent>>`` summed by category."""
    keys = [key] if key else []
    each = rows.select(*keys, F.explode(data).alias("category", "c"))
    sums = each.groupBy(*keys, "category").agg(*[F.coalesce(F.sum(f"c.{c}"), F.lit(0)).alias(c) for c in ("calls", "returned", "equivalent")])
    pairs = F.array_sort(F.collect_list(F.struct("category", F.struct("calls", "returned", "equivalent").alias("counters"))))  # categories are few
    return sums.groupBy(*keys).agg(F.map_from_entries(pairs).alias(data))


def severity_counts(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """One row with the number of findings of each severity and in all."""
    names = ("critical", "high", "medium", "low")
    return findings.agg(*[F.count_if(F.col(severity) == s).alias(s) for s in names], F.count(F.lit(1)).alias("total"))


def coverage_percent(metrics: DataFrame) -> DataFrame:
    """One row: percentages of symbols with docs, types and tests; 0 without symbols."""
    n = F.count(F.lit(1))
    return metrics.agg(*[F.coalesce(F.round(100 * F.count_if(F.col(f"has_{c}")) / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias(f"{c}_percent") for c in ("docs", "types", "tests")], n.alias("symbols"))


def briefing(repo_id: int, files: DataFrame, symbols: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row: files, symbols, languages and directories with their counts, and the manifests' texts up to ``MANIFEST_CHARS`` each."""
    own = files.filter(F.col("repo_id") == repo_id)
    n_symbols = symbols.join(own.select(F.col("id").alias("file_id")), "file_id").agg(F.count(F.lit(1)).alias("symbols"))

    def counts(column: Column, name: str) -> DataFrame:
        groups = own.groupBy(column.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("k IS NOT NULL")
        return groups.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))  # languages, directories of one repository

    texts = manifests.filter(F.col("repo_id") == repo_id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.substring("content", 1, MANIFEST_CHARS).alias("content"))))).alias("manifests"))
    out = own.agg(F.count(F.lit(1)).alias("files"))
    for part in (n_symbols, counts(F.col("language"), "languages"), counts(directory(F.col("path")), "directories"), texts):
        out = out.crossJoin(part)  # a row each
    return out


def stale_repos(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """``(id, name, indexed_head, head, status)``: fresh, stale, or unknown where ``heads(source_path, head)`` has none."""
    status = F.when(F.col("head").isNull() | F.col("git_head").isNull(), "unknown").when(F.col("head") == F.col("git_head"), "fresh").otherwise("stale")
    return repos.join(heads, "source_path", "left").select("id", "name", F.col("git_head").alias("indexed_head"), "head", status.alias("status"))


def duration(started: Column, ended: Column) -> Column:
    """Seconds between two times as ``1h 2m 3s``, without leading units that are 0; null if either is."""
    s = F.unix_timestamp(ended) - F.unix_timestamp(started)
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    text = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h "))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m "))).otherwise(""), r.cast("string"), F.lit("s"))
    return F.when(s.isNotNull(), text)


def recent(rows: DataFrame, by: str, *order: Column, most: int = 20) -> DataFrame:
    """The last ``most`` rows of each key with ``back``, 1 for the last."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= most)


def working_files(accesses: DataFrame, most: int = 10) -> DataFrame:
    """``(path, last_access)`` of the files used last."""
    return accesses.groupBy("path").agg(F.max("ts").alias("last_access")).orderBy(F.col("last_access").desc(), "path").limit(most)


def unexplored(files: DataFrame, seen: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """``(path, symbols)`` of the files with most symbols that a session hasn't seen."""
    n = _counted(symbols, "file_id", "symbols")
    fresh = files.join(seen.select("path").distinct(), "path", "left_anti")
    return fresh.join(n, F.col("id") == F.col("_key")).select("path", "symbols").orderBy(F.col("symbols").desc(), "path").limit(most)


def to_embed(rows: DataFrame, vectors: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, text)`` of rows that have no vector yet; blank texts have none to make."""
    return rows.join(vectors.select(key).distinct(), key, "left_anti").select(key, text.alias("text")).filter(F.length(F.trim("text")) > 0)


def embed(rows: DataFrame, key: str, model, batch: int = 256) -> DataFrame:
    """``(key, embedding)`` of ``rows(key, text)``: ``model(list of texts)`` gives a matrix, ``batch`` texts at a time."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "embedding": [[float(x) for x in v] for v in model(part["text"].tolist())]})

    return rows.select(key, "text").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def column_matches(providers: list[DataFrame]) -> DataFrame:
    """Matches of several providers in one list, best first; a column that several know is kept with its best score."""
    both = providers[0]
    for p in providers[1:]:
        both = both.unionByName(p)
    best = both.groupBy("model", "column").agg(F.max(F.struct("score", "description")).alias("b"))
    return best.select("model", "column", "b.description", "b.score").orderBy(F.col("score").desc(), "model", "column")


def entry_points(symbols: DataFrame, most: int = 20) -> DataFrame:
    """``(symbol_id, name, path)`` of functions and classes where reading may begin: entry points by name or file, private ones aside."""
    from loomdex.operators.quality import is_entry_point

    public = symbols.filter(F.col("kind").isin("function", "class") & ~F.col("name").startswith("_") & ~F.col("name").startswith("test_") & ~F.col("name").startswith("Test"))
    return public.filter(is_entry_point(F.col("name"), F.col("path"))).select("symbol_id", "name", "path").orderBy("path", "symbol_id").limit(most)

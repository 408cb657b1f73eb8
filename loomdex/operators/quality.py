"""Quality metrics, smells, duplicates, dead code, security, coverage, hotspots and the quality gate."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import estimated_complexity, has_types, naive_params, normalized_body, short_hash
from loomdex.operators.diff import containing

SEVERITIES = ("critical", "high", "medium", "low")
#: Rule, severity, pattern and message of the security scan.
SECURITY_RULES = (
    ("eval_usage", "critical", r"\beval\s*\(", "Use of eval() — arbitrary code execution risk"),
    ("exec_usage", "critical", r"\bexec\s*\(", "Use of exec() — arbitrary code execution risk"),
    ("shell_injection", "high", r"subprocess\.\w+\([^)]*shell\s*=\s*True", "subprocess with shell=True — command injection risk"),
    ("pickle_load", "high", r"pickle\.loads?\s*\(", "Deserialization of untrusted data via pickle"),
    ("yaml_unsafe_load", "high", r"yaml\.load\s*\([^)]*(?!Loader)", "yaml.load without SafeLoader — code execution risk"),
    ("sql_concatenation", "high", r"(?:execute|cursor\.execute)\s*\(\s*[f\"'].*\{", "SQL string concatenation — SQL injection risk"),
    ("hardcoded_password", "medium", r"(?i)(?:password|passwd|pwd|secret|token|api_key)\s*=\s*[\"'][^\"']{4,}[\"']", "Hardcoded secret in source code"),
    ("md5_usage", "medium", r"(?:md5|MD5)\s*\(", "MD5 is cryptographically broken — use SHA-256+"),
    ("assert_in_production", "low", r"(?m)^\s*assert\s+(?!.*#\s*noqa)", "assert statements are stripped in optimized mode (-O)"),
    ("broad_except", "low", r"(?m)except\s*:\s*$", "Bare except catches KeyboardInterrupt and SystemExit"),
)
#: Texts of which a file must hold one, in any case, for a rule to match at all.
RULE_WORDS = {
    "eval_usage": ("eval",), "exec_usage": ("exec",), "shell_injection": ("subprocess.",), "pickle_load": ("pickle.load",), "yaml_unsafe_load": ("yaml.load",), "sql_concatenation": ("execute",),
    "hardcoded_password": ("password", "passwd", "pwd", "secret", "token", "api_key"), "md5_usage": ("md5",), "assert_in_production": ("assert",), "broad_except": ("except",),
}
#: Names and files that count as entry points.
ENTRY_NAMES = ("main", "__init__", "__main__", "setup", "teardown")
ENTRY_FILES = ("__main__.py", "cli.py", "server.py", "app.py")
NOQA = "noqa"


def is_test_path(path: Column) -> Column:
    """Paths with "test" or "spec" anywhere in them, whatever the case."""
    return path.ilike("%test%") | path.ilike("%spec%")


def metrics(symbols: DataFrame, sources: DataFrame, test_contents: DataFrame) -> DataFrame:
    """``(symbol_id, has_tests, has_docs, has_types, complexity)``.

    A symbol has tests if its name is among the words of three characters or more of any ``test_contents(content)``.
    """
    words = test_contents.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?U)\b\w{3,}\b"), F.lit(0)))).alias("name")).distinct().withColumn("_tested", F.lit(True))
    joined = symbols.join(words, "name", "left").join(sources, "symbol_id", "left")
    stored = F.coalesce(F.col("cyclomatic"), F.lit(0))
    return joined.select(
        "symbol_id",
        F.coalesce("_tested", F.lit(False)).alias("has_tests"),
        F.coalesce(F.length(F.trim("docstring")) > 10, F.lit(False)).alias("has_docs"),
        has_types(F.col("signature")).alias("has_types"),
        F.when(stored > 0, stored).otherwise(F.coalesce(estimated_complexity(F.col("source")), F.lit(1))).alias("complexity"),
    )


def low_quality(quality: DataFrame, complexity: int, limit: int) -> DataFrame:
    bad = ~F.col("has_tests") | ~F.col("has_docs") | (F.col("complexity") >= complexity)
    return quality.filter(bad).orderBy(F.col("complexity").desc(), "symbol_id").limit(limit)


def smells(symbols: DataFrame) -> DataFrame:
    """``(symbol_id, path, smell, severity, value)`` of ``symbols`` joined with their files' paths, tests aside."""
    code = symbols.filter(~is_test_path(F.col("path")))
    callable_ = F.col("kind").isin("function", "method")
    lines, arity = F.col("line_end") - F.col("line_start") + 1, naive_params(F.coalesce("signature", F.lit("")))
    public = ~F.col("name").startswith("_")

    def smell(when: Column, name: str, severity: Column | str, value: Column) -> Column:
        s = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(name).alias("smell"), s.alias("severity"), value.cast("long").alias("value")))

    none = F.lit(None).cast("long")
    found = F.array(
        smell(callable_ & (arity > 8), "too_many_parameters", "medium", arity),
        smell(callable_ & (lines > 200), "too_long", F.when(lines > 400, "high").otherwise("medium"), lines),
        smell(public & F.col("kind").isin("function", "method", "class") & (F.coalesce(F.length(F.trim("docstring")), F.lit(0)) == 0), "missing_docstring", "low", none),
        smell(callable_ & public & ~F.contains(F.coalesce("signature", F.lit("")), F.lit("->")), "missing_return_type", "low", none),
    )
    own = code.select("symbol_id", "path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("symbol_id", "path", "f.*")
    methods = code.filter(F.col("kind") == "method").groupBy("parent_symbol_id").agg(F.count(F.lit(1)).alias("value")).filter("value > 20").withColumnRenamed("parent_symbol_id", "_class")
    big = code.filter(F.col("kind") == "class").join(methods, F.col("symbol_id") == F.col("_class")).select("symbol_id", "path", F.lit("too_many_methods").alias("smell"), F.lit("medium").alias("severity"), "value")
    return own.union(big)


def duplicates(functions: DataFrame, min_lines: int = 5) -> DataFrame:
    """``(hash, members, line_count, symbol_ids)`` of ``functions(symbol_id, source, line_count)`` with equal normalised bodies, longest first."""
    keyed = functions.filter(F.col("line_count") >= min_lines).withColumn("hash", short_hash(normalized_body(F.col("source"))))
    # a group's members meet in its row, as the report lists them; ``duplicate_members`` gives them as rows
    groups = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("members"), F.max("line_count").alias("line_count"), F.array_sort(F.collect_list("symbol_id")).alias("symbol_ids"))
    return groups.filter("members >= 2").orderBy(F.col("line_count").desc(), "hash")


def duplicate_members(functions: DataFrame, min_lines: int = 5) -> DataFrame:
    """``(symbol_id, hash, members)`` of functions whose normalised body others share; no group is gathered, however large."""
    keyed = functions.filter(F.col("line_count") >= min_lines).select("symbol_id", short_hash(normalized_body(F.col("source"))).alias("hash"))
    sizes = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")
    return keyed.join(sizes, "hash").select("symbol_id", "hash", "members")


def is_entry_point(name: Column, path: Column) -> Column:
    private = name.startswith("_") & ~name.startswith("__")
    file = F.lit(False)
    for f in ENTRY_FILES:
        file = file | path.endswith(f)
    return name.isin(*ENTRY_NAMES) | name.startswith("test_") | name.startswith("Test") | file | private


def dead_code(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Functions, methods and classes that nothing refers to, entry points aside; none if there are no references at all."""
    used = references.filter("target_symbol_id IS NOT NULL").select(F.col("target_symbol_id").alias("symbol_id")).distinct()
    if used.isEmpty():
        return symbols.limit(0)
    return symbols.filter(F.col("kind").isin("function", "method", "class") & ~is_entry_point(F.col("name"), F.col("path"))).join(used, "symbol_id", "left_anti")


def security_scan(files: DataFrame) -> DataFrame:
    """``(path, line, rule, severity, message, snippet)`` of ``files(path, language, content)``, tests aside.

    A match counts on the line where it begins, whole patterns that span lines included.  Everything happens inside the
    file's row; only findings, with their line, become rows.
    """
    code = files.filter(F.col("language").isNotNull() & ~is_test_path(F.col("path"))).select("path", "content", F.lower("content").alias("_low"))
    lines = F.split("content", "\n")

    def findings(rule: str, severity: str, pattern: str, message: str) -> Column:
        made = F.transform(_line_starts(pattern), lambda i: F.struct(i.alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.element_at(lines, i).alias("own")))
        # nearly all files have no match, which a search for the rule's words tells, or one for the pattern
        held = reduce(operator.or_, (F.contains("_low", F.lit(w)) for w in RULE_WORDS[rule]))
        return F.when(held, F.when(F.col("content").rlike(pattern), made))

    none = F.array().cast("array<struct<line:int,rule:string,severity:string,message:string,own:string>>")
    each = code.select("path", F.explode(F.concat(*[F.coalesce(findings(*r), none) for r in SECURITY_RULES])).alias("f"))
    own = F.col("f.own")
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    found = each.filter(~F.contains(own, F.lit(NOQA))).select("path", "f.line", "f.rule", "f.severity", "f.message", F.substring(F.trim(own), 1, 120).alias("snippet"))
    return found.orderBy(rank, "path", "line", "rule")


def _line_starts(pattern: str) -> Column:
    """Lines, from 1, on which the matches of a pattern in ``content`` begin: a mark is put before each match, and marked lines are picked."""
    mark = "\uffff"
    flags, rest = (pattern[:4], pattern[4:]) if pattern.startswith("(?") and not pattern.startswith("(?:") else ("", pattern)
    marked = F.split(F.regexp_replace(F.translate("content", mark, " "), f"{flags}(?={rest})", mark), "\n")
    return F.filter(F.transform(marked, lambda x, i: F.when(F.contains(x, F.lit(mark)), i + 1)), lambda x: x.isNotNull())


def coverage(symbols: DataFrame, called: DataFrame, specifiers: DataFrame) -> DataFrame:
    """``symbols(symbol_id, name, module)`` with ``covered``: called by name in tests, and its module contains, or is contained in, an imported specifier.

    Distinct modules and specifiers meet by equi-joins on the beginnings of what they contain, in either direction.
    """
    mods, spec = symbols.select("module").filter("module IS NOT NULL").distinct(), specifiers.select("specifier").filter("specifier IS NOT NULL").distinct()
    in_module = containing(mods.withColumnRenamed("module", "whole"), spec.withColumnRenamed("specifier", "part")).select(F.col("whole").alias("module"))
    in_specifier = containing(spec.withColumnRenamed("specifier", "whole"), mods.withColumnRenamed("module", "part")).select(F.col("part").alias("module"))
    imported = in_module.union(in_specifier).distinct().withColumn("_imported", F.lit(True))
    names = called.select("name").distinct().withColumn("_called", F.lit(True))
    out = symbols.join(names, "name", "left").join(imported, "module", "left")
    return out.withColumn("covered", F.col("_called").isNotNull() & F.col("_imported").isNotNull()).drop("_called", "_imported")


def quality_gate(test_percent: Column, docs_percent: Column, severe: Column, severe_smells: Column, min_tests: float = 60, min_docs: float = 80, most_severe: int = 0, most_smells: int = 0) -> Column:
    """Names of the failed checks."""
    checks = ((test_percent < min_tests, "test_coverage"), (docs_percent < min_docs, "doc_coverage"), (severe > most_severe, "security"), (severe_smells > most_smells, "smells"))
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def hotspot_score(cyclomatic: Column, commits: Column) -> Column:
    return F.round(cyclomatic * F.log1p(commits), 2)


def hotspot_level(score: Column) -> Column:
    return F.when(score <= 3, "low").when(score <= 10, "medium").otherwise("high")


def hotspots(symbols: DataFrame, churn: DataFrame, limit: int = 20, pool: int = 200) -> DataFrame:
    """Top ``limit`` by score among the ``pool`` most complex symbols."""
    first = symbols.orderBy(F.col("cyclomatic").desc(), "symbol_id").limit(pool)
    scored = first.join(churn, "path", "left").withColumn("score", hotspot_score(F.col("cyclomatic"), F.coalesce("commits", F.lit(0))))
    return scored.withColumn("level", hotspot_level(F.col("score"))).orderBy(F.col("score").desc(), "symbol_id").limit(limit)


def churn(commits: DataFrame, days: int) -> DataFrame:
    """``(path, commits, authors, first_seen, last_seen, per_week, level)`` of ``commits(path, author, ts)``."""
    out = commits.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("authors"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    per_week = F.round(F.col("commits") / max(1.0, days / 7), 2)
    return out.withColumn("per_week", per_week).withColumn("level", F.when(per_week <= 1, "stable").when(per_week <= 3, "active").otherwise("volatile"))


def blame_latest(blame: DataFrame) -> DataFrame:
    """The most recent commit over each symbol's lines."""
    w = Window.partitionBy("symbol_id").orderBy(F.col("commit_date").desc(), "commit_hash")
    return blame.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def popular_classes(symbols: DataFrame, limit: int = 10) -> DataFrame:
    kids = symbols.filter(F.col("kind") == "method").groupBy(F.col("parent_symbol_id").alias("_class")).agg(F.count(F.lit(1)).alias("methods"))
    return symbols.filter(F.col("kind") == "class").join(kids, F.col("symbol_id") == F.col("_class"), "left").select("symbol_id", "name", F.coalesce("methods", F.lit(0)).alias("methods")).orderBy(F.col("methods").desc(), "symbol_id").limit(limit)

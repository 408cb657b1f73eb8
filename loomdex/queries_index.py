"""Queries of the code-index operators over an index made of whole test tables, each with the SQL that must give the same rows.

``documents`` are the files: their text is the content (letters beyond ASCII are ``_``, as DuckDB's word boundaries know no others), sources are repositories.  Every file imports the files of half and a third of its
number, has a function named by its first word, a class that extends the class of half its number, and some methods.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import diff, graph, mutate, overview, positions, quality, retrieval, search_index, segments, stored, suppression, text_index, ts_rank, vector_index
from loomdex.plans.lineage import cut, shared_dir
from loomdex.plans.query import Query, Relation
from loomdex.plans.scopes import INSTANCE_SCOPES, NODE_SCOPES, REPO_SCOPES, present, section_scopes, symbol_scopes
from loomdex.plans.shipping import shipped
from loomdex.queries import ORACLE_SQL as CORE_SQL
from loomdex.queries import SEARCH, Tables
from loomdex.schema import Migration, add_column, conform, drop_column, migrate, rename_column
from loomdex.sources import code, documents, manifests, tables
from loomdex.sources import files as S
from loomdex.streaming import lifetimes, usage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class Code:
    """The code index of a folder's tables."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.t = spark, Tables(spark, sf)

    @cached_property
    def files(self) -> DataFrame:
        test = F.when(F.col("doc_id") % 7 == 0, "tests/test_m").otherwise("pkg/m")
        return self.t.documents.select(
            F.col("doc_id").alias("id"), F.substring("source", 4, 9).cast("long").alias("repo_id"), F.concat("source", F.lit("/"), test, F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
            F.col("lang").alias("language"), F.regexp_replace("text", r"[^\x00-\x7F]", "_").alias("content"), F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("byte_size"),
        )

    @cached_property
    def repos(self) -> DataFrame:
        r = self.t.documents.select(F.col("source").alias("name")).distinct().withColumn("id", F.substring("name", 4, 9).cast("long"))
        kind = F.when(F.col("id") % 4 == 0, "library").otherwise("local")
        package = [F.when(F.col("id") % 4 == 0, v).alias(c) for c, v in (("package_manager", F.lit("pip")), ("package_name", F.col("name")), ("version", F.concat(F.lit("1."), F.col("id").cast("string"))))]
        return r.select("id", "name", F.concat(F.lit("/src/"), "name").alias("source_path"), F.when(F.col("id") % 5 != 0, F.md5("name")).alias("git_head"), kind.alias("repo_type"), *package)

    @cached_property
    def imports(self) -> DataFrame:
        d = F.col("doc_id")
        each = self.t.documents.filter("doc_id > 0").select("doc_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("k"))
        to = F.floor(d / F.col("k"))
        return each.select(
            (d * 4 + F.col("k")).alias("id"), d.alias("file_id"), F.concat(F.lit("pkg.m"), to.cast("string")).alias("specifier"), F.when(d % 3 != 0, F.array(F.concat(F.lit("C"), to.cast("string")))).alias("names"), F.when(d % 11 != 0, to).alias("resolved_file_id")
        )

    @cached_property
    def symbols(self) -> DataFrame:
        d = F.col("doc_id")
        word = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
        rows = self.t.documents.select("doc_id", "lang", word.alias("word"), "n_chars")
        one = F.struct(
            F.lit(0).alias("n"), F.lit("function").alias("kind"), F.col("word").alias("name"), F.concat(F.lit("def "), "word", F.lit("(a, b)"), F.when(d % 2 == 0, " -> int").otherwise("")).alias("signature"), F.lit(1).alias("line_start"), (F.col("n_chars") % 500 + 1).cast("int").alias("line_end")
        )
        two = F.struct(
            F.lit(1).alias("n"), F.lit("class").alias("kind"), F.concat(F.lit("C"), d.cast("string")).alias("name"), F.concat(F.lit("class C"), d.cast("string"), F.lit("(C"), F.floor(d / 2).cast("string"), F.lit(", Base):")).alias("signature"), F.lit(600).alias("line_start"), F.lit(700).alias("line_end")
        )
        some = F.transform(
            F.when(d % 25 > 0, F.sequence(F.lit(1), (d % 25).cast("int"))).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct((i + 1).alias("n"), F.lit("method").alias("kind"), F.concat(F.lit("_"), F.lit("get_"), i.cast("string")).alias("name"), F.lit("def get(self, a, b, c, d, e, f, g, h, i)").alias("signature"), (i + 600).alias("line_start"), (i + 600).alias("line_end")),
        )
        each = rows.select("doc_id", "lang", "n_chars", F.explode(F.concat(F.array(one, two), some)).alias("s"))
        sid = F.concat(F.lit("s"), d.cast("string"), F.lit("."), F.col("s.n").cast("string"))
        return each.select(
            (d * 32 + F.col("s.n")).alias("id"), d.alias("file_id"), sid.alias("symbol_id"), "s.name", F.concat(F.lit("m"), d.cast("string"), F.lit("."), "s.name").alias("qualified_name"), "s.kind", F.col("lang").alias("language"), "s.signature",
            F.when((d + F.col("s.n")) % 3 == 0, F.lit("Says what this does.")).alias("docstring"), F.when(F.col("s.n") > 1, F.concat(F.lit("s"), d.cast("string"), F.lit(".1"))).alias("parent_symbol_id"), "s.line_start", "s.line_end",
            F.when(F.col("s.n") == 0, F.col("n_chars") % 40).otherwise(F.col("s.n")).cast("int").alias("cyclomatic"),
        )

    @cached_property
    def references(self) -> DataFrame:
        d = F.col("doc_id")
        rows = self.t.documents.filter("doc_id > 0")
        to = F.concat(F.lit("s"), F.floor(d / 2).cast("string"), F.lit(".0"))
        return rows.select(F.concat(F.lit("s"), d.cast("string"), F.lit(".0")).alias("source_symbol_id"), F.when(d % 5 != 0, to).alias("target_symbol_id"), F.concat(F.lit("pkg.m"), F.floor(d / 2).cast("string")).alias("target_specifier"), (d % 100).cast("int").alias("line"))

    @cached_property
    def sections(self) -> DataFrame:
        c = F.col("conv_id").cast("string")
        level = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(4)
        return self.t.conversations.select(
            F.col("conv_id").alias("file_id"), F.concat(c, F.lit("#"), F.col("turn").cast("string")).alias("section_id"), F.substring("text", 1, 20).alias("title"), level.alias("level"), F.when(F.col("turn") > 0, F.concat(c, F.lit("#0"))).alias("parent_section_id"),
            F.when(F.col("turn") % 2 == 0, F.col("role")).alias("summary"), F.col("text").alias("content"), "turn",
        )

    @cached_property
    def workspaces(self) -> DataFrame:
        return self.t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def workspace_repos(self) -> DataFrame:
        return self.t.nation.select(F.col("n_regionkey").cast("long").alias("workspace_id"), F.col("n_nationkey").cast("long").alias("repo_id"))

    @cached_property
    def instances(self) -> DataFrame:
        e, at = F.col("event_id"), F.col("ts")
        return self.t.events.select(
            F.concat(F.lit("i"), e.cast("string")).alias("instance_id"), F.col("user_id").alias("coding_session_id"), at.alias("started_at"), F.when(e % 3 != 0, at + F.expr("make_dt_interval(0, 0, 0, cast(event_id * 37 % 9000 as int))")).alias("ended_at"),
            (e % 17).alias("tool_calls"), (e % 1000).alias("tokens_returned"), (e % 5000).alias("tokens_equivalent"), F.col("event_type"),
        )


_FILES = """files AS (SELECT doc_id AS id, CAST(substring(source, 4) AS BIGINT) AS repo_id, source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/test_m' ELSE 'pkg/m' END || doc_id || '.py' AS path, lang AS language, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS content, sha256(text) AS content_hash, n_chars AS byte_size FROM documents)"""
_REPOS = """repos AS (SELECT id, name, '/src/' || name AS source_path, CASE WHEN id % 5 <> 0 THEN md5(name) END AS git_head, CASE WHEN id % 4 = 0 THEN 'library' ELSE 'local' END AS repo_type, CASE WHEN id % 4 = 0 THEN 'pip' END AS package_manager,
 CASE WHEN id % 4 = 0 THEN name END AS package_name, CASE WHEN id % 4 = 0 THEN '1.' || id END AS version FROM (SELECT DISTINCT source AS name, CAST(substring(source, 4) AS BIGINT) AS id FROM documents))"""
_IMPORTS = """imports AS (SELECT doc_id * 4 + k AS id, doc_id AS file_id, 'pkg.m' || (doc_id // k) AS specifier, CASE WHEN doc_id % 3 <> 0 THEN ['C' || (doc_id // k)] END AS names, CASE WHEN doc_id % 11 <> 0 THEN doc_id // k END AS resolved_file_id FROM documents, (VALUES (2), (3)) v(k) WHERE doc_id > 0)"""
_SYMBOLS = """raw AS (SELECT doc_id, lang, n_chars, regexp_extract(text, '[A-Za-z]{3,}') AS word FROM documents),
symbols AS (SELECT doc_id * 32 + n AS id, doc_id AS file_id, 's' || doc_id || '.' || n AS symbol_id, name, 'm' || doc_id || '.' || name AS qualified_name, kind, lang AS language, signature, CASE WHEN (doc_id + n) % 3 = 0 THEN 'Says what this does.' END AS docstring,
 CASE WHEN n > 1 THEN 's' || doc_id || '.1' END AS parent_symbol_id, line_start, line_end, CAST(CASE WHEN n = 0 THEN n_chars % 40 ELSE n END AS INTEGER) AS cyclomatic FROM (
 SELECT doc_id, lang, n_chars, 0 AS n, 'function' AS kind, word AS name, 'def ' || word || '(a, b)' || CASE WHEN doc_id % 2 = 0 THEN ' -> int' ELSE '' END AS signature, 1 AS line_start, n_chars % 500 + 1 AS line_end FROM raw
 UNION ALL SELECT doc_id, lang, n_chars, 1, 'class', 'C' || doc_id, 'class C' || doc_id || '(C' || (doc_id // 2) || ', Base):', 600, 700 FROM raw
 UNION ALL SELECT doc_id, lang, n_chars, i + 1, 'method', '_get_' || i, 'def get(self, a, b, c, d, e, f, g, h, i)', i + 600, i + 600 FROM (SELECT *, unnest(range(1, doc_id % 25 + 1)) AS i FROM raw)))"""
_REFERENCES = """refs AS (SELECT 's' || doc_id || '.0' AS source_symbol_id, CASE WHEN doc_id % 5 <> 0 THEN 's' || (doc_id // 2) || '.0' END AS target_symbol_id, 'pkg.m' || (doc_id // 2) AS target_specifier, CAST(doc_id % 100 AS INTEGER) AS line FROM documents WHERE doc_id > 0)"""
_SECTIONS = """sections AS (SELECT conv_id AS file_id, conv_id || '#' || turn AS section_id, substring(text, 1, 20) AS title, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 4 END AS level, CASE WHEN turn > 0 THEN conv_id || '#0' END AS parent_section_id, CASE WHEN turn % 2 = 0 THEN role END AS summary, text AS content, turn FROM conversations)"""
_INSTANCES = """instances AS (SELECT 'i' || event_id AS instance_id, user_id AS coding_session_id, ts AS started_at, CASE WHEN event_id % 3 <> 0 THEN ts + to_seconds(event_id * 37 % 9000) END AS ended_at, event_id % 17 AS tool_calls, event_id % 1000 AS tokens_returned, event_id % 5000 AS tokens_equivalent, event_type FROM events)"""
_TEST = "(path ILIKE '%test%' OR path ILIKE '%spec%')"
_WORD_HITS = "CAST(len(regexp_extract_all(content, '\\b' || {} || '\\b')) AS INTEGER)"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n"


# impact and the import graph

_RADIUS = """seed AS (SELECT DISTINCT t.target, i.file_id AS id FROM targets t JOIN imports i ON i.resolved_file_id = t.target OR contains(lower(i.specifier), lower(regexp_replace(regexp_extract(t.path, '[^/]+$'), '\\.[^.]*$', ''))) WHERE i.file_id <> t.target),
two AS (SELECT DISTINCT s.target, i.file_id AS id FROM seed s JOIN imports i ON i.resolved_file_id = s.id WHERE i.file_id <> s.target AND NOT EXISTS (SELECT 1 FROM seed x WHERE x.target = s.target AND x.id = i.file_id)),
reached AS (SELECT *, 1 AS depth FROM seed UNION ALL SELECT *, 2 FROM two),
kinds AS (SELECT t.target, t.name, f.id, f.path, f.repo_id, r.depth, len(regexp_extract_all(f.content, '\\b' || t.name || '\\b')) AS hits, f.repo_id <> t.repo_id AS cross_repo FROM reached r JOIN targets t ON t.target = r.target JOIN files f ON f.id = r.id)"""
_CAPPED = """SELECT {out}CAST(id AS BIGINT) AS id, path, CAST(depth AS INTEGER) AS depth, CAST(hits AS INTEGER) AS hits, CASE WHEN hits > 0 THEN 'confirmed' ELSE 'potential' END AS kind, count(*) OVER (PARTITION BY target, name, hits > 0) AS total, cross_repo FROM kinds
QUALIFY row_number() OVER (PARTITION BY target, name, hits > 0 ORDER BY depth, path) <= 25"""


@query(_with(_FILES, _IMPORTS, "targets AS (SELECT id AS target, path, repo_id, 'the' AS name FROM files WHERE id = 3)", _RADIUS) + _CAPPED.format(out=""))
def blast_radius_capped(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    return graph.blast_radius(c.files, c.imports, 3, "the", 2).select("id", "path", "depth", "hits", "kind", "total", "cross_repo")


@query(
    _with(_FILES, _IMPORTS, "asked AS (SELECT item_id AS target, 'and' AS name FROM benchmark UNION ALL SELECT -1, 'and')", "targets AS (SELECT a.target, f.path, f.repo_id, a.name FROM asked a JOIN files f ON f.id = a.target)", _RADIUS)
    + "SELECT *, NULL AS error FROM ("
    + _CAPPED.format(out="target, name, ")
    + ") UNION ALL SELECT target, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unknown target' FROM asked WHERE target NOT IN (SELECT id FROM files)"
)
def blast_radius_batch(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    targets = c.t.benchmark.select(F.col("item_id").alias("target")).union(spark.range(1).select(F.lit(-1).cast("long"))).withColumn("name", F.lit("and"))
    return graph.blast_radii(c.files, c.imports, targets).select("target", "name", "id", "path", "depth", "hits", "kind", "total", "cross_repo", "error")


@query(
    _with(_FILES, _IMPORTS, _SYMBOLS, "n AS (SELECT file_id, count(*) AS symbol_count FROM symbols GROUP BY 1)", "d AS (SELECT DISTINCT resolved_file_id AS target, file_id AS id FROM imports WHERE resolved_file_id IS NOT NULL)", "t AS (SELECT id AS target FROM files UNION ALL SELECT -5)")
    + "SELECT t.target, d.id, f.path, CAST(coalesce(n.symbol_count, 0) AS BIGINT) AS symbol_count, coalesce(d.id IN (SELECT target FROM d), false) AS has_importers FROM t LEFT JOIN d ON d.target = t.target LEFT JOIN files f ON f.id = d.id LEFT JOIN n ON n.file_id = d.id"
)
def importers_of_files(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    counts = c.symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("symbol_count"))
    targets = c.files.select(F.col("id").alias("target")).union(spark.range(1).select(F.lit(-5).cast("long")))
    return graph.importers(c.files, c.imports, targets, counts)


@query(
    _with(
        _SYMBOLS,
        "e AS (SELECT 'C' || doc_id AS child, unnest(['C' || (doc_id // 2), 'Base']) AS parent FROM raw)",
        "up(name, depth) AS (SELECT parent, 1 FROM e WHERE child = 'C37' UNION SELECT e.parent, depth + 1 FROM up JOIN e ON e.child = up.name WHERE depth < 40 AND up.name <> e.parent)",
        "down(name, depth) AS (SELECT child, 1 FROM e WHERE parent = 'C37' UNION SELECT e.child, depth + 1 FROM down JOIN e ON e.parent = down.name WHERE depth < 40 AND e.child <> down.name)",
        "a AS (SELECT name, min(depth) AS depth, 'ancestor' AS relation FROM up GROUP BY 1 UNION ALL SELECT name, min(depth), 'descendant' FROM down GROUP BY 1)",
        "s AS (SELECT name, min(symbol_id) AS symbol_id FROM symbols WHERE kind = 'class' GROUP BY 1)",
        recursive=True,
    )
    + "SELECT name, CAST(depth AS INTEGER) AS depth, relation, coalesce(symbol_id, '(external)') AS location FROM a LEFT JOIN s USING (name) WHERE name <> 'C37'"
)
def class_ancestors_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return graph.class_hierarchy(Code(spark, sf).symbols, "C37")


@query(_with(_SYMBOLS) + "SELECT 'C' || doc_id AS child, parent FROM (SELECT doc_id, unnest(['C' || (doc_id // 2), 'Base']) AS parent FROM raw)")
def base_class_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hierarchy_edges(Code(spark, sf).symbols)


@query(
    _with(_FILES, _IMPORTS, _SYMBOLS)
    + f"""SELECT DISTINCT coalesce(h.head, '__file__:' || f.path) AS source_symbol_id, s.symbol_id AS target_symbol_id, i.specifier AS target_specifier FROM imports i JOIN symbols s ON s.file_id = i.resolved_file_id JOIN files f ON f.id = i.file_id
LEFT JOIN (SELECT file_id, arg_min(symbol_id, id) AS head FROM symbols GROUP BY 1) h ON h.file_id = i.file_id WHERE CASE WHEN i.names IS NOT NULL THEN list_contains(i.names, s.name) ELSE {_WORD_HITS.format("s.name")} > 0 END"""
)
def reference_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    contents = c.files.select("content_hash", "content").dropDuplicates(["content_hash"])
    return graph.reference_graph(c.files.drop("content"), c.symbols, c.imports, contents)


@query(
    _with(_FILES, _SYMBOLS, _REFERENCES)
    + """SELECT 'caller' AS side, r.source_symbol_id AS symbol_id, s.name, s.kind, f.path, r.line FROM refs r LEFT JOIN symbols s ON s.symbol_id = r.source_symbol_id LEFT JOIN files f ON f.id = s.file_id WHERE r.target_symbol_id = 's4.0'
UNION ALL SELECT 'callee', r.target_symbol_id, s.name, s.kind, f.path, r.line FROM refs r LEFT JOIN symbols s ON s.symbol_id = r.target_symbol_id LEFT JOIN files f ON f.id = s.file_id WHERE r.source_symbol_id = 's4.0'"""
)
def callers_and_callees(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    a = graph.callers(c.references, c.symbols, c.files, "s4.0").select(F.lit("caller").alias("side"), F.col("source_symbol_id").alias("symbol_id"), "name", "kind", "path", "line")
    b = graph.callees(c.references, c.symbols, c.files, "s4.0").select(F.lit("callee").alias("side"), F.col("target_symbol_id").alias("symbol_id"), "name", "kind", "path", "line")
    return a.union(b)


@query(
    _with(_SYMBOLS)
    + """, calls AS (SELECT 's::' || doc_id || '.py::C' || doc_id || '.run#method' AS caller_symbol_id, CASE doc_id % 4 WHEN 0 THEN word WHEN 1 THEN 'm' || doc_id || '.C' || doc_id WHEN 2 THEN 'nowhere' ELSE 'C' || (doc_id // 2) END AS callee, doc_id AS line FROM raw)
SELECT c.*, coalesce(n.symbol_id, q.symbol_id) AS target_symbol_id FROM calls c LEFT JOIN (SELECT name, arg_min(symbol_id, id) AS symbol_id FROM symbols GROUP BY 1) n ON n.name = c.callee LEFT JOIN (SELECT qualified_name, arg_max(symbol_id, id) AS symbol_id FROM symbols GROUP BY 1) q ON q.qualified_name = c.callee"""
)
def call_resolution(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    d = F.col("doc_id")
    word = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
    callee = F.when(d % 4 == 0, word).when(d % 4 == 1, F.concat(F.lit("m"), d.cast("string"), F.lit(".C"), d.cast("string"))).when(d % 4 == 2, "nowhere").otherwise(F.concat(F.lit("C"), F.floor(d / 2).cast("string")))
    calls = c.t.documents.select(F.concat(F.lit("s::"), d.cast("string"), F.lit(".py::C"), d.cast("string"), F.lit(".run#method")).alias("caller_symbol_id"), callee.alias("callee"), d.alias("line"))
    return graph.resolve_calls(calls, c.symbols)


@query(
    _with(_FILES)
    + """, i AS (SELECT id * 2 AS id, repo_id, unnest(['pkg/none.py', 'src' || repo_id || '/pkg/m' || id || '.py', 'src' || repo_id || '/tests/test_m' || id || '.py']) AS path, unnest([0, 1, 2]) AS pos FROM files)
SELECT CAST(f.id * 2 AS BIGINT) AS id, f.repo_id, b.resolved_file_id FROM files f LEFT JOIN (SELECT i.id, arg_min(g.id, i.pos) AS resolved_file_id FROM i JOIN files g ON g.repo_id = i.repo_id AND g.path = i.path GROUP BY 1) b ON b.id = f.id * 2"""
)
def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    repo = F.concat(F.lit("src"), F.col("repo_id").cast("string"))
    paths = F.array(F.lit("pkg/none.py"), *[F.concat(repo, F.lit(p), F.col("id").cast("string"), F.lit(".py")) for p in ("/pkg/m", "/tests/test_m")])
    wanted = c.files.select((F.col("id") * 2).alias("id"), "repo_id", paths.alias("candidates"))
    return graph.resolve_imports(wanted, c.files).select("id", "repo_id", "resolved_file_id")


@query(
    _with(_FILES)
    + """, i AS (SELECT id, (repo_id + 1) % 20 AS repo_id, CASE id % 4 WHEN 0 THEN path WHEN 1 THEN regexp_extract(path, '[^/]+$') WHEN 2 THEN regexp_extract(path, '([^/]+)\\.py$', 1) ELSE replace(regexp_replace(path, '\\.py$', ''), '/', '.') END AS specifier FROM files)
SELECT i.id, arg_min(f.id, {'r': rank, 'f': f.id}) AS resolved_file_id FROM i JOIN (SELECT id, repo_id, unnest([path, regexp_extract(path, '[^/]+$'), regexp_extract(path, '([^/]+)\\.py$', 1), replace(regexp_replace(path, '\\.py$', ''), '/', '.')]) AS specifier, unnest([0, 1, 2, 3]) AS rank FROM files) f ON f.specifier = i.specifier AND f.repo_id <> i.repo_id GROUP BY 1"""
)
def cross_repo_resolution(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    k = F.col("id") % 4
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    spec = F.when(k == 0, F.col("path")).when(k == 1, F.regexp_extract("path", "[^/]+$", 0)).when(k == 2, stem).otherwise(F.translate(F.regexp_replace("path", r"\.py$", ""), "/", "."))
    wanted = c.files.select("id", ((F.col("repo_id") + 1) % 20).alias("repo_id"), spec.alias("specifier"))
    return graph.cross_repo_imports(wanted, c.files)


@query(_with(_IMPORTS) + "SELECT DISTINCT file_id AS src, resolved_file_id AS dst FROM imports WHERE resolved_file_id IS NOT NULL")
def edge_deduplication(spark: SparkSession, sf: str) -> DataFrame:
    e = Code(spark, sf).imports.filter("resolved_file_id IS NOT NULL").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst"))
    return diff.distinct_edges(e)


@query(
    _with(_SYMBOLS)
    + """SELECT s.symbol_id, s.parent_symbol_id IS NULL OR p.symbol_id IS NULL AS is_root, CAST(coalesce(k.n, 0) AS INTEGER) AS child_count, coalesce(k.names, '') AS children FROM symbols s LEFT JOIN symbols p ON p.symbol_id = s.parent_symbol_id
LEFT JOIN (SELECT parent_symbol_id, count(*) AS n, string_agg(name, ',' ORDER BY line_start, symbol_id) AS names FROM symbols WHERE parent_symbol_id IS NOT NULL GROUP BY 1) k ON k.parent_symbol_id = s.symbol_id"""
)
def symbol_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.children(Code(spark, sf).symbols, "symbol_id", "parent_symbol_id", "line_start", "symbol_id", "name")
    names = F.array_join(F.transform("children", lambda x: x["name"]), ",")
    return rows.select("symbol_id", "is_root", "child_count", F.coalesce(names, F.lit("")).alias("children"))


@query(
    _with(_SECTIONS)
    + """SELECT s.section_id, s.level, CAST(coalesce(c.n, 0) AS BIGINT) AS truncated FROM sections s LEFT JOIN (SELECT parent_section_id, count(*) AS n FROM sections WHERE level > 3 GROUP BY 1) c ON c.parent_section_id = s.section_id WHERE s.level <= 3"""
)
def toc_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return graph.toc(Code(spark, sf).sections, 3).select("section_id", "level", "truncated")


@query(
    _with(_FILES)
    + """, l AS (SELECT path, unnest(string_split(content, chr(10))) AS before, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files)
SELECT path, CAST(line AS INTEGER) AS line, before, regexp_replace(before, '\\bthe\\b', 'any', 'g') AS after FROM l WHERE regexp_matches(before, '\\bthe\\b')"""
)
def rename_edit_lines(spark: SparkSession, sf: str) -> DataFrame:
    return graph.rename_edits(Code(spark, sf).files, "the", "any")


@query(
    _with(_FILES, _SYMBOLS, _IMPORTS, _REFERENCES)
    + """SELECT s.symbol_id, (SELECT string_agg(symbol_id, ',' ORDER BY line_start, symbol_id) FROM (SELECT * FROM symbols x WHERE x.file_id = s.file_id AND x.symbol_id <> s.symbol_id ORDER BY line_start, symbol_id LIMIT 10)) AS siblings,
(SELECT string_agg(specifier, ',' ORDER BY specifier) FROM (SELECT DISTINCT specifier FROM imports i WHERE i.file_id = s.file_id)) AS imports,
(SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT DISTINCT f.path FROM refs r JOIN symbols c ON c.symbol_id = r.source_symbol_id JOIN files f ON f.id = c.file_id WHERE r.target_symbol_id = s.symbol_id)) AS caller_files FROM symbols s WHERE s.symbol_id = 's14.0'"""
)
def context_bundle_row(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    row = graph.context_bundle(c.symbols, c.imports, c.references, c.files, "s14.0")
    return row.select("symbol_id", F.array_join(F.transform("siblings", lambda x: x["_sibling"]), ",").alias("siblings"), F.array_join("imports", ",").alias("imports"), F.array_join("caller_files", ",").alias("caller_files"))


@query(
    _with(_SYMBOLS)
    + """SELECT symbol_id, score FROM (SELECT symbol_id, CASE WHEN file_id = 37 THEN 3.0::DOUBLE ELSE 0.0 END + 0.5 * CASE WHEN starts_with(name, '_get_') THEN CASE WHEN name = '_get_12' THEN 2 ELSE 1 END WHEN lower(name) = 'get' THEN 1 ELSE 0 END AS score
 FROM symbols WHERE symbol_id <> 's37.13') WHERE score > 0 ORDER BY score DESC, symbol_id LIMIT 15"""
)
def related_symbols_topk(spark: SparkSession, sf: str) -> DataFrame:
    return graph.related_symbols(Code(spark, sf).symbols, "s37.13", 15)


# quality

@query(
    _with(_FILES, _SYMBOLS)
    + """, w AS (SELECT DISTINCT unnest(regexp_extract_all(content, '\\b\\w{3,}\\b')) AS word FROM files WHERE path ILIKE '%test%' OR path ILIKE '%spec%')
SELECT symbol_id, name IN (SELECT word FROM w) AS has_tests, coalesce(length(trim(docstring)) > 10, false) AS has_docs, contains(signature, '->') OR contains(signature, ': ') OR regexp_matches(signature, ':\\s*\\w+') AS has_types,
 CASE WHEN cyclomatic > 0 THEN cyclomatic ELSE 1 END AS complexity FROM symbols"""
)
def symbol_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    tests = c.files.filter(quality.is_test_path(F.col("path")))
    return quality.metrics(c.symbols, c.symbols.select("symbol_id", F.lit("pass").alias("source")), tests)


@query(
    _with(_SYMBOLS)
    + """SELECT symbol_id, complexity FROM (SELECT symbol_id, cyclomatic AS complexity, cyclomatic % 2 = 0 AS has_tests, docstring IS NOT NULL AS has_docs FROM symbols) WHERE NOT has_tests OR NOT has_docs OR complexity >= 20 ORDER BY complexity DESC, symbol_id LIMIT 30"""
)
def low_quality_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = Code(spark, sf).symbols.select("symbol_id", F.col("cyclomatic").alias("complexity"), (F.col("cyclomatic") % 2 == 0).alias("has_tests"), F.col("docstring").isNotNull().alias("has_docs"))
    return quality.low_quality(s, 20, 30).select("symbol_id", "complexity")


_CALLABLE = "kind IN ('function', 'method')"


@query(
    _with(_FILES, _SYMBOLS)
    + f""", c AS (SELECT s.*, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE NOT {_TEST})
SELECT symbol_id, 'too_many_parameters' AS smell, 'medium' AS severity, 9 AS value FROM c WHERE kind = 'method'
UNION ALL SELECT symbol_id, 'too_long', CASE WHEN line_end - line_start + 1 > 400 THEN 'high' ELSE 'medium' END, line_end - line_start + 1 FROM c WHERE {_CALLABLE} AND line_end - line_start + 1 > 200
UNION ALL SELECT symbol_id, 'missing_docstring', 'low', NULL FROM c WHERE NOT starts_with(name, '_') AND docstring IS NULL
UNION ALL SELECT symbol_id, 'missing_return_type', 'low', NULL FROM c WHERE {_CALLABLE} AND NOT starts_with(name, '_') AND NOT contains(signature, '->')
UNION ALL SELECT symbol_id, 'too_many_methods', 'medium', n FROM c JOIN (SELECT parent_symbol_id AS p, count(*) AS n FROM c WHERE kind = 'method' GROUP BY 1) ON p = symbol_id WHERE kind = 'class' AND n > 20"""
)
def smells_of_index(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    s = c.symbols.join(c.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return quality.smells(s).select("symbol_id", "smell", "severity", "value")


@query(
    _with(_FILES, _SYMBOLS, _REFERENCES)
    + """SELECT s.symbol_id FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.symbol_id NOT IN (SELECT target_symbol_id FROM refs WHERE target_symbol_id IS NOT NULL) AND NOT (name IN ('main', '__init__', '__main__', 'setup', 'teardown') OR starts_with(name, 'test_') OR starts_with(name, 'Test') OR (starts_with(name, '_') AND NOT starts_with(name, '__')))"""
)
def dead_symbols(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    s = c.symbols.join(c.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return quality.dead_code(s, c.references).select("symbol_id")


@query(
    _with(_FILES, _SYMBOLS)
    + """, m AS (SELECT symbol_id, name, 'pkg.m' || (file_id % 500) AS module FROM symbols WHERE kind <> 'method'), called AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS name FROM benchmark), spec AS (SELECT DISTINCT 'm' || item_id AS specifier FROM benchmark)
SELECT symbol_id, name IN (SELECT name FROM called) AND EXISTS (SELECT 1 FROM spec WHERE contains(module, specifier) OR contains(specifier, module)) AS covered FROM m"""
)
def covered_symbols(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    s = c.symbols.filter("kind <> 'method'").select("symbol_id", "name", F.concat(F.lit("pkg.m"), (F.col("file_id") % 500).cast("string")).alias("module"))
    called = c.t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("name"))
    return quality.coverage(s, called, c.t.benchmark.select(F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("specifier"))).select("symbol_id", "covered")


@query(_with(_SYMBOLS) + "SELECT symbol_id, name, CAST((SELECT count(*) FROM symbols m WHERE m.parent_symbol_id = c.symbol_id AND m.kind = 'method') AS BIGINT) AS methods FROM symbols c WHERE kind = 'class' ORDER BY methods DESC, symbol_id LIMIT 10")
def popular_classes_topk(spark: SparkSession, sf: str) -> DataFrame:
    return quality.popular_classes(Code(spark, sf).symbols)


@query(
    _with(_FILES, _SYMBOLS)
    + """, p AS (SELECT s.symbol_id, s.cyclomatic, f.path FROM symbols s JOIN files f ON f.id = s.file_id ORDER BY cyclomatic DESC, symbol_id LIMIT 200), c AS (SELECT path, id % 12 AS commits FROM files WHERE id % 12 > 0)
SELECT symbol_id, score, CASE WHEN score <= 3 THEN 'low' WHEN score <= 10 THEN 'medium' ELSE 'high' END AS level FROM (SELECT symbol_id, round(cyclomatic * ln(1 + coalesce(commits, 0)), 2) AS score FROM p LEFT JOIN c USING (path)) ORDER BY score DESC, symbol_id LIMIT 20"""
)
def hotspots_topn(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    s = c.symbols.join(c.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("symbol_id", "cyclomatic", "path")
    churn = c.files.filter("id % 12 > 0").select("path", (F.col("id") % 12).alias("commits"))
    return quality.hotspots(s, churn).select("symbol_id", "score", "level")


@query(
    _with(_SYMBOLS)
    + """, b AS (SELECT s.symbol_id, e.event_id, e.ts AS commit_date, md5(CAST(e.event_id AS VARCHAR)) AS commit_hash FROM symbols s JOIN events e ON e.user_id = s.file_id WHERE kind = 'class') SELECT symbol_id, commit_hash, commit_date FROM b QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY commit_date DESC, commit_hash) = 1"""
)
def blame_latest_commit(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    commits = c.t.events.select(F.col("user_id").alias("file_id"), F.col("ts").alias("commit_date"), F.md5(F.col("event_id").cast("string")).alias("commit_hash"))
    rows = c.symbols.filter("kind = 'class'").select("symbol_id", "file_id").join(commits, "file_id")
    return quality.blame_latest(rows).select("symbol_id", "commit_hash", "commit_date")


@query(
    """WITH n AS (SELECT doc_id, n_chars, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '"{3}(?s:.*?)"{3}', '', 'g'), '''{3}(?s:.*?)''{3}', '', 'g'), '(?m)#.*$', '', 'g'), '"[^"]*"', '""', 'g'), '''[^'']*''', '''''', 'g'), '\\s+', ' ', 'g')) AS body FROM documents),
h AS (SELECT doc_id, substring(sha256(body), 1, 16) AS hash FROM n WHERE n_chars >= 5)
SELECT doc_id AS symbol_id, hash, count(*) OVER (PARTITION BY hash) AS members FROM h QUALIFY count(*) OVER (PARTITION BY hash) >= 2"""
)
def duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    d = Tables(spark, sf).documents.select(F.col("doc_id").alias("symbol_id"), F.col("text").alias("source"), F.col("n_chars").alias("line_count"))
    return quality.duplicate_members(d)


# counts and summaries

_STATS = """fs AS (SELECT f.id, f.repo_id, coalesce(a.n, 0) AS n_symbols, coalesce(b.n, 0) AS n_sections FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) a ON a.file_id = f.id LEFT JOIN (SELECT file_id, count(*) AS n FROM sections GROUP BY 1) b ON b.file_id = f.id),
stats AS (SELECT r.id, r.name, CAST(count(fs.id) AS BIGINT) AS files, CAST(coalesce(sum(n_symbols), 0) AS BIGINT) AS symbols, CAST(coalesce(sum(n_sections), 0) AS BIGINT) AS sections FROM repos r LEFT JOIN fs ON fs.repo_id = r.id GROUP BY 1, 2)"""


@query(_with(_FILES, _REPOS, _SYMBOLS, _SECTIONS, _STATS) + "SELECT * FROM stats")
def repository_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    return overview.repo_stats(c.repos.select("id", "name"), c.files, c.symbols, c.sections)


@query(_with(_FILES, _REPOS, _SYMBOLS, _SECTIONS, _STATS) + "SELECT s.id, r.package_manager AS manager, r.package_name AS package, r.version, s.files, s.symbols FROM stats s JOIN repos r USING (id) WHERE r.repo_type = 'library'")
def libraries_listed(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    return overview.library_list(c.repos, c.files, c.symbols)


@query(
    _with(_FILES, _REPOS, _SYMBOLS, _SECTIONS, _STATS)
    + "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS BIGINT) AS repos, CAST(coalesce((SELECT sum(files) FROM stats JOIN nation ON n_nationkey = stats.id WHERE n_regionkey = r_regionkey), 0) AS BIGINT) AS files, CAST(coalesce((SELECT sum(symbols) FROM stats JOIN nation ON n_nationkey = stats.id WHERE n_regionkey = r_regionkey), 0) AS BIGINT) AS symbols FROM region"
)
def workspace_totals(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    return overview.workspace_rollup(c.workspaces, c.workspace_repos, c.files, c.symbols)


@query(
    _with(_FILES, _REPOS, _SYMBOLS, _SECTIONS, _STATS, _INSTANCES)
    + """, used AS (SELECT sum(c) AS tool_calls, sum(r) AS tokens_returned, sum(q) AS tokens_equivalent FROM (SELECT l_linenumber AS c, l_partkey AS r, l_partkey + l_suppkey AS q FROM lineitem UNION ALL SELECT tool_calls, tokens_returned, tokens_equivalent FROM instances WHERE ended_at IS NULL))
SELECT t.*, CAST(tool_calls AS BIGINT) AS tool_calls, CAST(tokens_returned AS BIGINT) AS tokens_returned, CAST(tokens_equivalent AS BIGINT) AS tokens_equivalent, round((1 - tokens_returned / tokens_equivalent) * 100, 1)::DOUBLE AS reduction
FROM (SELECT count(*) AS repos, CAST(sum(files) AS BIGINT) AS files, CAST(sum(symbols) AS BIGINT) AS symbols, CAST(sum(sections) AS BIGINT) AS sections FROM stats) t, used"""
)
def index_overview(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    sessions = c.t.lineitem.select(F.col("l_linenumber").cast("long").alias("tool_calls"), F.col("l_partkey").alias("tokens_returned"), (F.col("l_partkey") + F.col("l_suppkey")).alias("tokens_equivalent"))
    return overview.overview(c.repos, c.files, c.symbols, c.sections, sessions, c.instances)


@query(
    _with(_INSTANCES)
    + "SELECT coding_session_id, event_type AS category, count(*) AS calls, CAST(sum(tokens_returned) AS BIGINT) AS returned, CAST(sum(tokens_equivalent) AS BIGINT) AS equivalent FROM instances GROUP BY 1, 2"
)
def category_merge(spark: SparkSession, sf: str) -> DataFrame:
    counters = F.struct(F.lit(1).cast("long").alias("calls"), F.col("tokens_returned").alias("returned"), F.col("tokens_equivalent").alias("equivalent"))
    rows = Code(spark, sf).instances.select("coding_session_id", F.create_map("event_type", counters).alias("category_data"))
    merged = overview.merge_categories(rows, "coding_session_id")
    return merged.select("coding_session_id", F.explode("category_data").alias("category", "c")).select("coding_session_id", "category", "c.*")


@query(
    """SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS critical, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS BIGINT) AS high, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS BIGINT) AS medium, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS low, count(*) AS total FROM labels"""
)
def severity_totals(spark: SparkSession, sf: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    name = F.when(q & t, "critical").when(t, "high").when(~q, "medium").otherwise("low")
    return overview.severity_counts(Tables(spark, sf).labels.select(name.alias("severity")))


@query(
    _with(_SYMBOLS)
    + "SELECT round(100 * count(*) FILTER (docstring IS NOT NULL) / count(*), 1)::DOUBLE AS docs_percent, round(100 * count(*) FILTER (contains(signature, '->') OR regexp_matches(signature, ':\\s*\\w+')) / count(*), 1)::DOUBLE AS types_percent, round(100 * count(*) FILTER (cyclomatic > 9) / count(*), 1)::DOUBLE AS tests_percent, count(*) AS symbols FROM symbols"
)
def coverage_percentages(spark: SparkSession, sf: str) -> DataFrame:
    s = Code(spark, sf).symbols
    return overview.coverage_percent(s.select(F.col("docstring").isNotNull().alias("has_docs"), X.has_types(F.col("signature")).alias("has_types"), (F.col("cyclomatic") > 9).alias("has_tests")))


@query(
    _with(_FILES, _SYMBOLS)
    + """SELECT (SELECT count(*) FROM files WHERE repo_id = 3) AS files, (SELECT count(*) FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.repo_id = 3) AS symbols,
(SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM files WHERE repo_id = 3 GROUP BY 1)) AS languages,
(SELECT string_agg(d || '=' || n, ',' ORDER BY d) FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, count(*) AS n FROM files WHERE repo_id = 3 GROUP BY 1)) AS directories,
(SELECT string_agg(path || '=' || length(substring(content, 1, 5000)), ',' ORDER BY path) FROM files WHERE repo_id = 3 AND path LIKE '%/tests/%') AS manifests"""
)
def repository_briefing(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    row = overview.briefing(3, c.files, c.symbols, c.files.filter(F.contains("path", F.lit("/tests/"))).select("repo_id", "path", "content"))

    def flat(name: str, value):
        pairs = F.array_sort(F.map_entries(name))
        return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), value(e["value"]).cast("string"))), ",").alias(name)

    return row.select("files", "symbols", flat("languages", lambda v: v), flat("directories", lambda v: v), flat("manifests", F.length))


@query(
    _with(_REPOS)
    + """SELECT id, name, git_head AS indexed_head, head, CASE WHEN head IS NULL OR git_head IS NULL THEN 'unknown' WHEN head = git_head THEN 'fresh' ELSE 'stale' END AS status FROM repos LEFT JOIN (SELECT source_path AS p, CASE WHEN id % 3 = 0 THEN 'new' ELSE md5(name) END AS head FROM repos WHERE id % 7 <> 0) ON p = source_path"""
)
def staleness_probe(spark: SparkSession, sf: str) -> DataFrame:
    r = Code(spark, sf).repos
    heads = r.filter("id % 7 <> 0").select("source_path", F.when(F.col("id") % 3 == 0, "new").otherwise(F.md5("name")).alias("head"))
    return overview.stale_repos(r, heads)


@query(
    _with(_INSTANCES)
    + """SELECT instance_id, CASE WHEN s IS NOT NULL THEN CASE WHEN s >= 3600 THEN s // 3600 || 'h ' ELSE '' END || CASE WHEN s >= 60 THEN s % 3600 // 60 || 'm ' ELSE '' END || s % 60 || 's' END AS duration FROM (SELECT instance_id, CAST(epoch(date_trunc('second', ended_at)) - epoch(date_trunc('second', started_at)) AS BIGINT) AS s FROM instances)"""
)
def instance_durations(spark: SparkSession, sf: str) -> DataFrame:
    return Code(spark, sf).instances.select("instance_id", overview.duration(F.col("started_at"), F.col("ended_at")).alias("duration"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS back FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def recent_events(spark: SparkSession, sf: str) -> DataFrame:
    return overview.recent(Tables(spark, sf).events, "user_id", F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "back")


@query(_with(_FILES) + "SELECT path, max(ts) AS last_access FROM events JOIN files ON files.id = user_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def working_files_topn(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    return overview.working_files(c.t.events.join(c.files.select(F.col("id").alias("user_id"), "path"), "user_id"))


@query(_with(_FILES, _SYMBOLS) + "SELECT path, count(*) AS symbols FROM files JOIN symbols ON file_id = files.id WHERE files.id NOT IN (SELECT user_id FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def unexplored_files(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    seen = c.t.events.join(c.files.select(F.col("id").alias("user_id"), "path"), "user_id")
    return overview.unexplored(c.files, seen, c.symbols)


@query("SELECT doc_id AS id, source || ' ' || lang AS text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def rows_to_embed(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return overview.to_embed(t.documents.withColumnRenamed("doc_id", "id"), t.embeddings.select(F.col("vec_id").alias("id")), "id", F.concat_ws(" ", "source", "lang"))


@query(
    """WITH p AS (SELECT p_brand AS model, p_type AS col, max(p_name) AS description, 1.0 AS score FROM part GROUP BY 1, 2 UNION ALL SELECT p_brand, p_type, min(p_name), 0.8 FROM part GROUP BY 1, 2 UNION ALL SELECT p_brand, 'only', 'x', 0.6 FROM part GROUP BY 1)
SELECT model, col AS "column", description, CAST(score AS DOUBLE) AS score FROM p QUALIFY row_number() OVER (PARTITION BY model, col ORDER BY score DESC) = 1"""
)
def provider_columns(spark: SparkSession, sf: str) -> DataFrame:
    p = Tables(spark, sf).part
    keys = [F.col("p_brand").alias("model"), F.col("p_type").alias("column")]
    a = p.groupBy(*keys).agg(F.max("p_name").alias("description")).withColumn("score", F.lit(1.0))
    b = p.groupBy(*keys).agg(F.min("p_name").alias("description")).withColumn("score", F.lit(0.8))
    c = p.select(F.col("p_brand").alias("model"), F.lit("only").alias("column"), F.lit("x").alias("description"), F.lit(0.6).alias("score")).distinct()
    return overview.column_matches([a, b, c])


# scopes, presenters and the fluent query

@query(_with(_FILES, _REPOS, _SYMBOLS) + "SELECT s.symbol_id, s.name, s.kind, f.path AS file, CAST(s.line_start AS INTEGER) AS line_start FROM symbols s JOIN files f ON f.id = s.file_id JOIN repos r ON r.id = f.repo_id WHERE s.kind = 'class' AND r.name = 'src5'")
def scoped_symbols(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    q = Query(c.symbols, scopes=symbol_scopes(c.files, c.repos, c.workspace_repos)).classes().in_repo("src5")
    return present(q.df(), "symbol", "brief")


@query(_with(_FILES, _SYMBOLS) + "SELECT s.symbol_id, s.name, s.kind, coalesce(s.signature, '') AS signature, CAST(s.line_start AS INTEGER) AS line_start, CAST(s.line_end AS INTEGER) AS line_end, s.parent_symbol_id FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.kind = 'function' AND f.repo_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def workspace_outline(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    q = Query(c.symbols, scopes=symbol_scopes(c.files, c.repos, c.workspace_repos)).functions().in_workspace(2)
    return present(q.df(), "symbol", "outline")


@query(_with(_FILES, _SYMBOLS) + "SELECT symbol_id, name, qualified_name, kind, symbols.language, path AS file, signature, '' AS summary, coalesce(docstring, '') AS docstring, CAST(0 AS INTEGER) AS n_decorators, '' AS source, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end FROM symbols JOIN files ON files.id = file_id")
def symbols_in_full(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    rows = c.symbols.join(c.files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
    return present(rows, "symbol", "full").withColumn("n_decorators", F.size("decorators")).drop("decorators")


@query(_with(_FILES, _SECTIONS) + "SELECT section_id, title, CAST(level AS INTEGER) AS level, path AS doc_path, coalesce(summary, '') AS summary, sections.content AS content, CAST(0 AS INTEGER) AS n_tags FROM sections JOIN files ON files.id = file_id WHERE repo_id = 4")
def sections_in_repo(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    q = Query(c.sections, scopes=section_scopes(c.files, c.repos)).in_repo("src4")
    return present(q.df(), "section", "full").withColumn("n_tags", F.size("tags")).drop("tags")


@query(_with(_REPOS, _INSTANCES) + "SELECT 'libraries' AS scope, name FROM repos WHERE repo_type = 'library' UNION ALL SELECT 'local_repos', name FROM repos WHERE repo_type <> 'library' UNION ALL SELECT 'active', instance_id FROM instances WHERE ended_at IS NULL UNION ALL SELECT 'leader', r_name FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'followers', r_name FROM region WHERE r_regionkey <> 0")
def scope_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of each scope, by name."""
    c = Code(spark, sf)
    nodes = c.t.region.select(F.col("r_name").alias("node_id"), F.when(F.col("r_regionkey") == 0, "leader").otherwise("follower").alias("role"))
    parts = [(c.repos, "name", REPO_SCOPES), (c.instances, "instance_id", INSTANCE_SCOPES), (nodes, "node_id", NODE_SCOPES)]
    out = None
    for base, key, scopes in parts:
        for name in scopes:
            one = getattr(Query(base, scopes=scopes), name)().df().select(F.lit(name).alias("scope"), F.col(key).alias("name"))
            out = one if out is None else out.union(one)
    return out


@query(
    """SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM customer WHERE (c_acctbal > 100 OR c_nationkey = 3 AND c_mktsegment <> 'BUILDING' OR c_name NOT LIKE '%1%') AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 4)
AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) AND (c_custkey > 5 AND c_nationkey > 0 AND c_acctbal + c_nationkey > 0)"""
)
def fluent_conditions(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    big = Query(t.orders).where("o_totalprice", ">", 1000).to_subquery("o_custkey")
    return (
        Query(t.customer)
        .where_group(lambda g: g.where("c_acctbal", ">", 100).or_where(c_nationkey=3).where("c_mktsegment", "!=", "BUILDING").or_where_not_like("c_name", "%1%"))
        .where_exists(t.nation.filter("n_regionkey < 4"), F.col("n_nationkey") == F.col("c_nationkey"))
        .where_in_subquery("c_custkey", big)
        .when(True, lambda q: q.where_all(["c_custkey"], ">", 5).where_all(["c_nationkey"], ">", 0))
        .when(False, lambda q: q.where_raw("false"))
        .where_raw("c_acctbal + c_nationkey > 0")
        .select("c_custkey", "c_name")
        .select_raw("c_acctbal * 2 AS twice")
        .df()
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' OR o_totalprice BETWEEN 10 AND 2000 OR o_orderkey NOT IN (1, 2) AND o_orderpriority = '5-LOW'")
def or_conditions(spark: SparkSession, sf: str) -> DataFrame:
    q = Query(Tables(spark, sf).orders).where_not(o_orderstatus="F").or_where_like("o_orderpriority", "1%").or_where_between("o_totalprice", 10, 2000).or_where_not_in("o_orderkey", [1, 2]).where(o_orderpriority="5-LOW")
    return q.pluck("o_orderkey")


@query("SELECT o_orderkey, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS parts, count(*) AS parts_count FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def pivot_eager_loading(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    pivot = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    r = Relation("belongs_to_many", t.part.select("p_partkey", "p_name"), "o_orderkey", "p_partkey", pivot, "l_orderkey", "l_partkey")
    df = Query(t.orders, relations={"parts": r}).with_("parts").with_count("parts").has("parts").df()
    return df.select("o_orderkey", F.array_join(F.transform("parts", lambda p: p["p_partkey"].cast("string")), ",").alias("parts"), "parts_count")


@query("SELECT r_name, string_agg(n_name || ':' || s, ';' ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT n_nationkey AS k, (SELECT coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation) ON k = n_nationkey GROUP BY 1")
def nested_eager_loading(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    suppliers = Relation("has_many", t.supplier.select("s_suppkey", "s_nationkey"), "n_nationkey", "s_nationkey")
    nations = Relation("has_many", t.nation, "r_regionkey", "n_regionkey", relations={"suppliers": suppliers})
    df = Query(t.region, relations={"nations": nations}).with_("nations.suppliers").df()
    text = F.transform("nations", lambda n: F.concat(n["n_name"], F.lit(":"), F.array_join(F.transform(n["suppliers"], lambda s: s["s_suppkey"].cast("string")), ",")))
    return df.select("r_name", F.array_join(text, ";").alias("nations"))


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 1000.5 AND c_mktsegment <> 'O''Brien' GROUP BY 1")
def raw_sql(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    text = "SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON n_nationkey = c_nationkey WHERE c_acctbal > :least AND c_mktsegment <> :segment GROUP BY 1"
    return tables.raw(spark, text, {"c": t.customer, "n": t.nation}, least=1000.5, segment="O'Brien")


@query("SELECT o_orderstatus, max(o_totalprice) AS most, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS below, (SELECT c_name FROM customer WHERE c_custkey = 7) AS seventh, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS chunked FROM orders GROUP BY 1")
def single_results(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    below = Query(t.orders).where("o_totalprice", "<", 0).exists()
    seventh = Query(t.customer).find_or_fail(7, "c_custkey")["c_name"]
    chunked = sum(len(c) for c in Query(t.orders).select("o_orderkey").order_by("o_orderkey").chunk(1000))
    out = Query(t.orders).group_by("o_orderstatus").aggregates(most=F.max("o_totalprice"))
    return out.select("*", F.lit(below).alias("below"), F.lit(seventh).alias("seventh"), F.lit(chunked).cast("long").alias("chunked"))


# mutations and differences

_SPLIT = "WITH b AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0), d AS (SELECT s_suppkey, s_name || '!' AS s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0) "


def _suppliers(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return s.filter("s_suppkey % 3 <> 0"), s.filter("s_suppkey % 2 = 0").withColumn("s_name", F.concat("s_name", F.lit("!")))


@query(_SPLIT + "SELECT * FROM b UNION ALL SELECT * FROM d WHERE s_suppkey NOT IN (SELECT s_suppkey FROM b)")
def first_or_create_rows(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.first_or_create(*_suppliers(Tables(spark, sf)), ["s_suppkey"])


@query(_SPLIT + "SELECT * FROM d UNION ALL SELECT * FROM b WHERE s_suppkey NOT IN (SELECT s_suppkey FROM d)")
def update_or_create_rows(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.update_or_create(*_suppliers(Tables(spark, sf)), ["s_suppkey"])


@query(_SPLIT + ", i AS (SELECT *, 1 AS pos FROM d UNION ALL SELECT s_suppkey, 'second', s_nationkey, s_acctbal + 1, 2 FROM d WHERE s_suppkey % 4 = 0), l AS (SELECT * EXCLUDE pos FROM i QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY pos DESC) = 1) SELECT * FROM l UNION ALL SELECT * FROM b WHERE s_suppkey NOT IN (SELECT s_suppkey FROM l)")
def bulk_upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    base, d = _suppliers(Tables(spark, sf))
    second = d.filter("s_suppkey % 4 = 0").withColumns({"s_name": F.lit("second"), "s_acctbal": F.col("s_acctbal") + 1, "pos": F.lit(2)})
    return mutate.bulk_upsert(base, d.withColumn("pos", F.lit(1)).unionByName(second), ["s_suppkey"], "pos")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 5 THEN 'five' ELSE s_name END AS s_name, CASE WHEN s_nationkey = 5 THEN 0.0 WHEN s_acctbal < 0 THEN s_acctbal - 7 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_and_decrement(spark: SparkSession, sf: str) -> DataFrame:
    s = Tables(spark, sf).supplier
    taken = mutate.decrement(s, F.col("s_acctbal") < 0, "s_acctbal", 7)
    return mutate.update(taken, F.col("s_nationkey") == 5, s_name="five", s_acctbal=0).select("s_suppkey", "s_name", "s_acctbal")


@query("WITH p AS (SELECT DISTINCT n_regionkey AS workspace_id, n_nationkey AS repo_id FROM nation UNION SELECT 1, s_nationkey FROM supplier) SELECT * FROM p WHERE NOT (workspace_id = 2 AND repo_id IN (SELECT n_nationkey FROM nation WHERE n_name < 'J'))")
def pivot_attach_detach(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    pivot = t.nation.select(F.col("n_regionkey").alias("workspace_id"), F.col("n_nationkey").alias("repo_id"))
    more = mutate.attach(pivot, t.supplier.select(F.lit(1).alias("workspace_id"), F.col("s_nationkey").alias("repo_id")))
    return mutate.detach(more, t.nation.filter("n_name < 'J'").select(F.lit(2).alias("workspace_id"), F.col("n_nationkey").alias("repo_id")))


@query(_with(_FILES, _REPOS, _SYMBOLS, _REFERENCES) + "SELECT 'files' AS rows_of, path AS name FROM files WHERE repo_id NOT IN (SELECT id FROM repos WHERE repo_type = 'library') UNION ALL SELECT 'symbols', symbol_id FROM symbols JOIN files f ON f.id = file_id WHERE repo_id % 4 <> 0 UNION ALL SELECT 'references', source_symbol_id FROM refs JOIN symbols s ON s.symbol_id = source_symbol_id JOIN files f ON f.id = s.file_id WHERE repo_id % 4 <> 0")
def library_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each table."""
    c = Code(spark, sf)
    left = mutate.cascade_tree(c.repos.filter("repo_type = 'library'"), [("files", c.files, "repo_id", "id"), ("symbols", c.symbols, "file_id", "symbol_id"), ("references", c.references, "source_symbol_id", None)])
    out = None
    for name, key in (("files", "path"), ("symbols", "symbol_id"), ("references", "source_symbol_id")):
        one = left[name].select(F.lit(name).alias("rows_of"), F.col(key).alias("name"))
        out = one if out is None else out.union(one)
    return out


@query("WITH s AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'removed' WHEN p_partkey % 7 = 0 THEN 'added' WHEN p_partkey % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM part WHERE NOT (p_partkey % 35 = 0)) SELECT CAST(count(*) FILTER (status = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (status = 'removed') AS BIGINT) AS removed, CAST(count(*) FILTER (status = 'changed') AS BIGINT) AS changed, CAST(count(*) FILTER (status = 'unchanged') AS BIGINT) AS unchanged, 'high' AS breaking_risk FROM s")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a library: symbols by qualified name, with their signatures."""
    p = Tables(spark, sf).part
    old = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("qualified_name"), F.col("p_name").alias("signature"))
    new = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("qualified_name"), F.when(F.col("p_partkey") % 2 == 0, "other").otherwise(F.col("p_name")).alias("signature"))
    return diff.breaking_risk(diff.snapshot_diff(old, new, ["qualified_name"], "signature"))


@query("WITH i AS (SELECT DISTINCT p_brand AS name, CAST(p_size AS VARCHAR) AS version FROM part), x AS (SELECT DISTINCT p_brand AS name, CAST(p_size AS VARCHAR) AS version FROM part WHERE p_partkey % 3 = 0 AND p_brand <> 'Brand#1') SELECT 'pip' AS manager, name, version AS installed, CASE WHEN name NOT IN (SELECT name FROM x) THEN 'not_indexed' WHEN (name, version) IN (SELECT (name, version) FROM x) THEN 'up_to_date' ELSE 'outdated' END AS status FROM i")
def dependency_drift(spark: SparkSession, sf: str) -> DataFrame:
    p = Tables(spark, sf).part.select(F.lit("pip").alias("manager"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"), "p_partkey")
    return diff.version_drift(p.drop("p_partkey").distinct(), p.filter("p_partkey % 3 = 0 AND name <> 'Brand#1'").drop("p_partkey"))


# text, search and sources

@query(
    """WITH d AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS t FROM documents), k AS (SELECT doc_id, list_filter(string_split('get_' || doc_id || '_now', '_'), lambda x: length(x) >= 2) AS own, regexp_extract_all(lower(string_split(t, chr(10))[1]), '\\b[a-z]{3,}\\b') AS words FROM d)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(own, lambda x: lower(x)), list_concat(words, ['cached'])))), ' ') AS keywords FROM k"""
)
def keyword_extraction(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    words = X.keywords(F.concat(F.lit("get_"), d, F.lit("_now")), F.regexp_replace("text", r"[^\x00-\x7F]", "_"), F.array(F.lit("@cached(1)")))
    return Tables(spark, sf).documents.select("doc_id", F.array_join(words, " ").alias("keywords"))


@query(
    """WITH l AS (SELECT doc_id, trim(text) AS t, trim(string_split(trim(text), chr(10))[1]) AS line FROM documents)
SELECT doc_id, CASE WHEN length(t) > 0 THEN CASE WHEN strpos(line, '.') BETWEEN 2 AND 120 THEN substring(line, 1, strpos(line, '.')) ELSE substring(line, 1, 120) END ELSE 'def f()' END AS summary FROM l"""
)
def heuristic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).documents.select("doc_id", X.summary(F.col("text"), F.lit("def f()"), F.lit("f")).alias("summary"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), greatest(1, doc_id % 9 + 1 - 3), doc_id % 9 + 2 + 3), chr(10)) AS context FROM documents")
def context_around_lines(spark: SparkSession, sf: str) -> DataFrame:
    first = (F.col("doc_id") % 9 + 1).cast("int")
    return Tables(spark, sf).documents.select("doc_id", X.context_lines(F.col("text"), first, first + 1).alias("context"))


@query("SELECT doc_id, doc_id % 4 = 0 AS drifted, source || ' def f() ' || substring(text, 1, 500) || ' ' || lang AS embedded, CASE WHEN contains(source, '/') THEN '' ELSE '.' END AS directory FROM documents")
def drift_and_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    stored = F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.sha2("text", 256))
    said = X.symbol_text(F.col("source"), F.lit("def f()"), F.col("text"), F.col("lang"))
    return Tables(spark, sf).documents.select("doc_id", X.drifted(F.col("text"), stored).alias("drifted"), said.alias("embedded"), X.directory(F.col("source")).alias("directory"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(string_split('#' || regexp_replace(url, '[^A-Za-z]+', ' #', 'g'), ' '), lambda x: length(x) >= 3))), '') AS tags FROM pages")
def hashtags(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("#"), F.regexp_replace("url", "[^A-Za-z]+", " #"))
    return Tables(spark, sf).pages.select("page_id", F.array_join(F.transform(F.array_sort(X.tags(text)), lambda t: F.concat(F.lit("#"), t)), "").alias("tags"))


@query(
    _with(_FILES)
    + """, l AS (SELECT id, path, CASE id % 6 WHEN 0 THEN 'import the' WHEN 1 THEN 'class the(Base):' WHEN 2 THEN 'x = "say the word"' WHEN 3 THEN '# the' WHEN 4 THEN 'y = the + 1' ELSE 'print(`the`)' END AS line FROM files)
SELECT id, CASE id % 6 WHEN 0 THEN 'import_path' WHEN 1 THEN 'class_name' WHEN 2 THEN 'string_literal' WHEN 3 THEN 'comment' WHEN 4 THEN 'code_identifier' ELSE 'string_literal' END AS kind FROM l"""
)
def occurrence_kinds(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array(*map(F.lit, ("import the", "class the(Base):", 'x = "say the word"', "# the", "y = the + 1", "print(`the`)")))
    f = Code(spark, sf).files
    return f.select("id", graph.classify_occurrence(F.element_at(lines, (F.col("id") % 6 + 1).cast("int")), F.col("path"), "the").alias("kind"))


def _index_sql(limit: str, where: str = "") -> str:
    toks = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
    text, lang = toks.format("text"), toks.format("lang")
    size = f"len({text}) + len({lang})"
    use = "len(list_filter({}, lambda x: x = q.term))"
    return f"""WITH q AS (SELECT unnest(['the', 'with', 'fr']) AS term), s AS (SELECT count(*) AS n, avg({size}) AS mean FROM documents),
p AS (SELECT doc_id, source, q.term, 1.0 * {use.format(text)} + 4.0 * {use.format(lang)} AS wtf, {size} AS length FROM documents, q WHERE {use.format(text)} + {use.format(lang)} > 0), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id AS key, round(-sum(greatest(1e-6, ln((s.n - df + 0.5) / (df + 0.5))) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * length / s.mean))), 9) AS score FROM p JOIN d USING (term), s {where} GROUP BY doc_id ORDER BY 2, 1 {limit}"""


def _indexed(spark: SparkSession, sf: str) -> search_index.Index:
    """The index of ``documents`` in a folder of this run's own."""
    return search_index.build(Tables(spark, sf).documents, "doc_id", ["text", "lang"], _folder(spark), buckets=8)


def _segments(spark: SparkSession, sf: str) -> segments.Segments:
    """The same as segments."""
    return segments.build(Tables(spark, sf).documents, "doc_id", ["text", "lang"], _folder(spark))


_WEIGHTS = {"text": 1.0, "lang": 4.0}


@query(_index_sql("LIMIT 25"))
def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    found = _segments(spark, sf).search("the with fr", _WEIGHTS, limit=25)
    return found.withColumn("score", F.round("score", 9))


@query(_index_sql("", "WHERE source IN ('src1', 'src2', 'src5')"))
def indexed_search_in_repos(spark: SparkSession, sf: str) -> DataFrame:
    among = Tables(spark, sf).documents.filter(F.col("source").isin("src1", "src2", "src5")).select(F.col("doc_id").alias("key"))
    found = _segments(spark, sf).search("the with fr", _WEIGHTS, among)
    return found.withColumn("score", F.round("score", 9))


@query(_index_sql("LIMIT 30", "WHERE source IN ('src1', 'src2', 'src5')"))
def filtered_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The best of three repositories, by the stripes whose bounds reach them."""
    among = Tables(spark, sf).documents.filter(F.col("source").isin("src1", "src2", "src5")).select(F.col("doc_id").alias("key"))
    return _segments(spark, sf).search("the with fr", _WEIGHTS, among, limit=30).withColumn("score", F.round("score", 9))


@query(
    "WITH changed AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN concat('the changed fr ', text) ELSE text END AS text, lang FROM documents WHERE doc_id % 7 <> 0), "
    + _index_sql("LIMIT 200").removeprefix("WITH ").replace("FROM documents", "FROM changed")
)
def search_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Three quarters of the documents, then the rest, new texts of every fifth, every seventh deleted, and segments merged as they grow alike."""
    docs = Tables(spark, sf).documents
    index = segments.build(docs.filter("doc_id % 4 <> 1"), "doc_id", ["text", "lang"], _folder(spark))
    index.add(docs.filter("doc_id % 4 = 1"), "doc_id").maintain(2)
    index.add(docs.filter("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("the changed fr "), F.coalesce("text", F.lit("")))), "doc_id").maintain(2)
    index.delete(docs.filter("doc_id % 7 = 0"), "doc_id").maintain(2)
    return index.search("the with fr", _WEIGHTS, limit=200).withColumn("score", F.round("score", 9))


@query("WITH r AS (" + _index_sql("LIMIT 20") + "), b AS (SELECT *, row_number() OVER (ORDER BY score, key) - 1 AS rank FROM r) SELECT key, score, CAST(rank AS INTEGER) AS rank, key % 3 = 0 AS seen, CASE WHEN key % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS boost FROM b")
def search_service_reranked(spark: SparkSession, sf: str) -> DataFrame:
    d = Tables(spark, sf).documents.select(F.col("doc_id").alias("key"))
    boosts = d.filter("key % 2 = 0").withColumn("boost", F.lit(0.5))
    found = search_index.search_service(_indexed(spark, sf), "the with fr", d, {"text": 1.0, "lang": 4.0}, 20, d.filter("key % 3 = 0"), boosts)
    return found.withColumn("score", F.round("score", 9))


@query(
    """WITH q AS (SELECT item_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), lambda t: length(t) >= 2 AND t NOT IN ('and', 'or', 'not', 'near'))) AS term FROM benchmark),
t AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' the ' || p_type), '[a-z0-9]+') AS toks FROM part), s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM t),
p AS (SELECT p_partkey, term, len(list_filter(toks, lambda x: x = term)) AS wtf, len(toks) AS length FROM t, (SELECT DISTINCT term FROM q) WHERE list_contains(toks, term)), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT item_id AS query_id, p_partkey, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN p USING (term) JOIN d USING (term), s GROUP BY 1, 2)
SELECT query_id, p_partkey, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, p_partkey) AS INTEGER) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, p_partkey) <= 5"""
)
def batch_search_queries(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    docs = t.part.select("p_partkey", F.concat_ws(" the ", "p_name", "p_type").alias("t"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieval.batch_search(docs, "p_partkey", {"t": 1.0}, asked, 5).filter("error IS NULL")
    return found.select("query_id", "p_partkey", F.round("score", 9).alias("score"), "rank")


@query(
    """WITH t AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'src/node_modules/x' || page_id || '.js' WHEN 1 THEN 'a/.env.' || page_id WHEN 2 THEN 'img/p' || page_id || '.PNG' WHEN 3 THEN 'lib/x' || page_id || '.min.js' WHEN 4 THEN '../up' || page_id || '.py' ELSE 'src/m' || page_id || '.py' END AS path, CASE WHEN page_id % 8 = 5 THEN 0 WHEN page_id % 16 = 6 THEN 600000 ELSE length(html) END AS byte_size FROM pages)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'skip_dir' WHEN 1 THEN 'secret_file' WHEN 2 THEN 'binary_extension' WHEN 3 THEN 'skip_pattern' WHEN 4 THEN 'path_traversal' WHEN 5 THEN 'empty' ELSE CASE WHEN byte_size > 512000 THEN 'too_large:' || byte_size END END AS reason, CASE WHEN page_id % 8 IN (0, 3) THEN 'javascript' WHEN page_id % 8 >= 4 THEN 'python' END AS language FROM t"""
)
def discovery_reasons(spark: SparkSession, sf: str) -> DataFrame:
    p, k = F.col("page_id").cast("string"), F.col("page_id") % 8
    path = F.when(k == 0, F.concat(F.lit("src/node_modules/x"), p, F.lit(".js"))).when(k == 1, F.concat(F.lit("a/.env."), p)).when(k == 2, F.concat(F.lit("img/p"), p, F.lit(".PNG"))).when(k == 3, F.concat(F.lit("lib/x"), p, F.lit(".min.js")))
    path = path.when(k == 4, F.concat(F.lit("../up"), p, F.lit(".py"))).otherwise(F.concat(F.lit("src/m"), p, F.lit(".py")))
    size = F.when(k == 5, 0).when(F.col("page_id") % 16 == 6, 600_000).otherwise(F.length("html"))
    tree = Tables(spark, sf).pages.select("page_id", path.alias("path"), size.alias("byte_size"))
    return tree.select("page_id", S.skip_reason(F.col("path"), F.col("byte_size")).alias("reason"), S.language_of(F.col("path")).alias("language"))


@query(_with(_FILES) + "SELECT 'changed' AS step, path AS name FROM files WHERE id % 3 = 0 OR id % 5 = 0 UNION ALL SELECT 'kept', path FROM files WHERE id % 5 <> 0 UNION ALL SELECT DISTINCT 'blobs', content_hash FROM files")
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan against an index that lacks every fifth file and has an older content of every third: what changed, what stays, and the contents held."""
    files = Code(spark, sf).files.select("id", "path", "content_hash", F.col("content"))
    stored = files.filter("id % 5 <> 0").withColumn("content_hash", F.when(F.col("id") % 3 == 0, "old").otherwise(F.col("content_hash")))
    blobs = S.store_blobs(files.select("content_hash", "content").dropDuplicates(["content_hash"]).filter("content_hash < '8'"), files)
    parts = [("changed", S.changed(files, stored), "path"), ("kept", S.purge(files, stored), "path"), ("blobs", blobs, "content_hash")]
    out = None
    for name, rows, key in parts:
        one = rows.select(F.lit(name).alias("step"), F.col(key).alias("name"))
        out = one if out is None else out.union(one)
    return out


@query("WITH d AS (SELECT DISTINCT source AS name FROM documents WHERE source <> 'src3'), t AS (SELECT DISTINCT source AS name FROM documents WHERE source <> 'src4') SELECT coalesce(d.name, t.name) AS name, CASE WHEN d.name IS NULL THEN 'missing_on_disk' WHEN t.name IS NULL THEN 'not_indexed' ELSE 'ok' END AS status FROM d FULL JOIN t ON d.name = t.name")
def library_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    names = Tables(spark, sf).documents.select(F.col("source").alias("name"))
    return S.reconcile(names.filter("name <> 'src3'"), names.filter("name <> 'src4'"))


@query("SELECT md5(CAST(event_id AS VARCHAR)) AS commit_hash, 'u' || user_id AS author, ts, event_type || '|' || props AS message FROM (SELECT event_id, user_id, event_type, props, date_trunc('second', ts) AS ts FROM events)")
def commit_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    value = F.concat_ws("|", F.md5(F.col("event_id").cast("string")), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "event_type", "props")
    return S.commit_log(Tables(spark, sf).events.select(value.alias("value"))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    _with(_SYMBOLS)
    + """SELECT 'm' || doc_id || '.py' AS path, CAST(n AS INTEGER) AS line, lpad(md5(CAST((doc_id + n) % 17 AS VARCHAR)), 40, 'a') AS commit_hash, 'author ' || (doc_id + n) % 17 AS author, to_timestamp(1700000000 + (doc_id + n) % 17)::TIMESTAMP AS ts FROM raw, range(1, 6) r(n)"""
)
def blame_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """Porcelain blame of five lines a file; a commit's author follows its first line of each file alone."""
    d = F.col("doc_id")
    commit = ((d + F.col("n")) % 17).cast("string")
    sha = F.lpad(F.md5(commit), 40, "a")
    n = F.col("n").cast("string")
    group = F.array(F.concat_ws(" ", sha, n, n, F.lit("1")), F.concat(F.lit("author author "), commit), F.concat(F.lit("author-time "), (F.lit(1_700_000_000) + (d + F.col("n")) % 17).cast("string")), F.lit("\tcode"))
    rows = Tables(spark, sf).documents.select(d, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))
    lines = rows.select(F.concat(F.lit("m"), d.cast("string"), F.lit(".py")).alias("path"), (F.col("n") * 10).alias("at"), F.posexplode(group).alias("pos", "value")).select("path", (F.col("at") + F.col("pos")).alias("n"), "value")
    return S.blame_lines(lines).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT s_nationkey || '/requirements.txt' AS path, 'pip' AS manager, 'pkg' || s_suppkey AS name, '1.' || s_suppkey AS version FROM supplier UNION ALL SELECT s_nationkey || '/package.json', 'npm', 'js' || s_suppkey, '2.' || s_suppkey FROM supplier UNION ALL SELECT s_nationkey || '/go.mod', 'go', 'example.com/m' || s_suppkey, 'v3.' || s_suppkey FROM supplier")
def dependency_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of three kinds for each nation, with a line a supplier."""
    k = F.col("s_suppkey").cast("string")
    s = Tables(spark, sf).supplier.select("s_nationkey", k.alias("k"))
    at = F.col("s_nationkey").cast("string")

    def manifest(name: str, line, head: str, tail: str, by: str) -> DataFrame:
        lines = F.array_join(F.array_sort(F.collect_list(line)), by)
        return s.groupBy("s_nationkey").agg(F.concat(F.lit(head), lines, F.lit(tail)).alias("content")).select(F.concat(at, F.lit("/"), F.lit(name)).alias("path"), "content")

    files = manifest("requirements.txt", F.concat(F.lit("pkg"), "k", F.lit("==1."), "k", F.lit("  # pinned")), "", "", "\n")
    files = files.union(manifest("package.json", F.concat(F.lit('"js'), "k", F.lit('": "^2.'), "k", F.lit('"')), '{"dependencies": {', "}}", ", "))
    files = files.union(manifest("go.mod", F.concat(F.lit("\texample.com/m"), "k", F.lit(" v3."), "k"), "module x\n\nrequire (\n", "\n)\n", "\n"))
    return manifests.dependencies(files)


@query("""SELECT 'b' || p_brand AS model, CASE p_partkey % 2 WHEN 0 THEN 'total_size' ELSE 'size' END AS "column", 'd' || p_partkey AS description, CASE p_partkey % 2 WHEN 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS score FROM part WHERE p_brand LIKE 'Brand#1%'""")
def model_column_search(spark: SparkSession, sf: str) -> DataFrame:
    p = Tables(spark, sf).part
    name = F.when(F.col("p_partkey") % 2 == 0, "total_size").otherwise("size")
    models = p.select(F.concat(F.lit("b"), "p_brand").alias("model"), F.create_map(name, F.concat(F.lit("d"), F.col("p_partkey").cast("string"))).alias("columns"))
    return manifests.columns_of(models, "bbrand#1*", "size")


@query(
    _with(_FILES, _REPOS, _SYMBOLS, _SECTIONS)
    + "SELECT r.id, CAST((SELECT count(*) FROM files f WHERE f.repo_id = r.id) AS BIGINT) AS files, CAST((SELECT count(*) FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.repo_id = r.id) AS BIGINT) AS symbols FROM repos r"
)
def repository_export(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    out = tables.export_repo(c.repos, c.files.drop("content"), c.symbols, c.sections)
    read = F.from_json("json", "id long, files array<struct<path: string, symbols: array<struct<symbol_id: string>>>>")
    n = F.aggregate(read["files"], F.lit(0).cast("long"), lambda a, f: a + F.coalesce(F.size(f["symbols"]), F.lit(0)))
    return out.select(read["id"].alias("id"), F.coalesce(F.size(read["files"]), F.lit(0)).cast("long").alias("files"), n.alias("symbols"))


# streams and state

@query("SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def category_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = usage.events(spark, sf, schema, "events.parquet")
    return usage.drained(usage.category_counts(rows, "user_id", "event_type", {"calls": F.count(F.lit(1)), "total": F.sum("value")})).withColumn("total", F.round("total", 4))


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def deduplicated_jobs_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's kind of event once, as a queue takes a key once while it waits; all events lie within the watermark."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = usage.events(spark, sf, schema, "events.parquet", delay="400 days")
    keyed = rows.select("ts", "user_id", "event_type", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"))
    return usage.drained(usage.first_of_key(keyed, "key").select("user_id", "event_type"), "append")


@query("SELECT event_id, value FROM events")
def emitted_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events through the sink and back."""
    import uuid

    folder = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    usage.emit(usage.events(spark, sf, schema, "events.parquet").select("event_id", "value", "event_type"), folder, ("event_type",)).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("event_id", "value")


@query(_with(_INSTANCES) + "SELECT instance_id FROM instances WHERE ended_at IS NULL OR ended_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def retained_instances(spark: SparkSession, sf: str) -> DataFrame:
    return usage.purge_ended(Code(spark, sf).instances, F.lit("2024-01-20").cast("timestamp_ntz")).select("instance_id")


@query("WITH n AS (SELECT user_id AS node_id, CASE WHEN user_id = 3 THEN 'leader' ELSE 'follower' END AS role, min(ts) AS started_at, max(ts) AS last_heartbeat FROM events GROUP BY 1), a AS (SELECT *, epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(last_heartbeat)) <= 36000 AS alive FROM n) SELECT node_id, alive, CASE WHEN alive AND row_number() OVER (ORDER BY alive DESC, (role = 'leader') DESC, started_at, node_id) = 1 THEN 'leader' ELSE 'follower' END AS role FROM a")
def node_liveness(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events.groupBy(F.col("user_id").alias("node_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_heartbeat"))
    nodes = e.withColumn("role", F.when(F.col("node_id") == 3, "leader").otherwise("follower"))
    return usage.live_nodes(nodes, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 36_000).select("node_id", "alive", "role")


@query(_with(_INSTANCES) + "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey IN (SELECT coding_session_id FROM instances) AND c_custkey NOT IN (SELECT coding_session_id FROM instances WHERE ended_at IS NULL) THEN TIMESTAMP '2024-02-01 00:00:00' END AS ended_at FROM customer")
def ended_sessions(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    sessions = c.t.customer.select(F.col("c_custkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("ended_at"))
    return usage.closed_sessions(sessions, c.instances, F.lit("2024-02-01").cast("timestamp_ntz"))


@query(
    """WITH e AS (SELECT user_id AS session_id, event_id % 4 AS instance, ts, event_type = 'purchase' AS ends, event_id FROM events),
l AS (SELECT *, CASE WHEN ends THEN ts ELSE least(ts + INTERVAL 8 HOURS, coalesce(lead(ts) OVER (PARTITION BY session_id, instance ORDER BY ts, event_id), ts + INTERVAL 8 HOURS)) END AS until FROM e),
b AS (SELECT *, coalesce(ts > max(until) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM l),
r AS (SELECT *, count_if(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
d AS (SELECT session_id, min(ts) AS started_at, max(until) AS ended_at, count(*) AS events, count(DISTINCT instance) AS instances FROM r GROUP BY session_id, run),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT session_id, 'ended' AS status, epoch_us(started_at) AS started_us, epoch_us(ended_at) AS ended_us, events, instances FROM d, m WHERE ended_at <= mark
UNION ALL SELECT session_id, 'purged', epoch_us(started_at), epoch_us(ended_at), events, instances FROM d, m WHERE ended_at + INTERVAL 7 DAYS <= mark"""
)
def session_lifetimes(spark: SparkSession, sf: str) -> DataFrame:
    """A user's sessions, of four instances each, by events that come in six micro-batches; a purchase ends an instance, as eight hours of silence do."""
    e = Tables(spark, sf).events.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 4).cast("string").alias("instance_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ends"), F.lit(1).cast("long").alias("events"))
    folder, old = _folder(spark), spark.conf.get(lifetimes.STATE_STORE[0])
    ordered = cut(e.withColumn("part", (F.dayofmonth("ts") / 6).cast("int")))
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # six rows
    files = max(1, min(min(counts.get(part, 0) for part in range(6)) // 100_000, spark.sparkContext.defaultParallelism))  # so few that none stays without rows
    for part in range(6):  # files of their own, one batch after the other
        own = ordered.filter(F.col("part") == part).drop("part")
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(folder)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(folder)
    spark.conf.set(*lifetimes.STATE_STORE)
    try:
        out = usage.drained(lifetimes.lifetimes(source, 8 * 3600), "append")
    finally:
        spark.conf.set(lifetimes.STATE_STORE[0], old)
    return out.select("session_id", "status", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "events", "instances")


@query(
    """WITH j AS (SELECT event_id AS id, user_id || event_type AS key, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS status, ts AS queued_at, ts + INTERVAL 1 MINUTE AS ended_at FROM events)
SELECT id, key, status FROM (SELECT * FROM j WHERE status <> 'done' QUALIFY row_number() OVER (PARTITION BY key ORDER BY (status = 'running') DESC, queued_at, id) = 1) UNION ALL SELECT id, key, status FROM (SELECT * FROM j WHERE status = 'done' ORDER BY ended_at DESC, id LIMIT 50)"""
)
def job_queue(spark: SparkSession, sf: str) -> DataFrame:
    e, k = Tables(spark, sf).events, F.col("event_id") % 3
    jobs = e.select(F.col("event_id").alias("id"), F.concat(F.col("user_id").cast("string"), "event_type").alias("key"), F.when(k == 0, "queued").when(k == 1, "running").otherwise("done").alias("status"), F.col("ts").alias("queued_at"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ended_at"))
    return usage.queued(jobs).select("id", "key", "status")


# parsing, over a module made for every document

def _modules(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    more = F.when(F.col("doc_id") % 3 == 0, "        elif b and a:\n            pass\n").otherwise("")
    head = F.concat(F.lit("import pkg.m"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("\n\nclass C"), d, F.lit("(Base):\n    def run(self, a, b):\n        if a:\n            return helper(a)\n"))
    text = F.concat(head, more, F.lit('\ndef helper(x):\n    """Helps."""\n    return x\n'))
    return Tables(spark, sf).documents.select(F.concat(F.lit("pkg/m"), d, F.lit(".py")).alias("path"), F.lit("python").alias("language"), text.alias("content"))


_MODULES = """m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS more FROM documents)"""


@query(
    _with(_MODULES)
    + """SELECT 'r::pkg/m' || doc_id || '.py::C' || doc_id || '#class' AS symbol_id, 'class' AS kind, 'class C' || doc_id || '(Base)' AS signature, NULL AS docstring, NULL AS parent_symbol_id, 3 AS line_start, CAST(6 + more AS INTEGER) AS line_end, CAST(2 + more AS INTEGER) AS cyclomatic, 3 AS max_nesting, 0 AS param_count FROM m
UNION ALL SELECT 'r::pkg/m' || doc_id || '.py::C' || doc_id || '.run#method', 'method', 'def run(self, a, b)', NULL, 'r::pkg/m' || doc_id || '.py::C' || doc_id || '#class', 4, CAST(6 + more AS INTEGER), CAST(2 + more AS INTEGER), 2, 2 FROM m
UNION ALL SELECT 'r::pkg/m' || doc_id || '.py::helper#function', 'function', 'def helper(x)', 'Helps.', NULL, CAST(8 + more AS INTEGER), CAST(10 + more AS INTEGER), 1, 1, 1 FROM m"""
)
def parsed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return code.symbols(_modules(spark, sf), "r").select("symbol_id", "kind", "signature", "docstring", "parent_symbol_id", "line_start", "line_end", "cyclomatic", "max_nesting", "param_count")


@query(_with(_MODULES) + "SELECT 'pkg/m' || doc_id || '.py' AS path, 'pkg.m' || (doc_id // 2) AS specifier, 'pkg/m' || (doc_id // 2) || '.py,pkg/m' || (doc_id // 2) || '/__init__.py,src/pkg/m' || (doc_id // 2) || '.py,src/pkg/m' || (doc_id // 2) || '/__init__.py' AS candidates FROM m")
def parsed_imports(spark: SparkSession, sf: str) -> DataFrame:
    return code.imports(_modules(spark, sf)).select("path", "specifier", F.array_join("candidates", ",").alias("candidates"))


@query(_with(_MODULES) + "SELECT 'pkg/m' || doc_id || '.py' AS path, 'r::pkg/m' || doc_id || '.py::C' || doc_id || '.run#method' AS caller_symbol_id, 'helper' AS callee, 6 AS line FROM m")
def parsed_calls(spark: SparkSession, sf: str) -> DataFrame:
    return code.calls(_modules(spark, sf), "r")


@query(
    """WITH s AS (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM part) SELECT p_partkey, CAST(CASE k WHEN 0 THEN p_size + 1 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 4 END AS INTEGER) AS cyclomatic, CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS INTEGER) AS max_nesting, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS param_count FROM s"""
)
def code_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of four kinds of function: as many branches as a part's size, braces, nothing, and nested braces with literals."""
    from loomdex.functions.complexity import complexity

    k = F.col("p_partkey") % 4
    flat = F.concat(F.lit("def f(self, a, b=(1, 2)):\n"), F.repeat(F.lit("    x = 1 if a else 2  # or b\n"), F.col("p_size")))
    source = F.when(k == 0, flat).when(k == 1, 'function f(a, b, [c, d]) { if (a && b) { return "x && y"; } }').when(k == 2, "").otherwise("func f(a map[string, int]) { for (;;) { if (a) { b() } else if (c) {} } }")
    language = F.when(k == 0, "python").when(k == 1, "javascript").when(k == 2, F.lit(None)).otherwise("go")
    return Tables(spark, sf).part.select("p_partkey", complexity(source, language).alias("m")).select("p_partkey", "m.*")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '[\"' || event_type || '\"]' AS listed, '' AS missing FROM events")
def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events
    listed = X.to_json_text(X.json_list(F.concat(F.lit('["'), "event_type", F.lit('"]'))))
    return e.select("event_id", F.try_element_at(X.json_map(F.col("props")), F.lit("k")).alias("k"), listed.alias("listed"), F.array_join(X.json_list(F.lit(None).cast("string")), ",").alias("missing"))


@query(
    """WITH d AS (SELECT doc_id, 't' || doc_id AS s FROM documents) SELECT 'd' || doc_id || '.md' AS path, position, title, level, slug, parent_position FROM (
SELECT doc_id, 0 AS position, 'T' || doc_id AS title, 1 AS level, s AS slug, NULL AS parent_position FROM d UNION ALL SELECT doc_id, 1, 'Part', 2, s || '/part', 0 FROM d UNION ALL SELECT doc_id, 2, 'Part', 2, s || '/part-2', 0 FROM d UNION ALL SELECT doc_id, 3, 'Deep', 3, s || '/part/deep', 2 FROM d)"""
)
def sections_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of a document made for every row, with the row's text between them on one line that can't be one."""
    d = F.col("doc_id").cast("string")
    body = F.concat(F.lit("> "), F.regexp_replace("text", r"[\n\r#=`~-]", " "))
    text = F.concat(F.lit("# T"), d, F.lit("\n\n"), body, F.lit("\n\n## Part\n\nx\n\n## Part\n\n### Deep\n"))
    docs = Tables(spark, sf).documents.select(F.concat(F.lit("d"), d, F.lit(".md")).alias("path"), text.alias("content"))
    return documents.sections(docs).select("path", "position", "title", "level", "slug", "parent_position")


# schema and state

@query("SELECT CAST(event_id AS BIGINT) AS id, 'src' || user_id AS name, CAST(NULL AS VARCHAR) AS version, CAST(round(value) AS VARCHAR) AS briefing FROM events")
def conformed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the declared columns of a table: types are cast, missing columns null, others left out."""
    e = Tables(spark, sf).events.select(F.col("event_id").cast("int").alias("id"), F.concat(F.lit("src"), "user_id").alias("name"), F.round("value").alias("briefing"), "props")
    return conform(e, "repos").select("id", "name", "version", "briefing")


@query("SELECT n_nationkey, n_name AS title, CAST(NULL AS BIGINT) AS size, 'up' AS way FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'back' FROM nation")
def migrated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A table two migrations up, and back again to the first columns."""
    steps = [
        Migration(1, "title", rename_column("nation", "n_name", "title"), rename_column("nation", "title", "n_name")),
        Migration(2, "size", add_column("nation", "size", "long"), drop_column("nation", "size")),
    ]
    first = {"nation": Tables(spark, sf).nation}
    up, at = migrate(first, steps, 0)
    back, _ = migrate(up, steps, at, 0)
    a = up["nation"].select("n_nationkey", "title", "size", F.lit("up").alias("way"))
    return a.union(back["nation"].select("n_nationkey", F.col("n_name").alias("title"), F.col("n_regionkey").cast("long").alias("size"), F.lit("back").alias("way")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 12 = 0 THEN 's_name,s_acctbal' WHEN s_suppkey % 4 = 0 THEN 's_name' ELSE 's_acctbal' END AS changed, s_suppkey % 5 = 0 AS is_new FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 6 = 0 OR s_suppkey % 5 = 0")
def dirty_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = Tables(spark, sf).supplier.select("s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey")
    edited = s.withColumns({"s_name": F.when(k % 4 == 0, "new").otherwise(F.col("s_name")), "s_acctbal": F.when(k % 6 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))})
    return mutate.dirty(s.filter(k % 5 != 0), edited, ["s_suppkey"]).withColumn("changed", F.array_join("changed", ","))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE s_name END AS s_name, s_acctbal FROM supplier")
def saved_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = Tables(spark, sf).supplier.select("s_suppkey", "s_name", "s_acctbal")
    edited = s.withColumn("s_name", F.when(F.col("s_suppkey") % 4 == 0, "new").otherwise(F.col("s_name")))
    return mutate.save(s.filter("s_suppkey % 5 <> 0"), edited, ["s_suppkey"])


@query("WITH c AS (SELECT user_id AS node_id, min(ts) AS first_ts FROM events GROUP BY 1), f AS (SELECT node_id FROM c ORDER BY first_ts, node_id LIMIT 1) SELECT 'free' AS lease, node_id AS holder FROM f UNION ALL SELECT 'stale', node_id FROM f UNION ALL SELECT 'held', -1 UNION ALL SELECT 'renewed', 5")
def lease_claims(spark: SparkSession, sf: str) -> DataFrame:
    claims = Tables(spark, sf).events.groupBy(F.col("user_id").alias("node_id")).agg(F.min("ts").alias("at"))
    now = F.lit("2024-02-01 00:00:30").cast("timestamp_ntz")
    out = None
    for name, holder, at in (("free", None, None), ("stale", -1, "2024-02-01 00:00:00"), ("held", -1, "2024-02-01 00:00:25"), ("renewed", 5, "2024-01-01 00:00:00")):
        lock = spark.range(1).select(F.lit(holder).cast("long").alias("holder"), F.lit(at).cast("timestamp_ntz").alias("taken_at")).filter("holder IS NOT NULL")
        one = usage.claim(lock, claims, now).select(F.lit(name).alias("lease"), "holder")
        out = one if out is None else out.union(one)
    return out


@query("SELECT event_type, count(*) - least(256, count(*)) AS dropped FROM events GROUP BY 1")
def bounded_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    return usage.fan_out(Tables(spark, sf).events, "event_type", "event_id")[1]


@query(_with(_FILES, _SYMBOLS) + "SELECT symbol_id, name, 'src/' || f.id || '/cli.py' AS path FROM symbols s JOIN files f ON f.id = s.file_id WHERE kind IN ('function', 'class') AND f.id % 9 = 0 AND NOT starts_with(name, 'test_') AND NOT starts_with(name, 'Test') AND name NOT IN ('main', 'setup', 'teardown') ORDER BY 3, 1 LIMIT 20")
def entry_point_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    c = Code(spark, sf)
    path = F.concat(F.lit("src/"), F.col("id").cast("string"), F.when(F.col("id") % 9 == 0, "/cli.py").otherwise("/m.py"))
    return overview.entry_points(c.symbols.filter("name NOT IN ('main', 'setup', 'teardown') AND NOT startswith(name, 'test_') AND NOT startswith(name, 'Test')").join(c.files.select(F.col("id").alias("file_id"), path.alias("path")), "file_id"))


# further sources, sinks and searches

@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def jdbc_source(spark: SparkSession, sf: str) -> DataFrame:
    """Customers loaded into a database and read back in ranges of their key; the database is Spark's own, its archive where all executors can open it."""
    c = Tables(spark, sf).customer.select("c_custkey", "c_name", "c_acctbal")
    url = tables.derby(c, "customer", "c_custkey")
    low, high = c.agg(F.min("c_custkey"), F.max("c_custkey")).head()
    return tables.jdbc(spark, url, '"customer"', "c_custkey", (low or 0, (high or 0) + 1), max(4, spark.sparkContext.defaultParallelism), driver=tables.DERBY)


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def partitions_overwritten(spark: SparkSession, sf: str) -> DataFrame:
    """A table by status of which one partition is written anew."""
    import uuid

    folder = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.write(o, folder, ["o_orderstatus"])
    tables.write(o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), folder, ["o_orderstatus"], "overwrite")
    return spark.read.parquet(folder).select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"), "o_totalprice")


@query("""SELECT p_partkey, CAST(greatest(1, length('{"id":' || p_partkey || ',"name":"' || p_name || '"}') // 4) AS BIGINT) AS tokens FROM part""")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).part.select("p_partkey", X.token_estimate(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).alias("tokens"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), CASE WHEN p_size % 2 = 0 THEN [p_type, 'part'] ELSE [] END))), ',') AS keywords FROM part")
def provider_keywords(spark: SparkSession, sf: str) -> DataFrame:
    p = Tables(spark, sf).part
    provided = F.when(F.col("p_size") % 2 == 0, F.array("p_type", F.lit("part")))
    return p.select("p_partkey", F.array_join(X.enriched(F.split("p_name", " "), provided), ",").alias("keywords"))


@query(
    """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) SELECT doc_id AS key FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'with')"""
)
def search_for_every_term(spark: SparkSession, sf: str) -> DataFrame:
    index = segments.build(Tables(spark, sf).documents, "doc_id", ["text"], _folder(spark))
    return index.search("with the", all_terms=True).select("key")


def _folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


@query(
    _with(
        _SECTIONS,
        "t AS (SELECT section_id, level, regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(coalesce(summary, '')), '[\\p{L}\\p{N}]+') AS b, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS c FROM sections)",
        "q AS (SELECT unnest(['user', 'the', 'que']) AS term)",
        "s AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS mean FROM t)",
        "p AS (SELECT section_id, level, term, 10.0 * len(list_filter(a, lambda x: x = term)) + 3.0 * len(list_filter(b, lambda x: x = term)) + len(list_filter(c, lambda x: x = term)) AS wtf, len(a) + len(b) + len(c) AS length FROM t, q WHERE list_contains(a, term) OR list_contains(b, term) OR list_contains(c, term))",
        "d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)",
    )
    + """SELECT section_id AS key, CAST(any_value(level) AS INTEGER) AS level, round(-sum(greatest(1e-6, ln((s.n - df + 0.5) / (df + 0.5))) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * length / s.mean))), 9) AS score FROM p JOIN d USING (term), s GROUP BY 1"""
)
def section_search(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by their weights of title, summary and text, with a column of theirs beside the score."""
    sections = Code(spark, sf).sections.withColumnRenamed("content", "body_text")
    index = search_index.build(sections, "section_id", ["title", "summary", "body_text"], _folder(spark), buckets=8)
    weights = {c: retrieval.SECTION_WEIGHTS[c] for c in ("title", "summary", "body_text")}
    found = search_index.search(index, "user the que", weights, sections.select(F.col("section_id").alias("key"), "level"))
    return found.select("key", "level", F.round("score", 9).alias("score"))


@query(CORE_SQL["hybrid_rrf"])
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    vector = list(t.embeddings.filter("vec_id = 0").head()["embedding"])
    found = retrieval.hybrid(t.documents, "doc_id", SEARCH, {"text": 1.0}, t.embeddings.withColumnRenamed("vec_id", "doc_id"), "embedding", vector, 10)
    return found.withColumn("score", F.round("score", 9))


def _grams(spark: SparkSession, sf: str) -> text_index.TextIndex:
    docs = Tables(spark, sf).documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return text_index.build(docs, _folder(spark))


@query(CORE_SQL["grep_lines"])
def indexed_grep(spark: SparkSession, sf: str) -> DataFrame:
    return _grams(spark, sf).grep("license", around=1)


_PATTERN = "(?i)(licen[cs]ed? under|copyright) .*[0-9a-z]"


@query(CORE_SQL["grep_lines"].replace("contains(lower(lines[n]), 'license')", f"regexp_matches(lines[n], '{_PATTERN}')"))
def indexed_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _grams(spark, sf).match(_PATTERN, around=1)


_LITERAL_PATTERN = r"Licensed under( the)? [A-Z]\w+"


@query(CORE_SQL["grep_lines"].replace("contains(lower(lines[n]), 'license')", f"regexp_matches(lines[n], '{_LITERAL_PATTERN}')"))
def indexed_literal_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern that only files with its literal part are read for."""
    return _grams(spark, sf).match(_LITERAL_PATTERN, around=1)


@query(
    """WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 'changed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 4 THEN o_custkey ELSE 0 END + CASE WHEN o_orderkey % 10 IN (3, 4) THEN 1 ELSE 0 END AS touched FROM orders WHERE o_orderkey % 10 <> 9)
SELECT o_orderkey, o_custkey, status, CAST(touched AS BIGINT) AS touched FROM b WHERE o_orderkey % 13 <> 0 UNION ALL SELECT -o_orderkey, o_custkey, 'new', 7 FROM orders WHERE o_orderkey % 10 = 9"""
)
def stored_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a table in a folder: created without every tenth, then merged into five times."""
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.lit(0).cast("long").alias("touched"))
    key = F.col("o_orderkey")
    table = stored.create(orders.filter(key % 10 != 9), ["o_orderkey"], _folder(spark), 16)
    table.insert_or_ignore(orders.filter((key % 10).isin(3, 4)).withColumn("status", F.lit("ignored")))
    table.upsert(orders.filter(key % 10 == 3).withColumns({"status": F.lit("changed"), "touched": F.lit(1).cast("long")}))
    table.update(orders.filter(key % 10 == 4).select("o_orderkey", (F.col("o_custkey") + 1).alias("touched")))
    table.upsert(orders.filter(key % 10 == 9).withColumns({"o_orderkey": -key, "status": F.lit("new"), "touched": F.lit(7).cast("long")}))
    return table.delete(orders.filter(key % 13 == 0).filter(key % 10 != 9)).vacuum().read()


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS calls, CAST(sum(event_id % 7) AS BIGINT) AS weight FROM events GROUP BY 1, 2")
def stored_counters_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of users and kinds of events, added to a table batch by batch."""
    e = Tables(spark, sf).events.select("user_id", "event_type", F.lit(1).cast("long").alias("calls"), (F.col("event_id") % 7).cast("long").alias("weight"))
    folder = _folder(spark)
    e.repartition(4).write.parquet(f"{folder}/in")
    table = stored.create(e.limit(0), ["user_id", "event_type"], f"{folder}/table", 8)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    source.writeStream.foreachBatch(table.sink("events")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS toks FROM documents),
w AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS pos FROM t),
p AS (SELECT DISTINCT doc_id, term, least(pos, 16383) AS pos FROM w), k AS (SELECT doc_id, term, pos FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY pos) <= 256),
n AS (SELECT doc_id, count(*) AS length FROM k GROUP BY 1)
SELECT a.doc_id AS key, round((1 - product(1 - sqrt(0.1 * 0.1 * CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1.0 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END))) / any_value(log2(length + 1)), 8) AS rank
FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.term = 'the' AND b.term = 'with' JOIN n ON n.doc_id = a.doc_id GROUP BY 1"""
)
def positional_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with both words by how near they stand to one another, divided by the logarithm of their length."""
    index = ts_rank.build(Tables(spark, sf).documents, "doc_id", {"text": "D"}, _folder(spark))
    return index.search("with the", flags=ts_rank.LOG_LENGTH).withColumn("rank", F.round("rank", 8))


@query("SELECT event_id, CAST(row_number() OVER w - 1 AS BIGINT) AS rank, CAST(sum(event_id % 100) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events WINDOW w AS (ORDER BY value DESC, event_id)")
def positions_of_events(spark: SparkSession, sf: str) -> DataFrame:
    """All events by falling value, with their ranks and a running sum."""
    order = [F.desc("value"), "event_id"]
    placed = positions.numbered(Tables(spark, sf).events.select("event_id", "value"), order)
    return positions.running(placed, ["rank"], F.col("event_id") % 100).drop("value")


@query("SELECT event_id, 3 AS page, CAST((SELECT ceil(count(*) / 40.0) FROM events) AS INTEGER) AS pages FROM events ORDER BY value DESC, event_id LIMIT 40 OFFSET 80")
def page_of_events(spark: SparkSession, sf: str) -> DataFrame:
    own, pages = positions.page(Tables(spark, sf).events.select("event_id", "value"), [F.desc("value"), "event_id"], 3, 40)
    return own.select("event_id", F.lit(3).alias("page"), F.lit(pages).alias("pages"))


def _neighbours_sql(distance: str, where: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id, {distance}(e.v, q.v) AS distance FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0{where})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, round(distance, 6) AS distance FROM d QUALIFY rank <= 10"""


def _neighbours(spark: SparkSession, sf: str, metric: str, where=None) -> DataFrame:
    """The ten nearest of every fiftieth vector, by an index of all."""
    e = Tables(spark, sf).embeddings
    index = vector_index.build(e, "vec_id", "embedding", _folder(spark), 64, metric, keep=["label"])
    found = index.search(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10, where, others=True)
    return found.rows.withColumnRenamed("key", "vec_id").withColumn("distance", F.round("distance", 6))


@query(_neighbours_sql("list_distance", ""))
def neighbours_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf, "l2")


@query(_neighbours_sql("list_cosine_distance", " AND e.label = 3"))
def neighbours_cosine_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf, "cosine", F.col("label") == 3)


@query("SELECT 'kept' AS reason, 'web/' || page_id || '.html' AS path, 1 AS files FROM pages WHERE page_id % 4 > 1 UNION ALL SELECT 'skip_dir', NULL, count(*) FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT 'secret_file', NULL, count(*) FROM pages WHERE page_id % 4 = 1")
def discovered_files(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("build/"), p)).when(k == 1, F.concat(F.lit("k/"), p, F.lit(".pem"))).otherwise(F.concat(F.lit("web/"), p, F.lit(".html")))
    tree = Tables(spark, sf).pages.select(path.alias("path"), F.length("html").cast("long").alias("byte_size"), F.encode("html", "utf-8").alias("content"))
    kept, left_out = S.discover(tree, None, 1 << 40)
    left_out = left_out.select("reason", F.lit(None).cast("string").alias("path"), "files")
    return kept.select(F.lit("kept").alias("reason"), "path", F.lit(1).cast("long").alias("files")).union(left_out)


@query("SELECT n_nationkey FROM nation QUALIFY row_number() OVER (PARTITION BY n_nationkey % 3, n_regionkey ORDER BY length(n_name) DESC, n_nationkey) = 1")
def near_preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Preferences of three scopes whose vectors are those of their region: of near ones the first by priority stays."""
    n = Tables(spark, sf).nation
    vector = F.array(*[F.when(F.col("n_regionkey") == i, 1.0).otherwise(0.01 * i) for i in range(5)])
    rows = n.select("n_nationkey", (F.col("n_nationkey") % 3).alias("scope_id"), vector.alias("v"), F.length("n_name").alias("priority"))
    return suppression.suppress(rows, "n_nationkey", "v", "priority", 0.99, 5, ["scope_id"]).select("n_nationkey")


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding AS v, row_number() OVER (ORDER BY label DESC, vec_id) AS place FROM embeddings),
near AS MATERIALIZED (SELECT a.place, list(b.place) AS sooner FROM e a JOIN e b ON b.place < a.place AND list_cosine_similarity(a.v, b.v) >= 0.3 GROUP BY 1),
steps(place, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
SELECT e.place, CASE WHEN list_has_any(kept, coalesce(sooner, [])) THEN kept ELSE list_append(kept, e.place) END FROM steps JOIN e ON e.place = steps.place + 1 LEFT JOIN near ON near.place = e.place)
SELECT vec_id, label FROM (SELECT vec_id, place FROM e) JOIN embeddings USING (vec_id) WHERE place IN (SELECT unnest(kept) FROM (SELECT kept FROM steps ORDER BY place DESC LIMIT 1))"""
)
def vectors_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors by falling label; of ones within a cosine of 0.3, which here make chains, the first stay."""
    return suppression.suppress(Tables(spark, sf).embeddings, "vec_id", "embedding", "label", 0.3, 64).select("vec_id", "label")

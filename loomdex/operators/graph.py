"""Graph operators over edge DataFrames: frontier joins, impact, hierarchy, references, trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import identifier_tokens, relatedness
from loomdex.operators.diff import capped, containing
from loomdex.operators.predicates import LOWER, UPPER, like
from loomdex.plans.lineage import cut

MOST_DEPTH = 3
LISTED = 25


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(nodes(seed, id, depth), edges(seed, src, dst, depth))`` reached from ``seeds(id)`` within ``depth`` (1 to 3) steps.

    Depth is that of the first visit.  Every edge out of a frontier is kept, those to known nodes too.
    """
    e = edges.select(F.col("src" if not reverse else "dst").alias("at"), F.col("dst" if not reverse else "src").alias("to")).distinct()
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct()
    frontier, walked = seen, None
    for d in range(1, max(1, min(MOST_DEPTH, depth)) + 1):
        step = frontier.join(e, frontier["id"] == e["at"]).select("seed", "at", "to")
        walked_now = step.withColumn("depth", F.lit(d))
        walked = walked_now if walked is None else walked.union(walked_now)
        new = step.select("seed", F.col("to").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(d)))
        seen = seen.union(frontier)
    src, dst = ("at", "to") if not reverse else ("to", "at")
    return seen, walked.select("seed", F.col(src).alias("src"), F.col(dst).alias("dst"), "depth")


def dependency_graph(edges: DataFrame, files: DataFrame, target, direction: str = "both", depth: int = 1, symbol_counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, path, is_target, symbol_count) and distinct edges around one file."""
    seed = files.filter(F.col("id") == target).select("id")
    parts = [bfs(edges, seed, depth, reverse=r) for r in ((False,) if direction == "imports" else (True,) if direction == "importers" else (False, True))]
    nodes = parts[0][0].select("id")
    walked = parts[0][1].select("src", "dst")
    for n, e in parts[1:]:
        nodes, walked = nodes.union(n.select("id")), walked.union(e.select("src", "dst"))
    detail = nodes.distinct().join(files, "id").select("id", "path", (F.col("id") == target).alias("is_target"))
    if symbol_counts is not None:
        detail = detail.join(symbol_counts, "id", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))
    return detail, walked.distinct()


def word_hits(content: Column, name: str) -> Column:
    """Occurrences of a name between word boundaries."""
    return F.regexp_count(content, F.lit(rf"(?U)\b\Q{name}\E\b"))


def blast_radius(files: DataFrame, imports: DataFrame, target: int, name: str, depth: int = 2, cap: int | None = LISTED, repos: list[int] | None = None) -> DataFrame:
    """``(id, path, repo_id, depth, hits, kind, total, cross_repo)`` of the files that a change of symbol ``name`` in file ``target`` reaches.

    ``files(id, repo_id, path, content)``, ``imports(file_id, specifier, resolved_file_id)``.  First come the importers by
    resolved id or by a specifier like the file's stem, then importers of those by resolved id.  A file
    that names the symbol is confirmed, else potential; each kind is listed up to ``cap``, with its full number in ``total``.
    """
    here = files.filter(F.col("id") == target).select("path", "repo_id").head()
    if here is None:
        return files.select("id", "path", "repo_id", F.lit(0).alias("depth"), F.lit(0).alias("hits"), F.lit("").alias("kind"), F.lit(0).alias("total"), F.lit(False).alias("cross_repo")).limit(0)
    scope = files if repos is None else files.filter(F.col("repo_id").isin(repos))
    stem = re.sub(r"\.[^.]*$", "", here["path"].rpartition("/")[2])
    own = scope.select(F.col("id").alias("file_id"))
    used = imports.join(own, "file_id")
    first = used.filter((F.col("resolved_file_id") == target) | like(F.col("specifier"), f"%{stem}%")).select(F.col("file_id").alias("id")).filter(F.col("id") != target).distinct()
    edges = used.filter("resolved_file_id IS NOT NULL").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst")).distinct()
    seen, frontier = first.withColumn("depth", F.lit(1)), first
    for d in range(2, max(1, min(MOST_DEPTH, depth)) + 1):
        step = frontier.join(edges, frontier["id"] == edges["dst"]).select(F.col("src").alias("id")).filter(F.col("id") != target).distinct()
        frontier = cut(step.join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    reached = seen.join(files, "id").select("id", "path", "repo_id", "depth", F.coalesce(word_hits(F.col("content"), name), F.lit(0)).alias("hits"))
    kinds = reached.withColumns({"kind": F.when(F.col("hits") > 0, "confirmed").otherwise("potential"), "cross_repo": F.col("repo_id") != here["repo_id"]})
    return capped(kinds, ["kind"], ["depth", "path"], cap or 2**31 - 1)


def blast_radii(files: DataFrame, imports: DataFrame, targets: DataFrame, depth: int = 2, cap: int | None = LISTED) -> DataFrame:
    """``blast_radius`` of many ``targets(target, name)`` in one plan, with ``target, name`` in front and ``error`` behind.

    An unknown target has one row whose error says so.  Frontiers carry their target, so a step is one join for all.
    """
    t = targets.select(F.col("target").cast("long").alias("target"), "name").distinct()
    here = t.join(files.select(F.col("id").alias("target"), F.col("path").alias("_path"), F.col("repo_id").alias("_repo")), "target")
    known = cut(here.withColumn("_stem", F.regexp_replace(F.element_at(F.split("_path", "/"), -1), r"\.[^.]*$", "")))
    used = imports.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    direct = known.select("target").distinct().join(used, F.col("target") == F.col("resolved_file_id")).select("target", F.col("file_id").alias("id"))
    # distinct specifiers are compared with the stems that they can be like, as ``blast_radius`` compares them
    low = used.select("specifier", F.translate("specifier", UPPER, LOWER).alias("whole")).filter("whole IS NOT NULL").distinct()
    stems = known.select("target", F.translate("_stem", UPPER, LOWER).alias("part")).distinct()
    alike = containing(low.select("whole").distinct(), stems.select("part").distinct(), wild=True).join(low, "whole").select("specifier", "part")
    named = stems.join(alike, "part").join(used, "specifier").select("target", F.col("file_id").alias("id"))
    edges = used.filter("resolved_file_id IS NOT NULL").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst")).distinct()
    frontier = cut(direct.union(named).filter("id <> target").distinct())
    seen = frontier.withColumn("depth", F.lit(1))
    for d in range(2, max(1, min(MOST_DEPTH, depth)) + 1):
        step = frontier.join(edges, frontier["id"] == edges["dst"]).select("target", F.col("src").alias("id")).filter("id <> target").distinct()
        frontier = cut(step.join(seen, ["target", "id"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    reached = cut(seen.join(known.select("target", "name", "_repo"), "target"))
    # a text is looked at once for each name that is sought in it, however many targets reach its file
    hits = F.expr(r"coalesce(regexp_count(content, concat('(?U)\\b\\Q', name, '\\E\\b')), 0)")
    counted = reached.select("id", "name").distinct().join(files.select("id", "content"), "id").select("id", "name", hits.alias("hits"))
    placed = reached.join(files.select("id", "path", "repo_id"), "id").join(counted, ["id", "name"])
    kinds = placed.select("target", "name", "id", "path", "repo_id", "depth", "hits", (F.col("repo_id") != F.col("_repo")).alias("cross_repo"))
    kinds = kinds.withColumn("kind", F.when(F.col("hits") > 0, "confirmed").otherwise("potential"))
    out = capped(kinds, ["target", "name", "kind"], ["depth", "path"], cap or 2**31 - 1).withColumn("error", F.lit(None).cast("string"))
    unknown = t.join(known, ["target", "name"], "left_anti").select("target", "name", F.lit("unknown target").alias("error"))
    return out.unionByName(unknown, allowMissingColumns=True)


def related_symbols(symbols: DataFrame, symbol_id: str, k: int = 10) -> DataFrame:
    """``(symbol_id, score)`` of the ``k`` symbols most related to one: same file and shared name tokens, score over 0."""
    own = symbols.filter(F.col("symbol_id") == symbol_id).select("file_id", identifier_tokens(F.col("name")).alias("t")).head()
    if own is None:
        return symbols.select("symbol_id", F.lit(0.0).alias("score")).limit(0)
    tokens = F.array(*[F.lit(x) for x in own["t"]]) if own["t"] else F.array().cast("array<string>")
    score = relatedness(F.col("file_id") == own["file_id"], identifier_tokens(F.col("name")), tokens)
    others = symbols.filter(F.col("symbol_id") != symbol_id).select("symbol_id", score.alias("score"))
    return others.filter("score > 0").orderBy(F.col("score").desc(), "symbol_id").limit(k)


def importers(files: DataFrame, imports: DataFrame, targets: DataFrame, symbol_counts: DataFrame) -> DataFrame:
    """``(target, id, path, symbol_count, has_importers)`` for ``targets(target)``; unknown targets have one row with null id."""
    direct = imports.filter("resolved_file_id IS NOT NULL").select(F.col("resolved_file_id").alias("target"), F.col("file_id").alias("id")).distinct()
    imported = imports.filter("resolved_file_id IS NOT NULL").select(F.col("resolved_file_id").alias("id")).distinct().withColumn("has_importers", F.lit(True))
    rows = targets.join(direct, "target", "left").join(files.select("id", "path"), "id", "left").join(symbol_counts, "id", "left").join(imported, "id", "left")
    return rows.select("target", "id", "path", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.coalesce("has_importers", F.lit(False)).alias("has_importers"))


def base_classes(signature: Column) -> Column:
    """Base names of a class signature: in parentheses, after extends, implements or a colon; generics go, names start upper-case, object doesn't count."""
    found = F.concat(
        *[
            F.split(F.regexp_extract(F.coalesce(signature, F.lit("")), p, 1), ",")
            for p in (r"class\s+\w+\s*\(([^)]+)\)", r"extends\s+([\w.,\s<>]+?)(?:\s+implements|\s*\{|\s*$)", r"implements\s+([\w.,\s<>]+?)(?:\s*\{|\s*$)", r"class\s+\w+[^(:]*:\s*([^{(]+)")
        ]
    )
    plain = F.transform(found, lambda b: F.element_at(F.split(F.trim(F.regexp_replace(b, r"<[^>]*>", "")), r"\s+"), -1))
    return F.array_distinct(F.filter(plain, lambda b: b.rlike(r"(?U)^\p{Lu}") & ~b.isin("object", "Object")))


def hierarchy_edges(symbols: DataFrame) -> DataFrame:
    """``(child, parent)`` class names."""
    return symbols.filter(F.col("kind") == "class").select(F.col("name").alias("child"), F.explode(base_classes(F.col("signature"))).alias("parent")).distinct()


def closure(edges: DataFrame, start: str, src: str, dst: str) -> DataFrame:
    """``(name, depth)`` of all nodes reachable from one, each once; frontiers are written, so cycles end and plans stay short."""
    spark = edges.sparkSession
    e = cut(edges.select(F.col(src).alias("at"), F.col(dst).alias("to")).distinct())
    seen = spark.range(1).select(F.lit(start).alias("name"), F.lit(0).alias("depth"))
    frontier, d = seen, 0
    while True:
        d += 1
        step = frontier.join(e, frontier["name"] == e["at"]).select(F.col("to").alias("name")).distinct().join(seen, "name", "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            return seen.filter("depth > 0")
        seen = cut(seen.unionByName(frontier))


def class_hierarchy(symbols: DataFrame, name: str) -> DataFrame:
    """``(name, depth, relation, location)``: ancestors and descendants; ancestors without a symbol are "(external)"."""
    edges = hierarchy_edges(symbols)
    known = symbols.filter(F.col("kind") == "class").groupBy("name").agg(F.min("symbol_id").alias("symbol_id"))
    up = closure(edges, name, "child", "parent").withColumn("relation", F.lit("ancestor"))
    down = closure(edges, name, "parent", "child").withColumn("relation", F.lit("descendant"))
    return up.union(down).join(known, "name", "left").select("name", "depth", "relation", F.coalesce("symbol_id", F.lit("(external)")).alias("location"))


def first_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``(key, value)``: the value of a key's first row."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def last_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def reference_graph(files: DataFrame, symbols: DataFrame, imports: DataFrame, contents: DataFrame) -> DataFrame:
    """``(source_symbol_id, target_symbol_id, target_specifier)`` of resolved imports.

    A symbol of the imported file is a target if it is among the imported names or, where none are named, occurs as a word.  The source
    is the importing file's first symbol, or ``__file__:path``.
    """
    heads = symbols.groupBy("file_id").agg(F.min_by("symbol_id", "id").alias("head"))
    resolved = imports.filter("resolved_file_id IS NOT NULL").select("file_id", "specifier", "names", "resolved_file_id")
    pairs = resolved.join(symbols.select(F.col("file_id").alias("resolved_file_id"), F.col("symbol_id").alias("target_symbol_id"), F.col("name").alias("target_name")), "resolved_file_id")
    with_names = F.coalesce(F.size("names"), F.lit(0)) > 0
    kept = ["file_id", "specifier", "target_symbol_id"]
    named = pairs.filter(with_names & F.array_contains("names", F.col("target_name"))).select(*kept)
    # without names a text's words are taken once; only a name that is no word is sought in the text of each pair
    nameless = pairs.filter(~with_names & F.col("target_name").isNotNull())
    text = files.join(contents, "content_hash").select(F.col("id").alias("file_id"), F.col("content").cast("string").alias("content"))
    of_importers = text.join(resolved.filter(~with_names).select("file_id").distinct(), "file_id", "left_semi")
    is_word = F.col("target_name").rlike(r"(?U)^\w+$")
    words = of_importers.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?U)\w+"), F.lit(0)))).alias("target_name"))
    by_word = nameless.filter(is_word).join(words, ["file_id", "target_name"], "left_semi").select(*kept)
    occurs = F.expr(r"coalesce(regexp_count(content, concat('(?U)\\b\\Q', target_name, '\\E\\b')), 0) > 0")
    by_text = nameless.filter(~is_word).join(text, "file_id").filter(occurs).select(*kept)
    hits = named.union(by_word).union(by_text).join(files.select(F.col("id").alias("file_id"), "path"), "file_id").join(heads, "file_id", "left")
    return hits.select(F.coalesce("head", F.concat(F.lit("__file__:"), F.col("path"))).alias("source_symbol_id"), "target_symbol_id", F.col("specifier").alias("target_specifier")).distinct()


def callers(references: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: str) -> DataFrame:
    """One step against the references; callers without a symbol row are kept."""
    s = symbols.select(F.col("symbol_id").alias("source_symbol_id"), "name", "kind", "file_id")
    hits = references.filter(F.col("target_symbol_id") == symbol_id)
    return hits.join(s, "source_symbol_id", "left").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("source_symbol_id", "name", "kind", "path", "line")


def callees(references: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: str) -> DataFrame:
    s = symbols.select(F.col("symbol_id").alias("target_symbol_id"), "name", "kind", "file_id")
    hits = references.filter(F.col("source_symbol_id") == symbol_id)
    return hits.join(s, "target_symbol_id", "left").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("target_symbol_id", "target_specifier", "name", "kind", "path", "line")


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls(caller_symbol_id, callee, line)`` with ``target_symbol_id``: by exact name, then qualified name, then ``self.x`` in the caller's class."""
    by_name = first_of(symbols, "name", "symbol_id", "id").select(F.col("name").alias("callee"), F.col("symbol_id").alias("_by_name"))
    by_qualified = last_of(symbols, "qualified_name", "symbol_id", "id")
    own_class = F.regexp_extract(F.col("caller_symbol_id"), r"::([^:#]*)\.[^.:#]*#method$", 1)
    keyed = calls.withColumn("_method", F.when(F.col("callee").startswith("self."), F.concat(own_class, F.lit("."), F.substring_index("callee", ".", -1))))
    out = keyed.join(by_name, "callee", "left")
    out = out.join(by_qualified.select(F.col("qualified_name").alias("callee"), F.col("symbol_id").alias("_by_qualified")), "callee", "left")
    out = out.join(by_qualified.select(F.col("qualified_name").alias("_method"), F.col("symbol_id").alias("_by_self")), "_method", "left")
    return out.select("caller_symbol_id", "callee", "line", F.coalesce("_by_name", "_by_qualified", "_by_self").alias("target_symbol_id"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(id, repo_id, candidates array<string>)`` with ``resolved_file_id``: the first candidate path that the repo has."""
    each = imports.select("id", "repo_id", F.posexplode("candidates").alias("pos", "path"))
    hits = each.join(files.select("repo_id", "path", F.col("id").alias("file_id")), ["repo_id", "path"])
    best = hits.groupBy("id").agg(F.min_by("file_id", "pos").alias("resolved_file_id"))
    return imports.join(best, "id", "left")


def cross_repo_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Unresolved ``imports(id, repo_id, specifier)`` matched to another repo's file by path, file name, stem or dotted path, in that order."""
    name = F.element_at(F.split("path", "/"), -1)
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    keys = F.array(F.col("path"), name, F.regexp_replace(name, r"\.[^.]*$", ""), F.translate(bare, "/", "."))
    known = files.select(F.col("id").alias("file_id"), F.col("repo_id").alias("other_repo"), F.posexplode(keys).alias("rank", "specifier"))
    hits = imports.join(known, "specifier").filter(F.col("repo_id") != F.col("other_repo"))
    return hits.groupBy("id").agg(F.min(F.struct("rank", "file_id")).alias("b")).select("id", F.col("b.file_id").alias("resolved_file_id"))


def children(rows: DataFrame, key: str, parent: str, *order: str) -> DataFrame:
    """Rows with their direct children as a sorted array of structs; rows whose parent isn't there count as roots (``is_root``)."""
    kids = rows.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_of")).agg(F.array_sort(F.collect_list(F.struct(*order, key))).alias("children"))
    ids = rows.select(F.col(key).alias("_id")).distinct()
    out = rows.join(kids, F.col(key) == F.col("_of"), "left").join(ids, F.col(parent) == F.col("_id"), "left")
    return out.withColumns({"is_root": F.col("_id").isNull(), "child_count": F.coalesce(F.size("children"), F.lit(0))}).drop("_of", "_id")


def file_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """``(node, level, files)``: path prefixes down to ``depth`` with the number of files below."""
    parts = F.split("path", "/")
    ends = F.sequence(F.lit(1), F.least(F.lit(max(1, min(10, depth))), F.size(parts)))
    prefixes = F.transform(ends, lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), i.alias("level")))
    return files.select(F.explode(prefixes).alias("p")).groupBy("p.node", "p.level").agg(F.count(F.lit(1)).alias("files"))


def toc(sections: DataFrame, max_depth: int = 3) -> DataFrame:
    """Sections down to a level, with the number of those cut off below each parent."""
    cut_off = sections.filter(F.col("level") > max_depth).groupBy(F.col("parent_section_id").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    return sections.filter(F.col("level") <= max_depth).join(cut_off, F.col("section_id") == F.col("_of"), "left").withColumn("truncated", F.coalesce("_n", F.lit(0))).drop("_of", "_n")


def section_parents(sections: DataFrame, doc: str = "file_id", position: str = "position") -> DataFrame:
    """``parent``: the position of the nearest preceding section of the document with a smaller level.

    A parent is the last row at a lower level, and levels are few, so it is the greatest of one running maximum a level.
    """
    w = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > level, F.max(F.when(F.col("level") == level, F.col(position))).over(w)) for level in range(1, 7)]
    return sections.withColumn("parent", F.greatest(*last))


def rename_edits(files: DataFrame, old: str, new: str) -> DataFrame:
    """``(path, line, before, after)`` for every line that has the old name between word boundaries."""
    p = rf"(?U)\b\Q{old}\E\b"
    lines = files.filter(F.contains("content", F.lit(old))).select("path", F.posexplode(F.split("content", "\n")).alias("pos", "before"))
    return lines.filter(F.col("before").rlike(p)).select("path", (F.col("pos") + 1).alias("line"), "before", F.regexp_replace("before", p, re.sub(r"([\\$])", r"\\\1", new)).alias("after"))


def classify_occurrence(line: Column, path: Column, name: str) -> Column:
    """What a name's line is: documentation, import_path, class_name, string_literal, comment or code_identifier, tried in this order."""
    s, p = F.trim(line), F.lower(path)
    word = rf"(?<![A-Za-z])\Q{name}\E(?![A-Za-z])"
    quoted = rf"^(?:[^'\"]|'[^']*'|\"[^\"]*\")*(?:'[^']*{word}|\"[^\"]*{word})"
    comment = (p.rlike(r"\.(py|ya?ml|toml)$") & s.startswith("#")) | (p.rlike(r"\.(js|ts|vue|go|java|rs)$") & s.rlike(r"^(//|/\*|\*)"))
    triple = p.endswith(".py") & s.rlike(r"^(\"\"\"|''')|(\"\"\"|''')$")
    return (
        F.when(p.rlike(r"\.(md|markdown|rst|txt|adoc|asciidoc|html?)$"), "documentation")
        .when(s.rlike(r"^(import\s|from\s+\S+\s+import)"), "import_path")
        .when(s.rlike(rf"(?U)^class\s+\Q{name}\E\b"), "class_name")
        .when(F.contains(s, F.lit(f"`{name}`")) | s.rlike(quoted) | triple, "string_literal")
        .when(comment, "comment")
        .otherwise("code_identifier")
    )


def context_bundle(symbols: DataFrame, imports: DataFrame, references: DataFrame, files: DataFrame, symbol_id: str, siblings: int = 10) -> DataFrame:
    """One row: the symbol, its file's imports, the files of its callers, and up to ``siblings`` others of its file by line."""
    s = symbols.filter(F.col("symbol_id") == symbol_id)
    others = symbols.select("file_id", F.col("symbol_id").alias("_sibling"), F.col("line_start").alias("_line")).filter(F.col("_sibling") != symbol_id)
    near = s.select("file_id").join(others, "file_id").orderBy("_line", "_sibling").limit(siblings).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("_line", "_sibling"))).alias("siblings"))
    used = imports.groupBy("file_id").agg(F.array_sort(F.collect_set("specifier")).alias("imports"))
    called = callers(references, symbols, files, symbol_id).agg(F.array_sort(F.collect_set("path")).alias("caller_files"))
    return s.join(near, "file_id", "left").join(used, "file_id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(called.withColumn("_one", F.lit(1))), "_one").drop("_one")

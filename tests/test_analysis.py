"""Retrieval, graph, quality, text and sources on literal fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.functions.complexity import brace_depth, complexity, cyclomatic, indent_depth, params
from loomdex.operators import components, diff, graph, quality, retrieval
from loomdex.operators.components import connected_components
from loomdex.plans.lineage import cut
from loomdex.sources import code, documents, files, manifests


def lists(spark, a, b):
    make = lambda xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "id string, rank int")
    return make(a), make(b)


@pytest.mark.parametrize(("fts", "vec", "first"), [(["a", "b", "c"], [], ["a", "b", "c"]), ([], ["x", "y"], ["x", "y"]), ([], [], []), (["a", "b"], ["b", "c"], ["b"])])
def test_rrf(spark, fts, vec, first):
    got = [r["id"] for r in retrieval.rrf(*lists(spark, fts, vec), "id", 10).collect()]
    assert got[: len(first)] == first and set(got) == {*fts, *vec}


def test_fts_terms():
    assert X.fts_terms('foo"bar AND x under_score a-b NOT') == ["foo", "bar", "under_score", "a-b"]
    assert X.fts_terms("!! ?") == []


def test_bm25(spark):
    d = spark.createDataFrame([(1, "apple apple pie"), (2, "apple tart with cream and sugar"), (3, "plain bread"), (4, None)], "id long, t string")
    assert [r["id"] for r in retrieval.bm25(d, "id", "apple", {"t": 1.0}).collect()] == [1, 2]
    assert retrieval.bm25(d, "id", "?", {"t": 1.0}).count() == 0
    q = spark.createDataFrame([("q1", "apple"), ("q2", "  ")], "query_id string, query string")
    rows = retrieval.batch_search(d, "id", {"t": 1.0}, q, 5).collect()
    assert [(r["query_id"], r["id"]) for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"] or 0))] == [("q1", 1), ("q1", 2), ("q2", None)]


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 100), (2, 10), (3, 60), (4, 1)], "id long, cost long")
    assert [r["id"] for r in retrieval.token_budget(rows, ["id"], F.col("cost"), 50).collect()] == [1]
    assert [r["id"] for r in retrieval.token_budget(rows.filter("id > 1"), ["id"], F.col("cost"), 50).collect()] == [2]


def test_components(spark):
    r = random.Random(1)
    for edges in ([(i, i + 1) for i in range(40)], [(50, i) for i in range(30)], [(r.randrange(60), r.randrange(60)) for _ in range(45)], []):
        parent = {v: v for e in edges for v in e if e[0] != e[1]}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "src long, dst long")
        assert dict(connected_components(df).collect()) == {v: find(v) for v in parent}


def test_components_estimates_do_not_multiply_over_rounds(spark, monkeypatch):
    """The planner's size of what a round leaves stays a number of some digits, however many rounds came before."""
    bits = []

    def watched(df):
        out = cut(df)
        bits.append(out._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(components, "cut", watched)
    n = 2_000
    path = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("src"), F.pmod((F.col("id") + 1) * 7919, F.lit(n)).alias("dst"))
    found = connected_components(path).collect()
    assert len(found) == n and {r["root"] for r in found} == {0}
    assert len(bits) > 8 and max(bits) < 1_000, bits


def test_components_end_in_one_step_when_few_edges_are_left(spark, monkeypatch):
    """Rounds cost the driver memory, so a long path among many pairs doesn't take as many as the path alone."""
    steps, settled = [], []
    monkeypatch.setattr(components, "cut", lambda df: steps.append(cut(df)) or steps[-1])
    monkeypatch.setattr(components, "settle", lambda spark: settled.append(len(steps)))
    pairs = [(1_000 + 2 * i, 1_001 + 2 * i) for i in range(40_000)]
    path = [(i * 37 % 60 - 20, (i + 1) * 37 % 60 - 20) for i in range(59)]
    edges = spark.createDataFrame([*pairs, *path, (None, 1), (7, 7)], "src long, dst long")
    found = {r["id"]: r["root"] for r in connected_components(edges).collect()}
    assert found == {v: a for a, b in pairs for v in (a, b)} | {v: -20 for v in range(-20, 40)}
    assert len(steps) <= 4 and settled, steps


def test_the_last_edges_are_joined_under_the_smallest_id():
    import random

    import pyarrow as pa

    r = random.Random(3)
    for n in (1, 5, 40, 400):
        edges = [(r.randrange(-n, n), r.randrange(-n, n)) for _ in range(n)]
        batches = [pa.RecordBatch.from_pylist([{"src": a, "dst": b} for a, b in edges[i : i + 7]]) for i in range(0, n, 7)]
        got = {k: v for out in components._last(iter(batches)) for k, v in zip(out.column("id").to_pylist(), out.column("root").to_pylist(), strict=True)}
        want = {v: v for e in edges for v in e}
        for _ in range(n):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        assert got == want
    assert list(components._last(iter([]))) == []


def test_bfs_keeps_edges_to_known_nodes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    nodes, edges = graph.bfs(e, spark.createDataFrame([(1,)], "id long"), 3)
    assert {r["id"]: r["depth"] for r in nodes.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(1, 2), (2, 3), (3, 1), (3, 4)}


def test_hierarchy(spark):
    s = spark.createDataFrame([("1", "Animal", "class", "class Animal"), ("2", "Dog", "class", "class Dog(Animal)"), ("3", "Golden", "class", "class Golden(Dog, Ext)")], "symbol_id string, name string, kind string, signature string")
    got = {(r["name"], r["depth"], r["relation"], r["location"]) for r in graph.class_hierarchy(s, "Dog").collect()}
    assert got == {("Animal", 1, "ancestor", "1"), ("Golden", 1, "descendant", "3")}
    assert ("Ext", 1, "ancestor", "(external)") in {(r["name"], r["depth"], r["relation"], r["location"]) for r in graph.class_hierarchy(s, "Golden").collect()}


@pytest.mark.parametrize(
    ("signature", "bases"),
    [("class A(B, C)", ["B", "C"]), ("class A(object)", []), ("class A extends B", ["B"]), ("class A : public B", ["B"]), ("class A extends List<T> implements I, J", ["List", "I", "J"]), ("class a(lower)", []), ("", [])],
)
def test_base_classes(spark, signature, bases):
    assert spark.range(1).select(graph.base_classes(F.lit(signature))).head()[0] == bases


def test_blast_radius(spark):
    f = spark.createDataFrame([(1, 1, "src/util.py", "def helper(): 1"), (2, 1, "src/a.py", "from util import helper\nhelper()"), (3, 1, "src/b.py", "import a"), (4, 2, "x.py", "helpers")], "id long, repo_id long, path string, content string")
    i = spark.createDataFrame([(2, "util", 1), (3, "a", 2), (4, "pkg.util", None)], "file_id long, specifier string, resolved_file_id long")
    got = {r["id"]: (r["depth"], r["kind"], r["hits"], r["cross_repo"]) for r in graph.blast_radius(f, i, 1, "helper", 2).collect()}
    assert got == {2: (1, "confirmed", 2, False), 3: (2, "potential", 0, False), 4: (1, "potential", 0, True)}


def test_dead_code(spark):
    s = spark.createDataFrame([(n, n, "function", "utils.py") for n in ("used_func", "dead_func", "main", "test_foo", "_private")], "symbol_id string, name string, kind string, path string")
    refs = spark.createDataFrame([("caller", "used_func"), ("x", None)], "source_symbol_id string, target_symbol_id string")
    assert [r["name"] for r in quality.dead_code(s, refs).collect()] == ["dead_func"]
    assert quality.dead_code(s, refs.filter("target_symbol_id IS NULL")).count() == 0


def test_security(spark):
    f = spark.createDataFrame([("a.py", "python", "x = 1\nr = eval(x)\neval(y)  # noqa\npassword = 'hunter22'\nassert x\n"), ("test_a.py", "python", "eval(1)"), ("b", None, "eval(1)")], "path string, language string, content string")
    assert [(r["line"], r["rule"]) for r in quality.security_scan(f).collect()] == [(2, "eval_usage"), (4, "hardcoded_password"), (5, "assert_in_production")]


def test_coverage_and_gate(spark):
    s = spark.createDataFrame([("1", "foo", "pkg.mod"), ("2", "bar", "pkg.mod"), ("3", "foo", "zzz")], "symbol_id string, name string, module string")
    called, spec = spark.createDataFrame([("foo",)], "name string"), spark.createDataFrame([("mod",)], "specifier string")
    assert {r["symbol_id"]: r["covered"] for r in quality.coverage(s, called, spec).collect()} == {"1": True, "2": False, "3": False}
    gate = spark.range(1).select(quality.quality_gate(F.lit(59.0), F.lit(90.0), F.lit(1), F.lit(0)))
    assert gate.head()[0] == ["test_coverage", "security"]


def test_metrics_smells_duplicates_hotspots(spark):
    s = spark.createDataFrame(
        [("1", "load", "function", "a.py", "def load(a, b, c, d, e, f, g, h, i) -> int", "Loads the thing from disk.", None, 1, 450, 0), ("2", "_x", "method", "a.py", "def _x(self)", None, "3", 1, 3, 4), ("3", "Big", "class", "a.py", "class Big", "", None, 1, 9, 1)],
        "symbol_id string, name string, kind string, path string, signature string, docstring string, parent_symbol_id string, line_start int, line_end int, cyclomatic int",
    )
    got = {(r["symbol_id"], r["smell"], r["severity"]) for r in quality.smells(s).collect()}
    assert got == {("1", "too_many_parameters", "medium"), ("1", "too_long", "high"), ("3", "missing_docstring", "low")}
    src = spark.createDataFrame([("1", "if a and b: pass")], "symbol_id string, source string")
    m = {r["symbol_id"]: r for r in quality.metrics(s, src, spark.createDataFrame([("load()",)], "content string")).collect()}
    assert m["1"]["has_tests"] and m["1"]["has_docs"] and m["1"]["complexity"] == 3 and not m["2"]["has_tests"] and m["2"]["complexity"] == 4
    f = spark.createDataFrame([("1", 'def a():\n  "x"  # c\n  return 1', 9), ("2", "def a():\n \"y\"\n return 1", 7), ("3", "zz", 9)], "symbol_id string, source string, line_count int")
    assert [(r["members"], r["line_count"], r["symbol_ids"]) for r in quality.duplicates(f).collect()] == [(2, 9, ["1", "2"])]
    assert spark.range(1).select(quality.hotspot_score(F.lit(5), F.lit(0))).head()[0] == 0.0


@pytest.mark.parametrize(("source", "language", "n"), [("def f(self, x, y): pass", "python", 2), ("function f(a, b, c) {}", "javascript", 3), ("void f(Map<String, Integer> m, int b) {}", "java", 2), ("def f(): pass", "python", 0), ("x = 1", "python", 0), ("def f(a, b=(1, 2), *c, d: dict[str, int] = None): 0", "python", 4)])
def test_params(source, language, n):
    assert params(source, language) == n


def test_complexity(spark):
    assert cyclomatic("def f():\n  return 1  # if", "python") == 1
    assert cyclomatic("if a and b:\n  pass\nelif c: 0", "python") == 4
    assert indent_depth("def f():\n  if a:\n    b") == 2 and indent_depth("") == 0 and brace_depth("f() { if (x) { '{' } }") == 1
    df = spark.createDataFrame([("def f(a): pass", "python"), (None, None)], "s string, g string")
    assert [tuple(r["c"]) for r in df.select(complexity("s", "g").alias("c")).collect()] == [(1, 0, 1), (1, 0, 0)]


def one(spark, c):
    return spark.range(1).select(c).head()[0]


def test_text(spark):
    assert one(spark, X.identifier_tokens(F.lit("getHTTPServer_v2.x"))) == ["get", "http", "server", "v2"]
    assert one(spark, X.keywords(F.lit("loadFile"), F.lit("Read the file.\nMore"), F.array(F.lit("@cache(1)")))) == ["cache", "file", "load", "read", "the"]
    assert one(spark, X.summary(F.lit("Reads it. Then more"), F.lit("sig"), F.lit("n"))) == "Reads it." and one(spark, X.summary(F.lit(None).cast("string"), F.lit("sig"), F.lit("n"))) == "sig"
    assert one(spark, X.byte_slice(F.lit("aé b"), F.lit(1), F.lit(2))) == "é"
    assert one(spark, X.tags(F.lit("#one x #two-b #1 a#no"))) == ["one", "two-b"]
    assert one(spark, X.urls(F.lit("see http://a.b/c, http://a.b/c"))) == ["http://a.b/c"]
    assert one(spark, X.context_lines(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(2), 1)) == "a\nb\nc"
    assert one(spark, X.reduction_percent(F.lit(25), F.lit(100))) == 75.0 and one(spark, X.directory(F.lit("x.py"))) == "."


def test_rename(spark):
    f = spark.createDataFrame([("a.py", "foo(1)\nfoobar\n# foo")], "path string, content string")
    assert [(r["line"], r["after"]) for r in graph.rename_edits(f, "foo", "baz").orderBy("line").collect()] == [(1, "baz(1)"), (3, "# baz")]
    cases = {("import foo", "a.py"): "import_path", ("class foo(X):", "a.py"): "class_name", ('x = "foo"', "a.py"): "string_literal", ("# foo", "a.py"): "comment", ("foo", "a.md"): "documentation", ("foo()", "a.py"): "code_identifier"}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "line string, path string, want string")
    assert all(r[0] == r[1] for r in df.select(graph.classify_occurrence(F.col("line"), F.col("path"), "foo"), "want").collect())


def test_resolution(spark):
    f = spark.createDataFrame([(1, 1, "src/pkg/a.py"), (2, 1, "pkg/a.py"), (3, 2, "lib/other.py")], "id long, repo_id long, path string")
    i = spark.createDataFrame([(10, 1, ["pkg/a.py", "src/pkg/a.py"]), (11, 1, ["nope"])], "id long, repo_id long, candidates array<string>")
    assert {r["id"]: r["resolved_file_id"] for r in graph.resolve_imports(i, f).collect()} == {10: 2, 11: None}
    u = spark.createDataFrame([(20, 1, "other"), (21, 2, "other")], "id long, repo_id long, specifier string")
    assert {r["id"]: r["resolved_file_id"] for r in graph.cross_repo_imports(u, f).collect()} == {20: 3}
    s = spark.createDataFrame([(1, "r::a.py::C.run#method", "run", "C.run"), (2, "r::a.py::go#function", "go", "go")], "id long, symbol_id string, name string, qualified_name string")
    c = spark.createDataFrame([("r::a.py::C.x#method", "self.run", 3), ("m", "go", 1), ("m", "zzz", 2)], "caller_symbol_id string, callee string, line int")
    assert {r["callee"]: r["target_symbol_id"] for r in graph.resolve_calls(c, s).collect()} == {"self.run": "r::a.py::C.run#method", "go": "r::a.py::go#function", "zzz": None}


def test_diffs(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, v string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "k string, v string")
    d = diff.snapshot_diff(old, new, ["k"], "v")
    assert dict(d.collect()) == {"a": "removed", "b": "changed", "c": "unchanged", "d": "added"}
    assert diff.breaking_risk(d).head()["breaking_risk"] == "high"


PY = 'import os\nfrom pkg.mod import f as g\n\nLIMIT = 3\n\nclass A(Base):\n    """Doc."""\n\n    @prop\n    def run(self, x: int) -> int:\n        return helper(x)\n\ndef top():\n    A().run(1)\n\nmain()\n'


def test_code(spark):
    rows = spark.createDataFrame([("src/a.py", "python", PY), ("b.js", "javascript", "import x from './c'\nexport class B {\n  go() {}\n}\nfunction z(a) { return 1 }"), ("bad.py", "python", "def ("), ("n", None, "x")], "path string, language string, content string")
    got = {r["symbol_id"]: r for r in code.symbols(rows, "r").collect()}
    assert set(got) == {"r::src/a.py::LIMIT#constant", "r::src/a.py::A#class", "r::src/a.py::A.run#method", "r::src/a.py::top#function", "r::b.js::B#class", "r::b.js::z#function"}
    run = got["r::src/a.py::A.run#method"]
    assert (run["param_count"], run["parent_symbol_id"], run["decorators"], PY.encode()[run["byte_offset"] :][: run["byte_length"]].decode().strip()) == (1, "r::src/a.py::A#class", ["@prop"], "def run(self, x: int) -> int:\n        return helper(x)")
    assert {(r["specifier"], tuple(r["names"])) for r in code.imports(rows).collect()} == {("os", ()), ("pkg.mod", ("f",)), ("./c", ())}
    assert {(r["caller_symbol_id"], r["callee"]) for r in code.calls(rows, "r").collect()} == {("r::src/a.py::A.run#method", "helper"), ("r::src/a.py::top#function", "A"), ("__module__", "main")}
    assert code.candidates("..x", "a/b/c.py", "python")[0] == "a/x.py"


def test_documents(spark):
    md = "intro\n# A\ntext #tag http://x.y/z\n## B\n```\n# no\n```\n## B\n# C\n"
    rows = documents.parse("d.md", md)
    assert [(r["title"], r["level"], r["slug"], r["parent_position"]) for r in rows] == [("d.md", 0, "dmd", None), ("A", 1, "dmd/a", 0), ("B", 2, "dmd/a/b", 1), ("B", 2, "dmd/a/b-2", 1), ("C", 1, "dmd/c", 0)]
    assert "".join(md.encode()[r["byte_start"] : r["byte_end"]].decode() for r in rows) == md and rows[1]["tags"] == ["tag"]
    assert [r["title"] for r in documents.parse("a.html", "<h1>T</h1><p>x</p><h2>U &amp; V</h2><script># no</script>")] == ["T", "U & V"]
    assert [(r["title"], r["level"]) for r in documents.parse("a.rst", "Top\n===\n\ntext\n\nSub\n---\n")] == [("Top", 1), ("Sub", 2)]
    assert [(r["title"], r["level"]) for r in documents.parse("a.json", '{"a": {"b": {"c": 1}}, // x\n}')] == [("a", 1), ("b", 2)]
    assert [r["title"] for r in documents.parse("a.json", '{"openapi": "3", "info": {"title": "T"}, "paths": {"/x": {"get": {"summary": "s"}}}}')] == ["T", "GET /x"]
    assert [r["title"] for r in documents.parse("a.ipynb", '{"cells": [{"cell_type": "markdown", "source": ["# N"]}]}')] == ["N"]
    assert documents.parse("a.xml", "<broken") == [] and documents.parse("a.bin", "x") == [] and documents.slugify("Ünï Çode!") == "uni-code"
    df = spark.createDataFrame([("d.md", md), ("x.zip", "")], "path string, content string")
    assert documents.sections(df).count() == 5


def test_files(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "node_modules/b.js": b"1", "id_rsa": b"k", "c.png": b"1", "empty.py": b"", "bin.txt": b"a\0b", "big.py": b"x" * 2000, "x.min.js": b"1", "d/ok.md": b"# t"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    kept, left = files.discover(files.read_tree(spark, str(tmp_path)), most_bytes=1000)
    assert {(r["path"], r["language"]) for r in kept.collect()} == {("a.py", "python"), ("d/ok.md", "markdown")}
    assert dict(left.collect()) == {"skip_dir": 1, "secret_file": 1, "binary_extension": 1, "binary_content": 1, "too_large": 1, "skip_pattern": 1}
    stored = kept.withColumn("content_hash", F.when(F.col("path") == "a.py", "old").otherwise(F.col("content_hash")))
    assert [r["path"] for r in files.changed(kept, stored).collect()] == ["a.py"]


def test_manifests(spark):
    f = spark.createDataFrame([("requirements.txt", "a==1.0\n# c\nb[x]>=2 # d\n"), ("x/package.json", '{"dependencies": {"l": "^3.1"}}'), ("go.mod", "module m\nrequire github.com/a/b v1.2.3\n"), ("Cargo.toml", '[dependencies]\ns = "1"\nt = {version = "2"}\n'), ("pyproject.toml", "broken [")], "path string, content string")
    assert {(r["manager"], r["name"], r["version"]) for r in manifests.dependencies(f).collect()} == {("pip", "a", "1.0"), ("pip", "b", "2"), ("npm", "l", "3.1"), ("go", "github.com/a/b", "v1.2.3"), ("cargo", "s", "1"), ("cargo", "t", "2")}
    assert manifests.path_aliases('{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./app/*"]}, }}') == {"@/*": ["src/app/*"]}


def test_security_rules_query_returns_all_ten_rules(spark, tmp_path):
    import re

    from loomdex.queries import QUERIES

    lines = ["eval(x)", "exec (x)", "subprocess.run(cmd, shell=True)", "pickle.loads(b)", "yaml.load(f)", "cursor.execute(f'SELECT {x}')", "password = 'hunter22'", "hashlib.md5(b)", "  assert x", "except:", "fine"]
    texts = {1: "\n".join(lines), 2: "nothing", 3: "\n".join(reversed(lines)), 4: "subprocess.run(cmd,\n  shell=True)"}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [(r["path"], r["line"], r["rule"], r["severity"]) for r in QUERIES["security_rules"](spark, f"file://{tmp_path}").collect()]
    want = {(str(i), t[: m.start() + len(m[0]) - len(m[0].lstrip())].count("\n") + 1, rule, severity) for i, t in texts.items() for rule, severity, pattern, _ in quality.SECURITY_RULES for m in re.finditer(pattern, t)}
    assert {w[2] for w in want} == {r[0] for r in quality.SECURITY_RULES} and len(quality.SECURITY_RULES) == 10
    assert sorted(got) == sorted(want)


def test_batch_search_keeps_terms_in_their_rows(spark, monkeypatch):
    """Blocks of queries and slices of documents, against scores made one by one; documents and queries aren't joined."""
    import math
    import random

    monkeypatch.setattr(retrieval, "QUERIES", 2)
    monkeypatch.setattr(retrieval, "CELLS", 40)
    monkeypatch.setattr(retrieval, "postings", None)
    r = random.Random(3)
    words = ["aa", "bb", "cc", "dd", "ee"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(7))) for _ in range(120)] + [None]
    asked = [(1, "aa BB"), (2, "cc"), (3, "zz aa-dd"), (4, "and"), (5, "ee_aa bb cc dd"), (6, "zz")]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(3)
    got = retrieval.batch_search(d, "id", {"t": 2.0}, spark.createDataFrame(asked, "query_id long, query string"), 4).collect()
    assert [(x["query_id"], x["error"]) for x in got if x["error"]] == [(4, "blank query")]
    toks = [(t or "").split() for t in texts]
    n, mean = len(toks), sum(map(len, toks)) / len(toks)
    for q, text in asked:
        terms = sorted({"aa", "bb", "cc", "dd", "ee"} & set(text.lower().replace("-", " ").replace("_", " ").split()))
        idf = {t: max(1e-6, math.log((n - k + 0.5) / (k + 0.5))) for t in terms if (k := sum(t in x for x in toks))}
        want = sorted((-sum(idf[t] * 2 * x.count(t) * 2.2 / (2 * x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in terms if t in x), i) for i, x in enumerate(toks) if set(terms) & set(x))[:4]
        own = sorted((x for x in got if x["query_id"] == q and not x["error"]), key=lambda x: x["rank"])
        assert [x["id"] for x in own] == [i for _, i in want] and all(abs(x["score"] - s) < 1e-9 for x, (s, _) in zip(own, want, strict=True))


def test_trade_within_a_nation_is_an_edge(spark):
    from loomdex import queries

    assert queries.QUERIES["dep_graph"](spark, "/root/testdata/sf0.001").filter("src = dst").count() > 0

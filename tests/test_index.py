"""The index of a small tree, whole and brought up to date; readers of blame, diffs, models and manifests; search and stems."""

import re

import pytest
from pyspark.sql import functions as F

from loomdex.functions.stemming import exact_tokens, fold, stem
from loomdex.operators import diff, graph, overview, quality, retrieval, search_index
from loomdex.plans.query import Query, enable_query_log, query_log
from loomdex.plans.scopes import present
from loomdex.sources import code, files, manifests
from loomdex.sources import index as I
from loomdex.streaming import usage

TREE = {
    "pkg/a.py": "from pkg.b import helper\n\n\nclass A(Base):\n    def run(self, x):\n        return helper(x)\n",
    "pkg/b.py": 'def helper(x):\n    """Helps."""\n    return x\n\n\ndef unused():\n    pass\n',
    "pkg/c.py": "import pkg.new\n",
    "README.md": "# Title\n\ntext\n\n## Part\n",
    "k8s.yaml": "apiVersion: v1\nkind: Secret\nmetadata:\n  name: pw\n  namespace: prod\nstringData:\n  key: hunter2\n---\napiVersion: apps/v1\nkind: Deployment\nmetadata:\n  labels:\n    a: b\n  name: web\n",
    "style.scss": "$main: red;\n@mixin big($x) {\n  a: b;\n}\n.card {\n  --pad: 1;\n}\n",
    "package.json": '{"scripts": {"build": "tsc"},\n "dependencies": {"left-pad": "^1.0"}}',
    "node_modules/x.js": "function no() {}",
    ".env": "SECRET=1",
}


def tree(spark, texts):
    return spark.createDataFrame([(p, len(t), 0.0, bytearray(t.encode())) for p, t in texts.items()], "path string, byte_size long, mtime double, content binary")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def snapshot(spark):
    return I.index(tree(spark, TREE), "r")


def test_whole_index(snapshot):
    assert {r[0] for r in rows(snapshot.files, "path")} == set(TREE) - {"node_modules/x.js", ".env"}
    assert dict(map(tuple, snapshot.left_out.collect())) == {"skip_dir": 1, "secret_file": 1}
    names = {(r["path"], r["kind"], r["qualified_name"]) for r in snapshot.symbols.collect()}
    assert {("pkg/a.py", "method", "A.run"), ("pkg/b.py", "function", "helper"), ("k8s.yaml", "type", "prod/Secret/pw"), ("k8s.yaml", "type", "Deployment/web"), ("style.scss", "constant", "$main"), ("style.scss", "function", "big"), ("package.json", "function", "scripts.build"), ("package.json", "constant", "dependencies.left-pad")} <= names
    resolved = {r["specifier"]: r["resolved_file_id"] for r in snapshot.imports.collect()}
    ids = {r["path"]: r["id"] for r in snapshot.files.collect()}
    assert resolved == {"pkg.b": ids["pkg/b.py"], "pkg.new": None}
    refs = {(r["source_symbol_id"], r["target_symbol_id"]) for r in snapshot.references.collect()}
    assert ("r::pkg/a.py::A.run#method", "r::pkg/b.py::helper#function") in refs
    assert [r["title"] for r in snapshot.sections.filter("path = 'README.md'").orderBy("position").collect()] == ["Title", "Part"]


def test_update_equals_a_new_index(spark, snapshot, tmp_path, monkeypatch):
    texts = {**TREE, "pkg/new.py": "def fresh():\n    pass\n", "pkg/b.py": "def helper(x):\n    return 2\n"}
    del texts["README.md"]
    seen = []
    real = code.symbols
    monkeypatch.setattr(code, "symbols", lambda df, repo="": (seen.append({r["path"] for r in df.collect()}), real(df, repo))[1])
    folder = f"file://{tmp_path}/v1"
    snapshot.write(folder)
    updated, whole = I.index(tree(spark, texts), "r", before=I.Snapshot.read(spark, folder)), I.index(tree(spark, texts), "r")
    assert seen[0] == {"pkg/new.py", "pkg/b.py"}
    for name, columns in (("files", ("path", "content_hash", "id")), ("symbols", ("symbol_id", "content_hash")), ("sections", ("path", "title")), ("imports", ("specifier", "resolved_file_id")), ("calls", ("caller_symbol_id", "callee")), ("references", ("source_symbol_id", "target_symbol_id"))):
        assert rows(getattr(updated, name), *columns) == rows(getattr(whole, name), *columns), name


def test_unchanged_files_are_not_read(spark, snapshot, tmp_path):
    """What has its size and time is taken for what it was; without trust in times every content counts."""
    folder = f"file://{tmp_path}/v1"
    snapshot.write(folder)
    other = {**TREE, "pkg/b.py": TREE["pkg/b.py"].replace("helper", "HELPER")}  # the same size
    hashes = lambda s: set(rows(s.files, "path", "content_hash"))
    blind = I.index(tree(spark, other), "r", before=I.Snapshot.read(spark, folder))
    assert hashes(blind) == hashes(snapshot) and rows(blind.blobs, "content_hash") == rows(snapshot.blobs, "content_hash")
    assert rows(blind.references, "source_symbol_id", "target_symbol_id") == rows(snapshot.references, "source_symbol_id", "target_symbol_id")
    careful = I.index(tree(spark, other), "r", before=I.Snapshot.read(spark, folder), trust_times=False)
    assert hashes(careful) == hashes(I.index(tree(spark, other), "r")) != hashes(snapshot)
    some = I.index(tree(spark, other), "r", most_files=2)
    assert some.files.count() == some.blobs.count() == 2


def test_secrets_are_stripped():
    out = code.without_secrets(TREE["k8s.yaml"])
    assert "hunter2" not in out and "key: ***" in out and "name: web" in out


def test_diff_hunks(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a\n-b\n+c\n+d\n@@ -10 +11,0 @@\n-e\ndiff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -0,0 +1 @@\n+z"
    df = spark.createDataFrame(list(enumerate(text.split("\n"))), "n long, value string")
    assert [tuple(r) for r in files.diff_hunks(df).collect()] == [("x.py", 1, 3, 1, 4, 2, 1), ("x.py", 10, 1, 11, 0, 0, 1), ("y.py", 0, 0, 1, 1, 1, 0)]


def test_log_pages(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\n".join(f"line {i}" for i in range(1, 201)) + "\n")
    page = lambda **o: [tuple(r) for r in files.log_tail(spark, f"file://{tmp_path}/log.txt", **o).collect()]
    assert page(lines=2) == [(199, "line 199"), (200, "line 200")]
    assert page(lines=2, from_start=True, offset=5) == [(6, "line 6"), (7, "line 7")]


def test_models_and_aliases(spark):
    text = "models:\n  - name: orders\n    description: rows\n    columns:\n      - name: id\n        description: The key\n        tests:\n          - unique\n      - name: total\n  - name: users\n"
    df = spark.createDataFrame([("m/schema.yml", text), ("m/other.yml", text)], "path string, content string")
    assert [tuple(r) for r in manifests.dbt_columns(df).collect()] == [("orders", "rows", {"id": "The key", "total": ""}), ("users", "", {})]
    base = {"conf/base.json": '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"b/*": ["lib/*"], "@/*": ["old/*"]}}}'}
    own = '{ /* c */ "extends": "./conf/base", "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*"],}} // e\n}'
    assert manifests.path_aliases(own, base) == {"b/*": ["conf/lib/*"], "@/*": ["src/*"]}


def test_index_with_stems(spark, tmp_path):
    d = spark.createDataFrame([(1, "Connected connections"), (2, "a plain café"), (3, None)], "id long, t string")
    index = search_index.build(d, "id", ["t"], f"file://{tmp_path}/i", 4, stem_words=True)
    assert [r["key"] for r in search_index.search(index, "connecting").collect()] == [1]
    assert [r["key"] for r in search_index.search(index, "cafe plain", all_terms=True).collect()] == [2]
    assert search_index.search(index, "connecting cafe", all_terms=True).count() == 0
    assert search_index.search(index, "!?").count() == 0 and search_index.search(index, "absent").count() == 0
    with pytest.raises(ValueError):
        search_index.search_service(index, " ", d.withColumnRenamed("id", "key"), {"t": 1.0})


def test_index_equals_the_scan(spark, tmp_path):
    import random

    r = random.Random(2)
    d = spark.createDataFrame([(i, " ".join(r.choice(["apple", "pear", "fig", "the", "x"]) for _ in range(r.randint(0, 30))), r.choice(["fig", "en"])) for i in range(80)], "id long, t string, u string")
    weights = {"t": 1.0, "u": 3.0}
    index = search_index.build(d, "id", ["t", "u"], f"file://{tmp_path}/i")
    want = [(x["id"], round(x["score"], 9)) for x in retrieval.bm25(d, "id", "fig pear", weights).collect()]
    assert [(x["key"], round(x["score"], 9)) for x in search_index.search(index, "fig pear", weights).collect()] == want
    plan = search_index.search(index, "fig", weights)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)


@pytest.mark.parametrize(("word", "root"), [("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("ponies", "poni"), ("agreed", "agre"), ("adoption", "adopt"), ("controlling", "control"), ("Électricité", "electricit"), ("is", "is"), ("größe", "große")])
def test_stems(word, root):
    assert stem(fold(word)) == root


def test_session_and_queue(spark):
    done = [(i, f"k{i}", "done", 0, i, 100 + i) for i in range(60)]
    jobs = spark.createDataFrame([(100, "a", "queued", 0, 5, None), (101, "a", "running", 0, 6, None), (102, "b", "queued", 0, 7, None), *done], "id long, key string, status string, priority int, queued_at long, ended_at long")
    out = usage.queued(jobs).collect()
    assert {r["id"] for r in out if r["status"] != "done"} == {101, 102} and {r["id"] for r in out if r["status"] == "done"} == set(range(10, 60))


def test_embed_missing_rows(spark):
    d = spark.createDataFrame([(1, "one"), (2, "two"), (3, " ")], "id long, t string")
    have = spark.createDataFrame([(2,)], "id long")
    todo = overview.to_embed(d, have, "id", F.col("t"))
    assert [(r["id"], r["embedding"]) for r in overview.embed(todo, "id", lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()] == [(1, [3.0, 1.0])]


def test_query_log_and_presenters(spark):
    enable_query_log()
    q = Query(spark.createDataFrame([("f", "a", "function", None, 3)], "symbol_id string, name string, kind string, signature string, line_start int")).where(kind="function")
    assert [tuple(r) for r in present(q.df(), "symbol", "sibling").collect()] == [("f", "a", "function", "", 3)]
    assert len(query_log(stop=True)) == 1 and query_log() == []
    assert "Filter" in q.to_plan()
    with pytest.raises(ValueError):
        present(q.df(), "symbol", "none")


def test_containing(spark):
    whole = ["pkg.core.io", "ab", "", "x"]
    part = ["core", "a", "", "io", "pkg.core.io.more", "b"]
    got = {tuple(r) for r in diff.containing(spark.createDataFrame([(w,) for w in whole], "whole string"), spark.createDataFrame([(p,) for p in part], "part string")).collect()}
    assert got == {(w, p) for w in whole for p in part if p in w}


def test_containing_meets_by_rare_pieces_and_wildcards(spark):
    whole = [f"pkg.m{i}" for i in range(60)] + ["pkg.my_util", "pkg.myXutil", "a\\b", "pk%", "é_x"]
    part = ["pkg.m7", "pkg", "my_util", "_", "g_m", "k%", "\\", "é", "____", "nowhere", ""]
    frames = spark.createDataFrame([(w,) for w in whole], "whole string"), spark.createDataFrame([(p,) for p in part], "part string")
    assert {tuple(r) for r in diff.containing(*frames).collect()} == {(w, p) for w in whole for p in part if p in w}
    pattern = {p: re.compile("(?s)" + "".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in p)) for p in part}
    assert {tuple(r) for r in diff.containing(*frames, wild=True).collect()} == {(w, p) for w in whole for p in part if pattern[p].search(w)}


def test_one_and_many_targets_agree_on_stems(spark):
    f = spark.createDataFrame([(1, 1, "a/my_util.py", "run()"), (2, 1, "b/x.py", "run"), (3, 1, "b/y.py", ""), (4, 1, "ÄB.py", ""), (5, 1, "z.py", "")], "id long, repo_id long, path string, content string")
    i = spark.createDataFrame([(2, "pkg.myXutil", None), (3, "PKG.MY_UTIL", None), (5, "äb", None), (2, "ÄB.c", None)], "file_id long, specifier string, resolved_file_id long")
    for target, want in ((1, {2, 3}), (4, {2})):
        assert {r["id"] for r in graph.blast_radius(f, i, target, "run").collect()} == want
        assert {r["id"] for r in graph.blast_radii(f, i, spark.createDataFrame([(target, "run")], "target long, name string")).collect()} == want


def test_references_by_names_words_and_text(spark):
    files = spark.createDataFrame([(1, "a.py", "h1"), (2, "b.py", "h2"), (3, "c.py", None)], "id long, path string, content_hash string")
    contents = spark.createDataFrame([("h1", "use go and a.b, café"), ("h2", "go2")], "content_hash string, content string")
    symbols = spark.createDataFrame([(1, 2, "b::go", "go"), (2, 2, "b::go2", "go2"), (3, 2, "b::a.b", "a.b"), (4, 2, "b::café", "café"), (5, 2, "b::x", None)], "id long, file_id long, symbol_id string, name string")
    imports = spark.createDataFrame([(1, "b", None, 2), (3, "b3", ["go2"], 2), (3, "b4", None, 2), (1, "n", None, None)], "file_id long, specifier string, names array<string>, resolved_file_id long")
    got = {tuple(r) for r in graph.reference_graph(files, symbols, imports, contents).collect()}
    assert got == {("__file__:a.py", "b::go", "b"), ("__file__:a.py", "b::a.b", "b"), ("__file__:a.py", "b::café", "b"), ("__file__:c.py", "b::go2", "b3")}


def test_similar_memories_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(3)
    data = [(i, i % 3, [float(x) for x in r.normal(size=4)]) for i in range(120)]
    df = spark.createDataFrame([*data, (500, 0, None), (501, 7, [1.0, 0.0, 0.0, 0.0])], "id long, repo_id int, embedding array<double>")
    got = {x["id"]: (x["updates"], x["similarity"]) for x in retrieval.save_memories(df.filter("id % 4 <> 0"), df.filter("id % 4 = 0"), 0.5, block=7).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in data}
    for i, repo, _ in data:
        if i % 4 == 0:
            best = max(((round(float(unit[i] @ unit[j]), 4), -j) for j, k, _ in data if k == repo and j % 4), default=(0, 0))
            assert got[i] == ((-best[1], best[0]) if best[0] > 0.5 else (None, None))
    assert got[500] == (None, None)


def test_findings_stand_on_their_lines(spark):
    text = "x = 1\nassert x\n\nsubprocess.run('a',\n  shell=True)\nyaml.load(f)  # noqa\neval (x)\ntry:\n  pass\nexcept:\n  pass\ncursor.execute(f\"select {x}\")\npassword = 'abcdef'"
    df = spark.createDataFrame([("src/a.py", "python", text), ("tests/a.py", "python", text), ("src/b.py", "python", "ok ￿\n")], "path string, language string, content string")
    got = {(r["rule"], r["line"]) for r in quality.security_scan(df).collect()}
    assert got == {("assert_in_production", 2), ("shell_injection", 4), ("eval_usage", 7), ("broad_except", 10), ("sql_concatenation", 12), ("hardcoded_password", 13)}


def test_exact_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    count = exact_tokens(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    df = spark.createDataFrame([("hello world",), (None,)], "t string")
    assert [r[0] for r in df.select(count("t")).collect()] == [2, 0]


def test_unknown_targets_have_an_error(spark):
    f = spark.createDataFrame([(1, 1, "a/x.py", "run()"), (2, 2, "b/y.py", "import x; run()"), (3, 1, "c/z.py", "")], "id long, repo_id long, path string, content string")
    i = spark.createDataFrame([(2, "a.x", 1), (3, "b.y", 2)], "file_id long, specifier string, resolved_file_id long")
    t = spark.createDataFrame([(1, "run"), (9, "run")], "target long, name string")
    got = {(r["target"], r["id"]): (r["depth"], r["kind"], r["cross_repo"], r["error"]) for r in graph.blast_radii(f, i, t).collect()}
    assert got == {(1, 2): (1, "confirmed", True, None), (1, 3): (2, "potential", False, None), (9, None): (None, None, None, "unknown target")}


def test_html_sections_against_the_pages(spark):
    """The query over all pages of a small table: each page's own heading, found by hand, and ranges that join."""
    import html
    import os

    from loomdex.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    got = {}
    for r in QUERIES["sections_html"](spark, sf).orderBy("path", "position").collect():
        got.setdefault(r["path"], []).append(r)
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        heads = [(int(n), re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", t))).strip()) for n, t in re.findall(r"(?s)<h([1-6])[^>]*>(.*?)</h\1>", re.sub(r"<!--.*?-->", "", p["html"]))]
        rows = got[f"page/{p['page_id']}.html"]
        own = [r for r in rows if r["level"] > 0]
        assert [r["level"] for r in own] == [n for n, _ in heads]
        assert [re.sub(r"\W+", "", r["title"]) for r in own] == [re.sub(r"\W+", "", t) for _, t in heads]
        assert all(a["byte_end"] == b["byte_start"] for a, b in zip(rows, rows[1:], strict=False))


def test_results_are_cached_for_a_while(spark):
    from loomdex.plans.cache import ResultCache

    now, made = [0.0], []

    def make(n):
        return lambda: (made.append(n), spark.range(n))[1]

    cache = ResultCache(2, 30, lambda: now[0])
    assert cache.get("a", make(3), ["files"]).count() == cache.get("a", make(4)).count() == 3 and (cache.hits, cache.misses) == (1, 1)
    cache.get("b", make(5))
    cache.get("c", make(6))  # a goes
    assert set(cache.held) == {"b", "c"}
    now[0] = 31.0
    assert cache.get("b", make(7), ["files"]).count() == 7
    cache.invalidate("files")
    assert set(cache.held) == {"c"}
    cache.invalidate()
    assert not cache.held and made == [3, 5, 6, 7]


def test_migrations_without_a_way_back(spark):
    from loomdex.schema import Migration, drop_table, migrate, rename_table

    t = {"a": spark.range(2)}
    steps = [Migration(2, "gone", drop_table("b")), Migration(1, "moved", rename_table("a", "b"))]
    assert set(migrate(t, steps, 0, 1)[0]) == {"b"} and migrate(t, steps, 0) == ({}, 2)
    with pytest.raises(ValueError):
        migrate(t, steps, 2, 0)

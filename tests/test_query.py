"""Builder semantics on a small code index."""

import pytest
from pyspark.sql import functions as F

from loomdex.operators import mutate
from loomdex.operators.predicates import Conditions, glob_pattern
from loomdex.plans.query import Agg, Query, Relation


@pytest.fixture(scope="module")
def index(spark):
    repos = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "id long, name string")
    files = spark.createDataFrame([(1, 1, "main.py", "python"), (2, 1, "util.py", "python"), (3, 2, "lib.go", "go")], "id long, repo_id long, path string, language string")
    symbols = spark.createDataFrame(
        [("sym-1", 1, "foo", "function"), ("sym-2", 1, "bar", "function"), ("sym-3", 1, "MyClass", "class"), ("sym-4", 2, "helper", "function"), ("sym-5", 3, "GoFunc", "function"), ("sym-6", None, None, None)],
        "symbol_id string, file_id long, name string, kind string",
    )
    return repos, files, symbols


def ids(df):
    return sorted(r[0] for r in df.select("symbol_id").collect())


def test_and_or_precedence(index):
    s = index[2]
    c = Conditions().where(kind="class").or_where(name="foo").where(kind="function")
    assert ids(c.apply(s)) == ["sym-1", "sym-3"]
    assert ids(Conditions().or_where(name="foo").where(kind="class").apply(s)) == []


def test_nulls(index):
    s = index[2]
    assert ids(Conditions().where("name", None).apply(s)) == ["sym-6"]
    assert ids(Conditions().where("name", "!=", "foo").apply(s)) == ["sym-2", "sym-3", "sym-4", "sym-5"]
    assert ids(Conditions().where_not_like("name", "%O%").apply(s)) == ["sym-2", "sym-3", "sym-4"]
    assert ids(Conditions().where_none(["name", "kind"], "foo").apply(s)) == ["sym-2", "sym-3", "sym-4", "sym-5"]


def test_empty_lists(index):
    s = index[2]
    assert ids(Conditions().where_in("name", []).apply(s)) == []
    assert len(ids(Conditions().where_not_in("name", []).apply(s))) == 6


def test_unknown_operator():
    with pytest.raises(ValueError):
        Conditions().where("a", "~~", 1)


def test_bad_name():
    with pytest.raises(ValueError):
        Conditions().where("a; drop table x", 1)


@pytest.mark.parametrize(("glob", "text", "hit"), [("*.py", "a/b.py", True), ("?.py", "ab.py", False), ("[a-c]*", "bx", True), ("[^a]*", "ax", False), ("A*", "abc", False), ("a.c", "abc", False)])
def test_glob(glob, text, hit):
    import re

    assert bool(re.search(glob_pattern(glob), text)) == hit


def test_duplicate_join_counts_once(index):
    repos, files, symbols = index
    on = F.col("file_id") == F.col("files.id")
    q = Query(symbols).join("files", files, on).join("files", files, on).where(language="python")
    assert ids(q.select("symbol_id").df()) == ["sym-1", "sym-2", "sym-3", "sym-4"]


def test_not_in_subquery_with_null(spark, index):
    s = index[2]
    names = spark.createDataFrame([("foo",), (None,)], "x string")
    assert Query(s).where_not_in_subquery("name", names).count() == 0
    assert ids(Query(s).where_not_in_subquery("name", names.filter("x IS NOT NULL")).df()) == ["sym-2", "sym-3", "sym-4", "sym-5"]


def test_relations(spark, index):
    repos, files, symbols = index
    q = Query(files, relations={"symbols": Relation("has_many", symbols, "id", "file_id"), "repo": Relation("belongs_to", repos, "repo_id", "id")})
    assert {r["id"]: r["symbols_count"] for r in q.with_count("symbols").df().collect()} == {1: 3, 2: 1, 3: 1}
    rows = {r["id"]: r for r in q.with_("symbols", "repo").df().collect()}
    assert [s["symbol_id"] for s in rows[1]["symbols"]] == ["sym-1", "sym-2", "sym-3"] and rows[3]["repo"]["name"] == "beta"
    r = Query(repos, relations={"files": Relation("has_many", files, "id", "repo_id")})
    assert [x["id"] for x in r.doesnt_have("files").df().collect()] == [3]
    assert r.with_("files").find(3)["files"] == []
    with pytest.raises(ValueError):
        q.has("nothing")


def test_many_to_many(spark, index):
    repos = index[0]
    spaces = spark.createDataFrame([(1, "w"), (2, "v")], "id long, name string")
    pivot = spark.createDataFrame([(1, 1), (1, 2)], "workspace_id long, repo_id long")
    q = Query(spaces, relations={"repos": Relation("belongs_to_many", repos, "id", "id", pivot, "workspace_id", "repo_id")})
    assert {r["id"]: r["repos_count"] for r in q.with_count("repos").df().collect()} == {1: 2, 2: 0}
    assert [r["id"] for r in q.has("repos").df().collect()] == [1]


def test_aggregates_of_nothing(index):
    q = Query(index[1]).where(path="none")
    assert q.aggregates(n=Agg.count(), s=Agg.sum("id"), m=Agg.max("id")).head().asDict() == {"n": 0, "s": 0, "m": 0}
    assert not q.exists() and q.first() is None
    with pytest.raises(LookupError):
        q.find_or_fail(99)


def test_pages_and_chunks(index):
    q = Query(index[2]).order_by("symbol_id")
    page = q.paginate(2, 4)
    assert (page.total, page.pages, [r[0] for r in page.data.collect()]) == (6, 2, ["sym-5", "sym-6"])
    assert Query(index[2]).where_in("name", []).paginate(1, 4).pages == 1
    assert [len(c) for c in q.chunk(4)] == [4, 2]


def test_scopes_and_when(index):
    q = Query(index[2], scopes={"functions": lambda q: q.where(kind="function"), "named": lambda q, n: q.where(name=n)})
    assert ids(q.functions().named("bar").df()) == ["sym-2"]
    assert q.when(False, lambda x: x.functions()).count() == 6


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, None, 3)], "id long, name string, n long")
    inc = spark.createDataFrame([(2, "B", 20, 1), (4, "d", 40, 1), (4, "D", 41, 2)], "id long, name string, n long, pos int")
    got = {r["id"]: (r["name"], r["n"]) for r in mutate.bulk_upsert(base, inc, ["id"], "pos", ["name"]).collect()}
    assert got == {1: ("a", 1), 2: ("B", None), 3: (None, 3), 4: ("D", 41)}
    assert sorted(r["id"] for r in mutate.delete(base, F.col("n") < 2).collect()) == [2, 3]
    changes = spark.createDataFrame([(1, None)], "id long, name string")
    assert {r["id"]: r["name"] for r in mutate.bulk_update(base, changes, "id").collect()} == {1: None, 2: "b", 3: None}
    usage = spark.createDataFrame([(1, "2024-01-01", 1, 50)], "repo_id long, date string, calls long, tokens long")
    more = spark.createDataFrame([(1, "2024-01-01", 2, 30)], usage.schema)
    assert mutate.add_counters(usage, more, ["repo_id", "date"]).head()[2:] == (3, 80)


def test_like_folds_ascii_alone(spark):
    from loomdex.operators.predicates import Conditions

    df = spark.createDataFrame([("Émile",), ("émile",), ("a\\b",), ("A_B",), ("axb",), (None,)], "s string")
    found = lambda p: {r["s"] for r in Conditions().where_like("s", p).apply(df).collect()}
    assert found("éMILE") == {"émile"} and found("ÉmiLE") == {"Émile"}
    assert found("a_b") == {"a\\b", "A_B", "axb"} and found("A\\B") == {"a\\b"}
    assert {r["s"] for r in Conditions().where_not_like("s", "a%").apply(df).collect()} == {"Émile", "émile"}

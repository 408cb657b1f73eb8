"""A tree that changes, and the index that a stream keeps like it."""

import time

from loomdex.operators import segments
from loomdex.streaming import tree_changes


def put(folder, files):
    for path, text in files.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)


def test_added_changed_and_deleted_files_come_once(tmp_path):
    tree, kept = tmp_path / "tree", tmp_path / "listings"
    tree.mkdir()
    reader = tree_changes.TreeReader({"path": f"file://{tree}", "listings": f"file://{kept}", "endings": ".py,.md"})
    assert reader.latestOffset() == reader.initialOffset() == {"listing": 0}
    put(tree, {"a.py": "one", "b/c.md": "two", "x.bin": "no"})
    first = reader.latestOffset()
    assert first == reader.latestOffset() == {"listing": 1}
    put(tree, {"a.py": "longer", "d.py": "three"})
    (tree / "b/c.md").unlink()
    second = reader.latestOffset()
    rows = lambda a, b: sorted((r[0], r[1], r[4]) for p in reader.partitions(a, b) for r in reader.read(p))
    assert rows(first, second) == [("a.py", "changed", b"longer"), ("b/c.md", "deleted", None), ("d.py", "added", b"three")]
    assert rows(reader.initialOffset(), second) == [("a.py", "added", b"longer"), ("d.py", "added", b"three")]
    assert rows(second, second) == []
    (tree / "d.py").unlink()  # gone before a task reads it
    assert rows(first, second) == [("a.py", "changed", b"longer"), ("b/c.md", "deleted", None)]
    reader.commit(second)
    assert [p.name for p in kept.iterdir()] == ["2.json"]
    third = reader.latestOffset()
    assert third == {"listing": 3} and rows(second, third) == [("d.py", "deleted", None)]


def test_an_index_is_kept_like_a_tree(spark, tmp_path):
    tree = tmp_path / "tree"
    put(tree, {f"src/m{i}.py": f"def run{i} alpha" + " beta" * (i % 3) for i in range(12)})
    index = segments.create(spark, f"file://{tmp_path}/index", ["content"], key="string", stripe=4, buckets=2)

    def settled(change):
        query = tree_changes.keep_like(spark, f"file://{tree}", index, "content", f"file://{tmp_path}/stream", ".py", "200 milliseconds")
        try:
            for step in change:
                step()
                time.sleep(0.5)
                query.processAllAvailable()
            assert query.exception() is None
        finally:
            query.stop()

    def same():
        files = [(str(p.relative_to(tree)), p.read_text()) for p in tree.rglob("*.py")]
        fresh = segments.build(spark.createDataFrame(files, "path string, content string"), "path", ["content"], f"file://{tmp_path}/fresh-{time.time_ns()}", stripe=4, buckets=2)
        for query in ("alpha", "beta gamma", "run3"):
            want = [(r["key"], round(r["score"], 9)) for r in fresh.search(query).collect()]
            assert [(r["key"], round(r["score"], 9)) for r in index.search(query).collect()] == want

    settled([lambda: None])
    same()
    # the second query goes on from the first one's checkpoint, and finds what changed while none ran
    (tree / "src/m1.py").unlink()
    put(tree, {"src/m2.py": "gamma gamma", "new/n.py": "beta run3", "new/n.txt": "beta"})
    settled([lambda: None, lambda: (tree / "src/m2.py").unlink(), lambda: put(tree, {"src/m4.py": "alpha", "src/m1.py": "gamma"})])
    same()
    assert len(index.state()["segments"]) < 5

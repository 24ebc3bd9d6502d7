"""Trees whose folders are listed by tasks, and tracker items as a stream."""

import json
import os

import pytest
from pyarrow import fs

from gleaner.operators import items
from gleaner.sources import files, tracker, tracker_stream, tree
from gleaner.sources.store import Store
from gleaner.streaming.ingest import ingest_items_stream


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "repo"
    for folder in ("pkg/sub", "node_modules/deep", ".github", "pkg/__pycache__", "_docs", "many"):
        (root / folder).mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text('"""Package."""\n')
    (root / "pkg" / "_private.py").write_text("def f():\n    return 1\n")
    (root / "pkg" / "sub" / "a.b.txt").write_text("text")
    (root / "pkg" / "__pycache__" / "c.py").write_text("x = 1")
    (root / "node_modules" / "deep" / "x.md").write_text("skipped")
    (root / ".github" / "HELP.md").write_text("help")
    (root / "_docs" / "index.rst").write_text("docs")
    (root / ".md").write_text("a name, no suffix")
    (root / "image.png").write_bytes(b"\0")
    (root / "empty.txt").write_bytes(b"")
    for i in range(30):
        (root / "many" / f"d{i}").mkdir()
        (root / "many" / f"d{i}" / f"é {i}.txt").write_text(f"number {i}")
    os.symlink(root, root / "pkg" / "loop")
    os.symlink(root / "pkg" / "_private.py", root / "pkg" / "linked.py")
    os.symlink(root / "nowhere", root / "pkg" / "broken.py")
    return root


WANTED = {
    "pkg/__init__.py", "pkg/_private.py", "pkg/linked.py", "pkg/sub/a.b.txt", ".github/HELP.md", "_docs/index.rst", "empty.txt",
    *(f"many/d{i}/é {i}.txt" for i in range(30)),
}


def test_names_with_dots_and_underscores_are_read(spark, root):
    found = files.read_tree(spark, str(root)).collect()
    assert {r["source_path"] for r in found} == WANTED and len(found) == len(WANTED)
    texts = {r["source_path"]: bytes(r["content"]).decode() for r in found}
    assert texts["many/d7/é 7.txt"] == "number 7" and texts["empty.txt"] == ""
    units = {(r["source_path"], r["kind"]) for r in files.code_units(files.read_tree(spark, f"file:{root}").where("role = 'code'")).collect()}
    assert ("pkg/__init__.py", "module_header") in units and ("pkg/_private.py", "function") in units


@pytest.mark.parametrize("entries", [1, 7])
def test_folders_are_dealt_out_anew_and_listed_once(spark, root, entries):
    one = sorted(r["path"] for r in tree.list_files(spark, str(root), files.SKIP_DIRS).collect())
    many = sorted(r["path"] for r in tree.list_files(spark, str(root), files.SKIP_DIRS, entries).collect())
    assert one == many == sorted(set(one)) and "image.png" in one


def test_skipped_folders_are_never_opened(root):
    opened = []

    class Watched:
        def get_file_info(self, selector):
            opened.append(selector.base_dir)
            return fs.LocalFileSystem().get_file_info(selector)

    os.unlink(root / "pkg" / "loop")  # only local systems are asked about links
    found = dict(tree.walk(Watched(), str(root), "", files.SKIP_DIRS))
    assert WANTED <= found.keys() and len(opened) == len(set(opened))
    assert not any(part in files.SKIP_DIRS for path in opened for part in path.split("/"))


def test_a_tree_without_files_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "none" / "dist").mkdir(parents=True)
    (tmp_path / "none" / "dist" / "x.md").write_text("skipped")
    found = files.read_tree(spark, str(tmp_path / "none"))
    assert found.columns == ["source_path", "role", "content"] and found.count() == 0


def item(number, updated, **fields):
    return {"number": number, "title": f"Title {number}", "state": "closed", "updated_at": updated, "body": "words " * 30, **fields}


def paged(path):
    """Fetch from a file, which the test rewrites: newest first, a hundred a page."""

    def fetch(repo, page, size):
        with open(path) as f:
            found = sorted(json.load(f), key=lambda i: i["updated_at"], reverse=True)
        return tracker.Page(items=[json.dumps(i) for i in found[(page - 1) * size : page * size]])

    return fetch


def test_ranges_hold_each_update_once(tmp_path):
    state = tmp_path / "items.json"
    state.write_text(json.dumps([item(i, f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z") for i in range(250)]))
    waits = []
    read = lambda after, upto: [json.loads(t)["number"] for t in tracker_stream.updates(paged(state), "o/r", after, upto, waits.append)]
    assert read("", "2024-01-01T00:01:00Z") == list(range(60, -1, -1))
    assert read("2024-01-01T00:01:00Z", "2024-01-01T00:04:09Z") == list(range(249, 60, -1))
    assert tracker_stream.newest(paged(state), "o/r", "2024-01-01T00:00:30Z") == "2024-01-01T00:00:30Z"
    assert tracker_stream.newest(paged(state), "o/r", "2023") == ""
    # A page that shifts shows an item twice.
    twice = lambda repo, page, size: tracker.Page(items=[json.dumps(item(5, "2024"))] if page < 3 else [])
    assert len(list(tracker_stream.updates(twice, "o/r", "", "2025", waits.append))) == 1


def test_a_stream_that_is_stopped_gives_each_update_once(spark, tmp_path):
    state = tmp_path / "items.json"
    first = [item(i, f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z") for i in range(130)]
    state.write_text(json.dumps(first))
    spark.dataSource.register(tracker_stream.tracker_stream(paged(str(state)), "updates_test", pause=lambda s: None))
    raw = lambda: spark.readStream.format("updates_test").option("repo", "o/r").load().selectExpr("json AS value")

    def run():
        query = raw().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True)
        query.start(str(tmp_path / "out")).awaitTermination(60)
        parsed = items.parse_items(spark.read.parquet(str(tmp_path / "out")).withColumnRenamed("value", "json"))
        return sorted((r["number"], r["title"]) for r in parsed.select("number", "title").collect())

    assert run() == [(i, f"Title {i}") for i in range(130)]
    assert run() == [(i, f"Title {i}") for i in range(130)]
    changed = [*first[1:], item(0, "2024-02-01T00:00:00Z", title="changed"), item(500, "2024-02-01T00:00:00Z")]
    state.write_text(json.dumps(changed))
    assert run() == sorted([*((i, f"Title {i}") for i in range(130)), (0, "changed"), (500, "Title 500")])
    store = Store(spark, str(tmp_path / "store"))
    ingest_items_stream(raw(), store, "r", str(tmp_path / "ingest")).awaitTermination(120)
    assert store.count() == 131

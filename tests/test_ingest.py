import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import batching, chunking, items, sampling
from gleaner.sources import files, tracker


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_window_counts(spark):
    counts = {0: 0, 1: 1, 425: 1, 499: 1, 500: 2, 501: 2, 925: 3, 926: 3, 1349: 3, 1350: 4}
    df = spark.createDataFrame([(n, words(n)) for n in counts], "n int, t string")
    got = {r["n"]: r["k"] for r in df.select("n", F.size(chunking.windows(F.col("t"), F.lit(1))).alias("k")).collect()}
    assert got == counts


def test_window_texts_and_lines(spark):
    text = "\n".join(f"w{i}" for i in range(1000)) + "\n"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(chunking.windows(F.col("t"), F.lit(1))).first()[0]
    tokens = [("" if i == 0 else "\n") + f"w{i}" for i in range(1000)] + ["\n"]
    for i, w in enumerate(got):
        part = tokens[i * 425 : i * 425 + 500]
        start = 1 + "".join(tokens[: i * 425]).count("\n")
        assert (w["text"], w["start_line"], w["end_line"]) == ("".join(part), start, start + "".join(part).count("\n"))


def test_piece_counts(spark):
    counts = {1500: 1, 1501: 2, 2800: 2, 2801: 3}
    df = spark.createDataFrame([(n, words(n)) for n in counts], "n int, t string")
    got = {r["n"]: r["k"] for r in df.select("n", F.size(chunking.pieces(F.col("t"))).alias("k")).collect()}
    assert got == counts


SOURCE = '''import os, sys
from a import (b,
    c)
"""A docstring that ends the header, with enough words in it to be kept by the rule on size, surely so"""
import late

@register(x=1)
class Pool(Base, metaclass=Meta):
    """Slots of a pool, kept for all the tasks that want to run at the same time as others
    do."""
    size = 3

    @cached
    def take(self, n):
        "Take n slots; waits until there are enough of them and then marks them as taken by the caller"
        return [n for _ in range(n)]

    async def give(self): pass

    class Inner:
        def hidden(self): pass

async def run(pool, a, b, c, d, e, f, g, h, i, j, k, l, m, n, o, p, q, r, s, t, u, v, w):
    return await pool.take(1)

if True:
    def not_top(): pass
'''


def units(spark, *contents):
    df = spark.createDataFrame([(f"m{i}.py", bytearray(c)) for i, c in enumerate(contents)], "source_path string, content binary")
    return files.code_units(df)


def test_code_units(spark):
    got = [
        (r["kind"], r["symbol"], r["start_line"], r["end_line"])
        for r in units(spark, SOURCE.encode()).orderBy("ord").collect()
    ]
    assert got == [
        ("module_header", "<module>", 1, 4),
        ("class_header", "Pool", 7, 21),
        ("method", "Pool.take", 13, 16),
        ("method", "Pool.give", 18, 18),
        ("function", "run", 23, 24),
    ]
    texts = {r["symbol"]: r["text"] for r in units(spark, SOURCE.encode()).collect()}
    assert texts["<module>"].startswith("import os, sys\nfrom a import (b,\n    c)\n\"\"\"A doc") and "late" not in texts["<module>"]
    assert texts["Pool"].startswith('class Pool(Base, metaclass=Meta):\n    """Slots') and texts["Pool"].endswith('\n        do."""')
    assert "size" not in texts["Pool"]
    assert texts["Pool.take"].startswith("@cached\n    def take(self, n):") and texts["Pool.take"].endswith("range(n)]")


def test_code_units_of_odd_files(spark):
    got = units(spark, b"", b"  \n", b"def broken(:\n", b"x = 1\n", "def f():\n    return 'ü'  # é".encode()).collect()
    assert [(r["source_path"], r["kind"]) for r in got] == [("m2.py", "unparsed"), ("m4.py", "function")]
    assert got[1]["text"] == "def f():\n    return 'ü'"


def test_unit_chunks_split_drop_and_share_ids(spark):
    rows = [("a.py", "function", "f", words(3000), 1, 9), ("a.py", "method", "C.g", words(19), 1, 2), ("a.py", "class_header", "C", words(2000), 3, 4)]
    df = spark.createDataFrame(rows, "source_path string, kind string, symbol string, text string, start_line int, end_line int")
    chunks = chunking.unit_chunks(df)
    assert sorted((r["symbol"], r["piece"], r["chunk_id"]) for r in chunks.collect()) == [
        ("C", 0, "a.py:3-4:class_header:C"), ("f", 0, "a.py:1-9:function:f"), ("f", 1, "a.py:1-9:function:f"), ("f", 2, "a.py:1-9:function:f"),
    ]
    assert chunking.keep_first(chunks, [F.col("piece")]).count() == 2
    numbered = chunking.unit_chunks(df, keep_pieces=True).where("symbol = 'f'").orderBy("piece").collect()
    assert [r["chunk_id"] for r in numbered] == ["a.py:1-9:function:f", "a.py:1-9:function:f:p1", "a.py:1-9:function:f:p2"]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "repo" / "pkg").mkdir(parents=True)
    (tmp_path / "repo" / "build").mkdir()
    root = tmp_path / "repo"
    (root / "pkg" / "pool.py").write_text(SOURCE)
    (root / "README.MD").write_text("Pools hold slots. " * 10)
    (root / "short.txt").write_text("   too short   ")
    (root / "bad.rst").write_bytes(b"\xff\xfe" + b"x" * 100)
    (root / "build" / "x.md").write_text("skipped " * 20)
    (root / "pkg" / "UPPER.PY").write_text(SOURCE)
    (root / "dos.txt").write_bytes(b"a line of words that is long enough\r\nto be kept by the rule\r\n")
    return root


def test_read_tree(spark, tree):
    found = files.read_tree(spark, str(tree))
    assert sorted((r["source_path"], r["role"]) for r in found.collect()) == [
        ("README.MD", "doc"), ("bad.rst", "doc"), ("dos.txt", "doc"), ("pkg/pool.py", "code"), ("short.txt", "doc"),
    ]
    texts = {r["source_path"]: r["text"] for r in files.document_texts(found).collect()}
    assert set(texts) == {"README.MD", "dos.txt", "short.txt"} and "\r" not in texts["dos.txt"]
    chunks = files.tree_chunks(found)
    assert {r["chunk_id"] for r in chunks.where("kind = 'doc'").collect()} == {"README.MD:1-1:doc:_", "dos.txt:1-3:doc:_"}


def test_tree_below_a_skipped_folder_is_empty(spark, tree):
    assert files.read_tree(spark, str(tree / "build")).count() == 0


def item(n, **fields):
    return json.dumps({"number": n, "title": f"Title {n}", **fields})


def test_items(spark):
    raw = [
        item(1, body="b", labels=[{"name": "x"}, {"name": "y"}], state="closed", updated_at="2024-01-01"),
        item(2, pull_request=None, body=None, state=None, updated_at="2024-01-03"),
        item(3, title="  ", updated_at="2024-01-02"),
        item(4, body="z" * 6001, state="open", updated_at="2024-01-04"),
    ]
    parsed = items.parse_items(spark.createDataFrame([(r,) for r in raw], "json string"))
    chunks = {r["source_path"]: r for r in items.item_chunks(parsed, "r").collect()}
    assert set(chunks) == {"_gh/r/issues/1", "_gh/r/pr/2", "_gh/r/issues/4"}
    assert chunks["_gh/r/issues/1"]["text"] == "# Title 1\n\n#1 · ISSUE · state: closed · labels: x, y\n\nb"
    assert chunks["_gh/r/pr/2"]["text"] == "# Title 2\n\n#2 · PR · state: closed · labels: none"
    assert chunks["_gh/r/issues/4"]["text"].endswith("z\n\n[... truncated ...]")
    assert chunks["_gh/r/pr/2"]["end_line"] == 3
    assert [r["number"] for r in items.latest_closed(parsed, 2).collect()] == [2, 3]


def test_tracker_pages():
    waits, calls = [], []

    def fetch(repo, page, size):
        calls.append(page)
        if len(calls) == 2:
            return tracker.Page(403, rate_limited=True, reset_at=0)
        return tracker.Page(items=[item(page * 10 + i) for i in range(3)]) if page < 3 else tracker.Page(422)

    got = list(tracker.pages(fetch, "o/r", 100, waits.append))
    assert len(got) == 6 and calls == [1, 2, 2, 3] and waits == [0.5, 5, 0.5]
    assert len(list(tracker.pages(lambda *_: tracker.Page(items=["{}"] * 3), "o/r", 5, waits.append))) == 5
    with pytest.raises(RuntimeError):
        list(tracker.pages(lambda *_: tracker.Page(500), "o/r", 5, waits.append))


def test_tracker_as_a_data_source(spark):
    def fetch(repo, page, size):
        return tracker.Page(items=['{"number": 1, "title": "t"}']) if page == 1 else tracker.Page()

    spark.dataSource.register(tracker.tracker_source(fetch, "tracker_test", pause=lambda s: None))
    df = spark.read.format("tracker_test").option("repo", "o/r").load()
    assert items.parse_items(df).count() == 1


def test_request_batches_equal_a_plain_loop(spark):
    sizes = [(i * 7919) % 9000 for i in range(600)]
    sizes[3:6] = [0, 25_000, 1]
    df = spark.createDataFrame(list(enumerate(sizes)), "chunk_idx bigint, n_tokens int").repartition(3)
    expected = {}
    for flush in range(3):
        batch, used, filled = 0, 0, False
        for i in range(flush * 256, min(600, flush * 256 + 256)):
            if filled and used + sizes[i] > 20_000:
                batch, used = batch + 1, 0
            used, filled = used + sizes[i], True
            expected[i] = (flush, batch)
    got = {r["chunk_idx"]: (r["flush"], r["batch"]) for r in batching.request_batches(df).collect()}
    assert got == expected


def test_question_sources_are_the_first_that_pass(spark):
    rows = [(f"c{i}", "x" * 300, f"src/{i}.py", "<module>" if i % 20 else "f", "function") for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, source_path string, symbol string, kind string")
    order = sorted((f"c{i}" for i in range(0, 200, 20)), key=lambda c: (hashlib.md5(f"42:{c}".encode()).hexdigest(), c))
    for n in (4, 10):
        assert {r["chunk_id"] for r in sampling.question_sources(df, n).collect()} == set(order[:n])


def test_flushes_of_stored_ids_are_exact_beyond_doubles(spark):
    first = (1 << 60) + (5 << 33)
    df = spark.createDataFrame([(first + i, 1) for i in range(600)], "chunk_idx bigint, n_tokens int")
    flushes = batching.request_batches(df).groupBy("flush").count().orderBy("flush").collect()
    assert [(r["flush"] - (first >> 8), r["count"]) for r in flushes] == [(0, 256), (1, 256), (2, 88)]

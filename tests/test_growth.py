"""The store as it grows: known ids, merges, shards, cells, packed requests; and blocks that a search skips."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogue import retrieval, views
from gleaner.functions import arrow_tokens, embedding
from gleaner.functions import text as tx
from gleaner.functions.embedding import hashed_embedding
from gleaner.operators import keyword, vector, vector_index
from gleaner.operators.batching import batched_embeddings, request_batches
from gleaner.operators.chunking import whitespace_tokens
from gleaner.operators.keyword import KeywordIndex
from gleaner.plans.answering import agentic
from gleaner.plans.retrieve import retrieve
from gleaner.providers import Providers
from gleaner.sources import store as stores
from gleaner.sources.store import Store

CHUNK = "chunk_id string, text string, source_path string, kind string, symbol string, start_line int, end_line int"
def order():
    return [F.col("source_path")]


def chunks(spark, first, last):
    rng = random.Random(first)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(first, last):
        text = " ".join(rng.choice(words[: rng.randrange(2, 60)]) for _ in range(rng.randrange(5, 40)))
        rows.append((f"id{i:05d}", text, f"p/{i:05d}.md", "doc", f"Sym.s{i}", 1, 1))
    return spark.createDataFrame(rows, CHUNK)


def asked(spark):
    rows = [("a", "How does Sym.s7 use word3 and word40?"), ("b", "word1 word2 word59"), ("c", "word12")]
    return spark.createDataFrame(rows, "qid string, question string")


def hits(store, method="bm25"):
    rows = retrieve(asked(store.spark), store.corpus(), 5, method).select("qid", "rank", "chunk_id", F.round("score", 9)).collect()
    return sorted(map(tuple, rows))


def frequencies(index):
    return {r["term"]: r["df"] for r in index.frequencies.groupBy("term").agg(F.sum("df").alias("df")).collect()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """All chunks at once, as the store of many ingests must look."""
    store = Store(spark, str(tmp_path_factory.mktemp("whole")))
    store.add(chunks(spark, 0, 90).unionByName(chunks(spark, 90, 120)), order())
    return store


def test_merged_generations_answer_as_one(spark, tmp_path, whole):
    store = Store(spark, str(tmp_path / "s"))
    store.add(chunks(spark, 0, 90), order())
    store.add(chunks(spark, 90, 120).unionByName(chunks(spark, 0, 90).limit(5)), order())
    assert hits(store) == hits(whole) and store.count() == 120
    before = store.keywords()
    assert frequencies(before) == frequencies(whole.keywords())
    totals = tuple(round(x, 9) for x in whole.keywords().totals.first())
    assert tuple(round(x, 9) for x in before.totals.first()) == totals
    assert store.compact(fanout=2) == 2 and store.compact(fanout=2) == 0
    state = store._state()
    assert len(state.chunks) == len(state.postings) == 1 and state.epoch == 1
    assert hits(store) == hits(whole) and store.count() == 120
    assert tuple(round(x, 9) for x in store.keywords().totals.first()) == totals
    assert store.add(chunks(spark, 0, 90).limit(7), order()) == 0
    ids = store.chunks().select("chunk_idx").collect()
    assert len(set(ids)) == 120
    # Two gone generations of six tables (postings by shards), and the first commits are no longer read.
    assert store.vacuum() > 6
    assert hits(store) == hits(whole) and hits(Store(spark, store.root)) == hits(whole)


def test_a_merge_deals_out_no_texts(spark, tmp_path, monkeypatch, whole):
    store = Store(spark, str(tmp_path / "s"), 2)
    store.add(chunks(spark, 0, 90), order())
    store.add(chunks(spark, 90, 120), order())
    before = sorted(map(tuple, store.chunks().collect()))
    blocks = {r[0] for r in store.chunks().select("block").distinct().collect()}
    frame = type(spark.range(1))
    for name in ("repartition", "repartitionByRange"):
        def dealt(self, *keys, real=getattr(frame, name)):
            assert "text" not in self.columns
            return real(self, *keys)

        monkeypatch.setattr(frame, name, dealt)
    assert store.compact(fanout=2) == 2
    monkeypatch.undo()
    [gen] = store._state().chunks
    files = [f.parent.name for f in Path(store.root).rglob(f"chunks/gen={gen}/block=*/*.parquet")]
    assert sorted(files) == sorted(f"block={b}" for b in blocks)
    assert sorted(map(tuple, store.chunks().collect())) == before and hits(store) == hits(whole)


def size(store, gen):
    return sum(f.stat().st_size for f in Path(store.root).rglob(f"gen={gen}/**/*.parquet"))


def test_a_later_ingest_writes_no_more_than_an_early_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    store.add(chunks(spark, 0, 90), order())
    for i in range(4):
        store.add(chunks(spark, 200 + 3 * i, 203 + 3 * i), order())
    first, *later = list(store._state().chunks)
    assert max(size(store, g) for g in later) < 1.3 * min(size(store, g) for g in later) < size(store, first)


def test_shards_follow_each_ingest(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(stores, "SHARD_BYTES", 1000)
    monkeypatch.setattr(stores, "LEAST_SHARDS", 1)
    store = Store(spark, str(tmp_path / "s"))
    store.add(chunks(spark, 0, 90).limit(1), order())
    store.add(chunks(spark, 0, 90).unionByName(chunks(spark, 90, 120)), order())
    small, large = [row["shards"] for row in store._state().postings.values()]
    assert small == 1 < large
    assert hits(store) == hits(whole)
    store.compact(fanout=2)
    [merged] = [row["shards"] for row in store._state().postings.values()]
    assert merged >= large and hits(store) == hits(whole)


def test_a_shard_is_written_in_pieces(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(stores, "PIECE_BYTES", 1000)
    store = Store(spark, str(tmp_path / "s"), 2)
    store.add(chunks(spark, 0, 90), order())
    store.add(chunks(spark, 0, 90).unionByName(chunks(spark, 90, 120)), order())
    written = lambda: [
        len([f for f in Path(store.root).rglob(f"postings-2/gen={g}/*.parquet")]) for g in store._state().postings
    ]
    assert min(written()) > 2 and hits(store) == hits(whole)
    store.compact(fanout=2)
    [merged] = written()
    assert merged > 2 and hits(store) == hits(whole)
    store.rebuild_keywords()
    [rebuilt] = written()
    assert rebuilt > 2 and hits(store) == hits(whole)


def test_known_ids_are_looked_up(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    store.add(spark.range(20_000).select(
        F.format_string("id%08d", "id").alias("chunk_id"), F.lit("text of it").alias("text"), F.format_string("p%08d", "id").alias("source_path"),
        F.lit("doc").alias("kind"), F.lit("").alias("symbol"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
    ), order())
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
    fresh = chunks(spark, 0, 3).withColumn("chunk_id", F.format_string("id%08d", F.substring("chunk_id", 3, 9).cast("int") * 30_000))
    unknown = store._unknown(fresh, list(store._state().chunks), small=True)
    assert sorted(r["chunk_id"] for r in unknown.collect()) == ["id00030000", "id00060000"]
    plan = unknown._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/ids/" in line)
    assert "PushedFilters: [In(chunk_id" in scan and "ReadSchema: struct<chunk_id:string>" in scan
    assert store._unknown(fresh, list(store._state().chunks), small=False).count() == 2


def test_cells_grow_with_the_store(spark, tmp_path, whole):
    store = Store(spark, str(tmp_path / "s"), 2)
    store.add(chunks(spark, 0, 90), order())
    store.index_vectors(cells=6)
    store.add(chunks(spark, 90, 120), order())
    assert store.corpus().cells.n.sum() == 120
    assert hits(store, "vector") == hits(whole, "vector") and hits(store, "hybrid") == hits(whole, "hybrid")
    store.compact(fanout=2)
    assert store.corpus().cells.n.sum() == 120 and hits(store, "vector") == hits(whole, "vector")


def clustered(spark, n=6000, cells=40, dims=24, spread=0.35):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(cells, dims))
    rows = [(i, (centre[i % cells] + rng.normal(size=dims) * spread).tolist()) for i in range(n)]
    rows += [(n + i, centre[3].tolist()) for i in range(200)] + [(n + 200, [0.0] * dims), (n + 201, None)]
    return spark.createDataFrame(rows, "chunk_idx bigint, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    vectors = clustered(spark).cache()
    root = str(tmp_path_factory.mktemp("cells"))
    centre = vector_index.centroids(vectors)
    vector_index.VectorIndex.write(vectors, root, centre)
    return vectors, vector_index.VectorIndex.read(spark, centre, [root])


def listed(df):
    return {(r["qid"], r["rank"], r["chunk_idx"], r["similarity"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 10, 300])
def test_cells_are_exact(cells, k):
    vectors, index = cells
    queries = vectors.where("chunk_idx % 300 = 3 OR chunk_idx = 6200").select(F.col("chunk_idx").cast("string").alias("qid"), "embedding")
    got, share = index.search(queries, k)
    assert listed(got) == listed(vector.nearest(vectors.where("embedding IS NOT NULL"), queries, k))
    assert share < 1


def test_few_cells_are_read_on_clusters(cells):
    vectors, index = cells
    queries = vectors.where("chunk_idx % 300 = 5").select(F.col("chunk_idx").cast("string").alias("qid"), "embedding")
    want = {(q, i) for q, _, i, _ in listed(vector.nearest(vectors.where("embedding IS NOT NULL"), queries, 10))}
    for probes in (None, 8):
        got, share = index.search(queries, 10, probes)
        recall = len({(q, i) for q, _, i, _ in listed(got)} & want) / len(want)
        assert share <= 0.25 and recall >= (0.95 if probes else 1)


def test_an_empty_vector_index(spark, tmp_path):
    vectors = spark.createDataFrame([], "chunk_idx bigint, embedding array<float>")
    centre = vector_index.centroids(vectors)
    vector_index.VectorIndex.write(vectors, str(tmp_path / "v"), centre)
    index = vector_index.VectorIndex.read(spark, centre, [str(tmp_path / "v")])
    assert index.search(spark.createDataFrame([("q", [1.0])], "qid string, embedding array<float>"), 3)[0].collect() == []


def test_requests_are_packed(spark, tmp_path, whole):
    texts = whole.chunks().select("chunk_idx", "text")
    calls = spark.sparkContext.accumulator(0)

    def embed_batch(batch):
        calls.add(1)
        return [[float(len(t)), 1.0] for t in batch]

    got = {r["chunk_idx"]: r["embedding"] for r in batched_embeddings(texts, embed_batch, budget=100).collect()}
    assert got == {r["chunk_idx"]: [float(len(r["text"])), 1.0] for r in texts.collect()}
    sized = texts.select("chunk_idx", F.size(whitespace_tokens(F.col("text"))).alias("n_tokens"))
    assert calls.value == request_batches(sized, 100).select("flush", "batch").distinct().count() > 5
    store = Store(spark, str(tmp_path / "s"), 2)
    store.add(chunks(spark, 0, 20), order(), Providers(embed_batch=embed_batch))
    lengths = {r["chunk_idx"]: r["text"] for r in store.chunks().collect()}
    assert {r["chunk_idx"]: r["embedding"] for r in store.vectors().collect()} == {i: [float(len(t)), 1.0] for i, t in lengths.items()}


def test_an_answer_without_a_search(spark, whole):
    def knows(questions, hits, turn, listings):
        return questions.select("qid", F.lit(0).alias("call"), "question", F.lit(5).alias("k"), F.lit("known").alias("answer")).withColumnRenamed("question", "query")

    answers, found = agentic(asked(spark), whole.corpus(), planner=knows)
    assert {(r["qid"], r["answer"], r["turns"]) for r in answers.collect()} == {(q, "known", 1) for q in "abc"}
    assert found.collect() == []

    def silent(questions, hits, turn, listings):
        return questions.select("qid", F.lit(0).alias("call"), F.col("question").alias("query"), F.lit(5).alias("k")).limit(0)

    answers, found = agentic(asked(spark), whole.corpus(), planner=silent)
    assert answers.count() == 3 and answers.where("insufficient").count() == 3 and found.isEmpty()


# -- blocks of chunks -----------------------------------------------------------------


def scored(postings, asked_keys, index):
    """Scores and name positions of every (question, chunk), one posting at a time."""
    totals, df = index.totals.first(), frequencies(index)
    score, pos = defaultdict(float), {}
    for key in asked_keys:
        for p in postings[key["key"]]:
            cell = key["qid"], p["chunk_idx"]
            if key["pos"] is not None:
                pos[cell] = min(pos.get(cell, math.inf), key["pos"])
                continue
            idf = math.log(totals["n_docs"] - df[key["key"]] + 0.5) - math.log(df[key["key"]] + 0.5)
            weight = key["qtf"] * (totals["idf_floor"] if idf < 0 else idf)
            score[cell] += weight * p["tf"] * 2.5 / (p["tf"] + 1.5 * (0.25 + 0.75 * p["dl"] / totals["avgdl"]))
    return score, pos


@pytest.mark.parametrize("k", [1, 4, 25])
def test_skipped_blocks_change_nothing(spark, whole, k):
    table = whole.chunks().drop("chunk_idx").withColumn("chunk_idx", F.substring("chunk_id", 3, 9).cast("long"))
    index = KeywordIndex.over(table)
    questions = asked(spark).unionByName(spark.createDataFrame([(f"x{i}", f"word{i} word{i + 1} and Sym.s{i}") for i in range(30)], "qid string, question string"))
    keys = keyword.question_keys(questions).collect()
    postings = defaultdict(list)
    for p in index.postings.collect():
        postings[p["key"]].append(p)
    score, pos = scored(postings, keys, index)
    got = Counter((r["qid"], r["rank"], r["chunk_idx"]) for r in keyword.keyword_leg(questions, index, k).collect())
    want = Counter()
    for q in {key["qid"] for key in keys}:
        cells = {c for a, c in [*score, *pos] if a == q}
        order = sorted(
            (c for c in cells if (q, c) in pos or score[q, c] > 0),
            key=lambda c: ((0, pos[q, c], c) if (q, c) in pos else (1, -round(score[q, c], 9), c)),
        )
        want.update((q, rank, c) for rank, c in enumerate(order[:k]))
    assert got == want


def test_most_blocks_are_skipped(spark):
    sf = "/root/testdata/sf0.1"
    index = retrieval.index(spark, sf)
    asked_ = keyword._asked(keyword.question_keys(views.questions(spark, sf)).collect(), index)
    numbers = spark.createDataFrame(list(enumerate(asked_.keys)), "number int, key string")
    terms = index.postings.join(F.broadcast(numbers), "key").groupBy("chunk_idx").agg(
        F.first("dl").alias("dl"), F.collect_list(F.struct("number", "tf")).alias("terms")
    )
    walk = keyword.BlockWalk(asked_, 10, inject=False, best=False)
    for batch in terms.select("chunk_idx", "dl", "terms").toArrow().to_batches(max_chunksize=2000):
        walk.add(batch)
    assert walk.scored < walk.cells / 2




def walked(spark, questions, k):
    """A walk over the documents of sf0.1, and the most bytes it held at once."""
    index = retrieval.index(spark, "/root/testdata/sf0.1")
    asked_ = keyword._asked(keyword.question_keys(questions).collect(), index)
    numbers = spark.createDataFrame(list(enumerate(asked_.keys)), "number int, key string")
    terms = index.postings.join(F.broadcast(numbers), "key").groupBy("chunk_idx").agg(
        F.first("dl").alias("dl"), F.collect_list(F.struct("number", "tf")).alias("terms")
    )
    batches = terms.select("chunk_idx", "dl", "terms").toArrow().combine_chunks().to_batches()
    tracemalloc.start()
    try:
        walk = keyword.BlockWalk(asked_, k, inject=True, best=True)
        for batch in batches:
            walk.add(batch)
        return walk, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_few_cells_of_many_questions_are_scored(spark):
    turns = views.table(spark, "/root/testdata/sf0.1", "conversations").where("role = 'user' AND conv_id % 5 = 0")
    walk, _ = walked(spark, turns.select(F.format_string("%d/%d", "conv_id", "turn").alias("qid"), F.col("text").alias("question")), 5)
    assert walk.scored < walk.cells / 50


def test_a_task_holds_a_bounded_block(spark):
    _, most = walked(spark, views.named_questions(spark, "/root/testdata/sf0.1"), 60)
    assert most < 150 << 20


def made_walk(questions, terms, chunks, words, keys, k, step=1 << 20):
    """A walk over made-up chunks of so many words, for questions of so many terms: its lists, and the most bytes it held.

    The first question finds nothing.
    """
    rng = np.random.default_rng(7)
    asks = np.argsort(rng.random((questions, keys)), axis=1)[:, :terms]
    asks[0] = np.arange(keys - terms, keys)
    code = np.unique((asks * questions + np.arange(questions)[:, None]).ravel())
    key, asker = code // questions, code % questions
    first = np.searchsorted(key, np.arange(keys + 1))
    weight = rng.integers(1, 9, keys)[key] / 4.0
    asked_ = keyword._Asked(
        [f"q{i}" for i in range(questions)], np.ones(questions, bool), np.zeros(questions, bool), [""] * keys, first, asker,
        weight, np.full(len(code), -1), np.empty(0, np.int64), float(words),
    )
    number = [np.unique(row) for row in rng.integers(0, keys - terms, (chunks, words))]
    ends = np.cumsum([0, *map(len, number)]).astype(np.int32)
    number = np.concatenate(number).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(number), pa.array(rng.integers(1, 4, len(number)).astype(np.int32))], ["number", "tf"])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(chunks)), pa.array(np.full(chunks, words, np.int32)), pa.ListArray.from_arrays(ends, entries)], ["chunk_idx", "dl", "terms"]
    )
    tracemalloc.start()
    try:
        walk = keyword.BlockWalk(asked_, k, inject=False, best=False)
        for at in range(1, batch.num_rows, step):
            walk.add(batch.slice(at, step))
        return [column.tolist() for column in walk.lists.rows], tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_terms_that_many_questions_ask_are_met_a_bounded_number_at_a_time():
    # 2,000 chunks with 130 terms are 260,000 postings and 4 million cells, but 5 million uses.
    assert made_walk(2000, 200, 2000, 130, 20_000, 5)[1] < 150 << 20


def test_long_questions_are_scored_a_bounded_number_of_terms_at_a_time():
    assert made_walk(64, 4000, 300, 200, 20_000, 60)[1] < 150 << 20


def test_small_portions_find_the_same(monkeypatch):
    want, _ = made_walk(30, 40, 200, 50, 500, 7)
    for most in (1, 100, 2000):
        monkeypatch.setattr(keyword, "BLOCK_USES", most)
        monkeypatch.setattr(keyword, "SCORED_TERMS", most)
        assert made_walk(30, 40, 200, 50, 500, 7)[0] == want
    assert len(want[0]) == 29 * 7


def test_a_question_without_hits_hides_none_of_the_others():
    want, _ = made_walk(30, 40, 200, 50, 500, 7)
    for step in (1, 5, 190):
        assert made_walk(30, 40, 200, 50, 500, 7, step)[0] == want


def test_bounds_in_single_precision_lose_nothing(spark, monkeypatch, whole):
    table = whole.chunks().drop("chunk_idx").withColumn("chunk_idx", F.substring("chunk_id", 3, 9).cast("long"))
    index = KeywordIndex.over(table)
    questions = asked(spark).unionByName(spark.createDataFrame([(f"x{i}", f"word{i} word{i + 1} and Sym.s{i}") for i in range(30)], "qid string, question string"))
    found = []
    # All terms one by one, some as a matrix, and all as a matrix; a few postings at a time.
    for gain, postings in ((0, 1 << 18), (256, 1 << 18), (4, 50), (1 << 40, 7)):
        monkeypatch.setattr(keyword, "DENSE_GAIN", gain)
        monkeypatch.setattr(keyword, "BLOCK_POSTINGS", postings)
        found.append(sorted((r["qid"], r["rank"], r["chunk_idx"], round(r["score"], 9)) for r in keyword.keyword_search(questions, index, 7).collect()))
    assert found[0] and all(f == found[0] for f in found)


ODD = [
    None, "", " ", "the THE a b", "getHTTPResponse getHTTPResponse x9Y z", "f\u00fcr gro\u00dfe \u212aelvin \u0130stanbul", "v2Beta\n42\tABCd", "word " * 3000 + "End",
    "aB" * 400, "\U0001f600last", "self.method_name(argOne)",
]


def odd_chunks(spark):
    rows = [(i, text, path, symbol) for path, symbol in (("a/b.md", "Pool.take"), ("", ""), ("p", "<module>"), ("\u00c4/x", " \u00c4b.C\u00e9 "), (None, None)) for i, text in enumerate(ODD)]
    return spark.createDataFrame([(i, *row[1:]) for i, row in enumerate(rows)], "chunk_idx bigint, text string, source_path string, symbol string")


@pytest.mark.parametrize("block", [1, 100, 8 << 20])
def test_postings_of_blocks_are_those_of_rows(spark, monkeypatch, block):
    table = odd_chunks(spark)
    want = sorted(map(tuple, keyword.postings(keyword.forward_index(table)).collect()))
    monkeypatch.setattr(arrow_tokens.blocks, "__defaults__", (block,))
    rows = table.select("chunk_idx", *(c.alias(n) for c, n in zip(keyword._body_and_names(True), ("body", "names")))).toArrow()
    got = [tuple(r.values()) for batch in keyword._post(rows.to_batches()) for r in batch.to_pylist()]
    assert sorted(got) == want
    assert sorted(map(tuple, keyword.placed_postings(table, 3).collect())) == want


def test_words_are_cut_in_little_memory():
    texts = pa.array(["several ordinary words without seams of some length " * 80] * 1000)
    arrow_tokens._words(texts)
    tracemalloc.start()
    try:
        owner, words = arrow_tokens._words(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(words) == len(owner) == 640_000 and most < 9 * texts.nbytes


def test_words_end_with_their_text():
    texts = pa.array(["x", "ab", "", None, "cd ", " ef", "g-h", "i@Z[`a{/0:9", "", "\u00e9k\u00e9"]).slice(1)
    owner, words = arrow_tokens._words(texts)
    assert list(zip(owner.tolist(), words.to_pylist())) == [
        (0, "ab"), (3, "cd"), (4, "ef"), (5, "g"), (5, "h"), (6, "i"), (6, "Z"), (6, "a"), (6, "0"), (6, "9"), (8, "k"),
    ]
    assert [len(x) for x in arrow_tokens._words(pa.array(["", None]))] == [0, 0]


def test_embedding_of_blocks_is_that_of_tokens(spark):
    rows = odd_chunks(spark).select(tx.tokens(F.col("text")).alias("t"), hashed_embedding(F.col("text")).alias("v")).collect()
    for row in rows:
        n = Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64 for t in row["t"] or [])
        norm = math.sqrt(sum(x * x for x in n.values())) or 1.0
        assert row["v"] == [float(np.float32(n[i] / norm)) for i in range(64)]


def test_a_term_is_hashed_once_per_block(monkeypatch):
    hashed = []
    monkeypatch.setattr(embedding, "bucket", lambda term, dimensions: hashed.append(term) or 0)
    embedding._embedded(pa.array(["alpha beta beta"] * 1000), 64)
    assert hashed == ["alpha", "beta"]


def test_the_build_keeps_no_rows(spark, tmp_path, monkeypatch):
    """Texts go to the tasks that index them, and nothing is cached on the way."""
    def kept(*_, **__):
        raise AssertionError("rows of the build were cached")

    monkeypatch.setattr(type(spark.range(1)), "persist", kept)
    stores.write_keywords(odd_chunks(spark), str(tmp_path / "k"), 1, 2, 100)
    index = stores.read_keywords(spark, str(tmp_path / "k"), [1], 2)
    totals = index.totals.first()
    assert totals["n_docs"] == 5 * len(ODD)
    assert round(totals["avgdl"] * totals["n_docs"]) == index.postings.agg(F.sum("tf")).first()[0]


def many_questions(spark, n=60):
    return spark.createDataFrame([(f"x{i}", f"word{i % 9} word{i % 7 + 1} text of Sym.s{i}") for i in range(n)], "qid string, question string")


def test_batches_of_questions_share_a_pass_over_the_index(spark, monkeypatch, whole):
    index = KeywordIndex.over(whole.chunks())
    questions = many_questions(spark)
    want = sorted(map(tuple, keyword.keyword_search(questions, index, 4).collect()))
    walked_, listing = [], keyword._listing
    monkeypatch.setattr(keyword, "_listing", lambda batches, *rest: walked_.append(len(batches)) or listing(batches, *rest))
    monkeypatch.setattr(keyword, "QUESTION_KEYS", 40)
    assert sorted(map(tuple, keyword.keyword_search(questions, index, 4).collect())) == want and want
    assert len(walked_) == 1 and walked_[0] > 5
    # Only as many questions as a task can hold lists of, and so many distinct keys, share one.
    for name, most in (("PASS_ENTRIES", 100), ("PASS_WORDS", 30), ("PASS_BATCHES", 3)):
        walked_.clear()
        monkeypatch.setattr(keyword, name, most)
        assert sorted(map(tuple, keyword.keyword_search(questions, index, 4).collect())) == want
        assert len(walked_) > 1
        monkeypatch.undo()
        monkeypatch.setattr(keyword, "_listing", lambda batches, *rest: walked_.append(len(batches)) or listing(batches, *rest))
        monkeypatch.setattr(keyword, "QUESTION_KEYS", 40)


def test_kinds_of_questions_change_nothing(spark, monkeypatch, whole):
    index = KeywordIndex.over(whole.chunks())
    questions = many_questions(spark)
    want = sorted(map(tuple, keyword.keyword_search(questions, index, 4).collect()))
    found, of = [], keyword._Labels.of
    monkeypatch.setattr(keyword._Labels, "of", staticmethod(lambda asked_: found.append(of(asked_)) or found[-1]))
    for name, value in (("GROUP_QUESTIONS", 7), ("LABELS", 3), ("DENSE_GAIN", 1 << 20), ("CROWDED", 0), ("SLAB_POSTINGS", 200)):
        monkeypatch.setattr(keyword, name, value)
    assert sorted(map(tuple, keyword.keyword_search(questions, index, 4).collect())) == want
    assert found[0] is not None and found[0].centres.shape[1] == 3


def test_questions_that_a_block_cannot_serve_skip_it():
    """Chunks in another language are not met one by one."""
    def batch(first, words):
        keys = np.tile(words, 200)
        entries = pa.StructArray.from_arrays([pa.array(keys.astype(np.int32)), pa.array(np.ones(len(keys), np.int32))], ["number", "tf"])
        ends = np.arange(0, len(keys) + 1, len(words)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(first, first + 200)), pa.array(np.full(200, len(words), np.int32)), pa.ListArray.from_arrays(ends, entries)], ["chunk_idx", "dl", "terms"]
        )

    # Ten questions ask for words 0 to 4, and lightly for word 9.
    asker = np.tile(np.arange(10), 6)
    asked_ = keyword._Asked(
        [f"q{i}" for i in range(10)], np.ones(10, bool), np.zeros(10, bool), [""] * 10, np.r_[np.arange(0, 51, 10), np.full(4, 50), 60], asker,
        np.repeat([3.0, 3.0, 3.0, 3.0, 3.0, 0.5], 10), np.full(60, -1), np.empty(0, np.int64), 5.0,
    )
    walk = keyword.BlockWalk(asked_, 5, inject=False, best=False)
    walk.add(batch(0, np.arange(5)))
    before, lists = walk.cells, [c.tolist() for c in walk.lists.rows]
    walk.add(batch(200, np.arange(5, 10)))
    assert walk.cells == before and [c.tolist() for c in walk.lists.rows] == lists and len(lists[0]) == 50

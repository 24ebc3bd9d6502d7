import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import hybrid, joins, keyword, vector
from gleaner.operators.keyword import KeywordIndex
from gleaner.operators.rerank import best_scored

DOCS = ["alpha beta beta", "alpha gamma", "alpha delta epsilon", "beta", ""]


def chunk_table(spark, texts, symbols=None):
    symbols = symbols or [""] * len(texts)
    rows = [(i, t, f"p{i}.md", s) for i, (t, s) in enumerate(zip(texts, symbols))]
    return spark.createDataFrame(rows, "chunk_idx bigint, text string, source_path string, symbol string")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, question string")


@pytest.mark.parametrize(
    "question, expected",
    [
        ("alpha beta", [0.522613, 0.156945, 0.126763, 0.420590]),
        ("alpha alpha beta", [0.649376, 0.313889, 0.253526, 0.420590]),
        ("gamma", [0, 1.046297, 0, 0]),
    ],
)
def test_bm25_with_floored_idf(spark, question, expected):
    index = KeywordIndex.over(chunk_table(spark, DOCS), enriched=False)
    rows = keyword.bm25_scores(asked(spark, question), index, 10).collect()
    scores = {r["chunk_idx"]: r["score"] for r in rows}
    assert [round(scores.get(i, 0), 6) for i in range(4)] == expected
    assert 4 not in scores
    ordered = sorted(rows, key=lambda r: r["rank"])
    assert [(-r["score"], r["chunk_idx"]) for r in ordered] == sorted((-r["score"], r["chunk_idx"]) for r in rows)


def test_totals_of_the_golden_corpus(spark):
    totals = KeywordIndex.over(chunk_table(spark, DOCS), enriched=False).totals.first()
    assert (totals["n_docs"], round(totals["avgdl"], 6), round(totals["mean_idf"], 6)) == (5, 1.8, 0.659167)


def test_ties_go_by_chunk_order(spark):
    index = KeywordIndex.over(chunk_table(spark, ["same words"] * 3 + ["other"] * 5), enriched=False)
    rows = keyword.bm25_scores(asked(spark, "same"), index, 2).orderBy("rank").collect()
    assert [r["chunk_idx"] for r in rows] == [0, 1]


def test_injected_chunks_come_first_with_a_bonus(spark):
    chunks = chunk_table(spark, ["pool slots text", "nothing here", "pool pool pool"], ["Pool.take", "Other.take", "x"])
    index = KeywordIndex.over(chunks)
    rows = keyword.keyword_search(asked(spark, "pool Other.take", "a_b", "pool"), index, 3).orderBy("qid", "rank").collect()
    first = [r for r in rows if r["qid"] == "q0"]
    assert (first[0]["chunk_idx"], first[0]["injected"]) == (1, True)
    best = keyword.listed_matches(asked(spark, "pool Other.take"), index, 1000, inject=False).agg(F.max("score")).first()[0]
    assert abs(first[0]["score"] - 100 - best) < 1e-9
    assert not [r for r in rows if r["qid"] == "q1"], "a question without tokens finds nothing"
    assert all(not r["injected"] for r in rows if r["qid"] == "q2")


def test_a_full_list_of_injected_chunks_still_scores_above_the_best(spark):
    texts = ["word"] * 4 + ["pool pool pool pool", "other words"] * 3
    chunks = chunk_table(spark, texts, ["A.run"] * 4 + [""] * 6)
    rows = keyword.keyword_search(asked(spark, "pool A.run"), KeywordIndex.over(chunks), 2).collect()
    everything = keyword.listed_matches(asked(spark, "pool A.run"), KeywordIndex.over(chunks), 1000, inject=False).agg(F.max("score")).first()[0]
    assert {r["chunk_idx"] for r in rows} == {0, 1} and all(abs(r["score"] - everything - 100) < 1e-9 for r in rows)


def test_question_batches_and_blocks_give_the_same(spark, monkeypatch):
    texts = [f"pool word{i % 7} slot{i % 3} word{i % 5}" for i in range(60)]
    index = KeywordIndex.over(chunk_table(spark, texts, ["A.run" if i % 9 == 0 else "" for i in range(60)]))
    questions = asked(spark, *[f"word{i} slot{i % 3} pool A.run" if i % 2 else f"word{i} pool" for i in range(12)])
    rows = lambda: sorted(map(tuple, keyword.keyword_search(questions, index, 4).collect()))
    want = rows()
    monkeypatch.setattr(keyword, "BLOCK_CELLS", 24)
    assert rows() == want
    monkeypatch.setattr(keyword, "QUESTION_KEYS", 20)
    assert rows() == want


def test_symbol_matches(spark):
    chunks = chunk_table(spark, ["a", "b", "c"], ["Pool.take", "take_all", "Give.take_all"])
    rows = keyword.symbol_matches(asked(spark, "take_all then Pool.take then take_all"), chunks).orderBy("pos", "chunk_idx").collect()
    assert [(r["chunk_idx"], r["pos"]) for r in rows] == [(1, 0), (2, 0), (0, 1)]


def test_salted_join_equals_broadcast_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).cast("string").alias("key"), F.col("id").alias("chunk_idx"))
    lookup = spark.createDataFrame([("0", 1), ("1", 2), ("1", 3), ("9", 4)], "key string, w int")
    small = joins.join_lookup(big, lookup, "key", "chunk_idx", True)
    salted = joins.join_lookup(big, lookup, "key", "chunk_idx", False)
    assert sorted(map(tuple, small.select("key", "chunk_idx", "w").collect())) == sorted(
        map(tuple, salted.select("key", "chunk_idx", "w").collect())
    )


def test_keyword_search_without_broadcast(spark, monkeypatch):
    chunks, questions = chunk_table(spark, DOCS), asked(spark, "alpha beta", "gamma delta")
    expected = keyword.bm25_scores(questions, KeywordIndex.over(chunks), 3).collect()
    monkeypatch.setattr(keyword, "fits_broadcast", lambda df: False)
    got = keyword.bm25_scores(questions, KeywordIndex.over(chunks), 3).collect()
    shown = lambda rows: sorted((r["qid"], r["rank"], r["chunk_idx"], round(r["score"], 9)) for r in rows)
    assert shown(got) == shown(expected)


def test_two_round_top_k_equals_one_round(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id"), (F.col("id") * 7 % 13).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    one = joins.top_ranked(df, ["g"], order, 9)
    two = joins.top_ranked(df, ["g"], order, 9, spread_by="id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


@pytest.mark.parametrize("cells", [False, True])
def test_nearest_equals_brute_force(spark, cells, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    base[50:60] = base[0]  # equal similarities
    wanted = np.vstack([base[:7] + 0.1 * rng.normal(size=(7, 16)), np.zeros((1, 16))])
    if cells:
        monkeypatch.setattr(vector, "CELL_VECTORS", 70)
        monkeypatch.setattr(vector, "CELL_QUERIES", 3)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "chunk_idx bigint, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(wanted)], "qid string, embedding array<float>")
    limit = {"broadcast_queries": 2} if cells else {}
    rows = vector.nearest(vectors, queries, 12, **limit).collect()
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=m.any(axis=1, keepdims=True))
    sims = np.round(unit(wanted.astype(np.float32).astype(float)) @ unit(base.astype(np.float32).astype(float)).T, 9)
    for q in range(len(wanted)):
        expected = sorted(range(300), key=lambda i: (-sims[q, i], i))[:12]
        got = [r["chunk_idx"] for r in sorted((r for r in rows if r["qid"] == f"q{q}"), key=lambda r: r["rank"])]
        assert got == expected


def legs(spark, near, words, injected=()):
    v = spark.createDataFrame([("q", i, ord(c)) for i, c in enumerate(near)], "qid string, rank int, chunk_idx bigint")
    k = spark.createDataFrame(
        [("q", i, ord(c), c in injected, True) for i, c in enumerate(words)],
        "qid string, rank int, chunk_idx bigint, injected boolean, searchable boolean",
    )
    return hybrid.fuse(v, k)


def shown(hits):
    return [(chr(r["chunk_idx"]), round(r["score"], 9), r["source"]) for r in hits.orderBy("rank").collect()]


def test_reciprocal_rank_fusion_and_its_ties(spark):
    got = shown(hybrid.pin_and_cut(legs(spark, "ABC", "CDA"), 6, 6))
    assert got == [
        ("A", 0.032795699, "bm25+vector"),
        ("C", 0.032795699, "bm25+vector"),
        ("B", 0.016393443, "vector"),
        ("D", 0.016393443, "bm25"),
    ]


def test_pins(spark):
    got = shown(hybrid.pin_and_cut(legs(spark, "ABC", "XYZA", injected="XYZ"), 6, 6))
    assert [(g[0], g[2]) for g in got] == [
        ("X", "bm25+symbol"), ("Y", "bm25+symbol"), ("A", "bm25+vector"), ("B", "vector"), ("C", "vector"), ("Z", "bm25"),
    ]
    generic = shown(hybrid.pin_and_cut(legs(spark, "ABC", "UVWXYZ", injected="UVWXYZ"), 6, 6))
    assert all("symbol" not in g[2] for g in generic)


def test_pinned_chunk_of_a_question_without_tokens(spark):
    v = spark.createDataFrame([("q", 0, 1)], "qid string, rank int, chunk_idx bigint")
    k = spark.createDataFrame([("q", 0, 2, True, False)], "qid string, rank int, chunk_idx bigint, injected boolean, searchable boolean")
    rows = hybrid.pin_and_cut(hybrid.fuse(v, k), 6, 6).orderBy("rank").collect()
    assert [(r["chunk_idx"], r["score"], r["source"]) for r in rows] == [(2, 0.0, "symbol"), (1, 1 / 60, "vector")]


def test_sizes():
    assert [hybrid.pin_budget(k) for k in (1, 3, 6, 9, 30)] == [1, 1, 2, 3, 3]
    assert (hybrid.fetch_size(hybrid.pool_size(6, False)), hybrid.fetch_size(hybrid.pool_size(6, True))) == (60, 300)


def test_rerank_keeps_pins_and_breaks_ties_by_rank(spark):
    rows = [
        ("q", "red fox", 0, 1, "nothing", 0.0, "symbol", True),
        ("q", "red fox", 1, 2, "blue", 0.9, "vector", False),
        ("q", "red fox", 2, 3, "red fox", 0.8, "bm25", False),
        ("q", "red fox", 3, 4, "green", 0.7, "bm25", False),
    ]
    hits = spark.createDataFrame(
        rows, "qid string, question string, rank int, chunk_idx bigint, text string, score double, source string, pinned boolean"
    )
    got = best_scored(hits, 3).orderBy("rank").collect()
    assert [(r["chunk_idx"], r["rerank_score"], r["source"]) for r in got] == [
        (1, None, "symbol"), (3, 1.0, "bm25+rerank"), (2, 0.0, "vector+rerank"),
    ]

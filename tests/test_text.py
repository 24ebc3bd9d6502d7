from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import arrays, embedding, layout, replies, routing
from gleaner.functions import text as tx


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("t"))).collect()]


TOKENS = {
    "GCSHook.upload": ["gcshook", "gcs", "hook", "upload"],
    "max_active_tis": ["max", "active", "tis"],
    "XMLHttpRequest2": ["xmlhttprequest2", "xml", "http", "request"],
    "v2Beta 42": ["v2beta", "beta", "42"],
    "SelfTest isReady": ["selftest", "test", "isready", "ready"],
    "für große": ["gro"],
    "a b c": [],
    "the THE The": [],
    "": [],
    "getHTTPResponse getHTTPResponse": ["gethttpresponse", "get", "http", "response"] * 2,
}


def test_tokens(spark):
    assert column(spark, TOKENS, tx.tokens) == list(TOKENS.values())


def test_counted_is_the_multiset(spark):
    got = column(spark, TOKENS, lambda t: arrays.counted(tx.tokens(t)))
    for row, expected in zip(got, TOKENS.values()):
        assert {c["item"]: c["n"] for c in row} == Counter(expected)


def test_identifiers(spark):
    cases = {
        "GCSHook.upload max_active_tis": ["GCSHook.upload", "max_active_tis"],
        "GCSHook alone": [],
        "über_x ü_b straße_nö a_b TaskInstance": ["a_b", "TaskInstance"],
        "self.DAGRun Foo.bar.baz": ["Foo.bar.baz"],
    }
    assert column(spark, cases, tx.identifiers) == list(cases.values())


def test_boost_repeats_identifiers_five_times(spark):
    got = column(spark, ["see Foo.bar and a_b", "nothing"], tx.boosted_question)
    assert got == ["see Foo.bar and a_b" + " Foo.bar a_b" * 5, "nothing "]


def test_index_text_and_symbol_keys(spark):
    df = spark.createDataFrame(
        [("t", "p.py", "A.b"), ("t", "p.py", ""), ("t", None, None), ("t", "", "<module>")], "text string, p string, s string"
    )
    rows = df.select(tx.index_text(F.col("text"), F.col("p"), F.col("s")), tx.symbol_keys(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["p.py A.b A.b A.b\n\nt", "p.py\n\nt", "t", "<module> <module> <module>\n\nt"]
    assert [r[1] for r in rows] == [["a.b", "b"], [], [], []]


@pytest.mark.parametrize(
    "question, expected",
    [
        ("In what order do callbacks fire?", "multi_hop"),
        ("Which hooks run and why?", "multi_hop"),
        ("What is Foo.bar?", "code"),
        ("Where is the pool defined?", "code"),
        ("What is a pool?", "conceptual"),
        ("pools vs slots", "conceptual"),
        ("Why does it stop?", "conceptual"),
        ("tell me about pools", "code"),
    ],
)
def test_classify(spark, question, expected):
    assert column(spark, [question], routing.classify) == [expected]


def test_route_table(spark):
    got = column(spark, ["multi_hop", "conceptual", "code"], routing.method_for)
    assert got == ["agentic", "hybrid_hyde", "hybrid"]


def test_verdicts(spark):
    long = "no json " + "x" * 400
    cases = {
        '{"score": 2, "reason": "ok"}': (2, "ok"),
        '```json\n{"score": 2, "reason": "ok"}\n```': (2, "ok"),
        '{"score": 7, "reason": "x"}': (3, "x"),
        '{"score": -4, "reason": "x"}': (0, "x"),
        'bad "score": 1 tail': (1, 'bad "score": 1 tail'),
        "no json": (0, "no json"),
        long: (0, long[:300]),
        '{"score": "3"}': (3, ""),
        '{"score": "2.5"}': (0, '{"score": "2.5"}'),
        '{"score": 2.9, "reason": null}': (2, "None"),
        '{"score": true, "reason": "b"}': (1, "b"),
        '{"score": [2], "reason": "b"}': (0, '{"score": [2], "reason": "b"}'),
        '[{"score": 2}]': (2, '[{"score": 2}]'),
    }
    got = column(spark, cases, replies.parse_verdict)
    assert [(r["score"], r["reason"]) for r in got] == list(cases.values())


def test_generated_questions(spark):
    cases = {
        '{"question": "q", "category": "factual"}': ("q", "factual"),
        '```\n{"question": "q", "category": "multi_hop", "skip": []}\n```': ("q", "multi_hop"),
        '{"skip": true, "question": "q", "category": "factual"}': None,
        '{"skip": "x", "question": "q", "category": "factual"}': None,
        '{"question": "q"}': None,
        '{"question": "q", "category": "else"}': None,
        "[1]": None,
        "oops": None,
    }
    got = column(spark, cases, replies.parse_question)
    assert [None if r is None else (r["question"], r["category"]) for r in got] == list(cases.values())


def test_insufficient(spark):
    cases = {
        "<INSUFFICIENT_CONTEXT>": True,
        "  `\"<INSUFFICIENT_CONTEXT>\"` ": True,
        "<INSUFFICIENT_CONTEXT> sorry": True,
        "well, <INSUFFICIENT_CONTEXT>": False,
        "": False,
    }
    assert column(spark, cases, replies.is_insufficient) == list(cases.values())


def test_search_arguments(spark):
    cases = {'{"query": " a ", "k": 50}': ("a", 50), '{"k": "7"}': ("", 7), "{}": ("", 5), '{"query": "q", "k": 2.9}': ("q", 2)}
    got = column(spark, cases, replies.search_arguments)
    assert [(r["query"], r["k"]) for r in got] == list(cases.values())


def test_citation(spark):
    df = spark.createDataFrame([("_gh/r/pr/7",), ("_gh/r/issues/8",), ("_gh/o/r/pr/7",), ("a/b.py",)], "p string")
    got = [r[0] for r in df.select(layout.citation(F.col("p"), F.lit(1), F.lit(2), "own")).collect()]
    assert got == ["https://github.com/own/r/pull/7", "https://github.com/own/r/issues/8", "_gh/o/r/pr/7:1-2", "a/b.py:1-2"]


def test_hashed_embedding_has_length_one(spark):
    got = column(spark, ["alpha beta beta", ""], embedding.hashed_embedding)
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and len(got[0]) == 64
    assert got[1] == [0.0] * 64

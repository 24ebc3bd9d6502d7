import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.operators import metrics, summary

CELLS = "method string, run int, qid string, expected_paths array<string>, expected_symbols array<string>"
HITS = "method string, run int, qid string, rank int, source_path string, symbol string"


def score(spark, cells, hits):
    rows = metrics.score_cells(spark.createDataFrame(cells, CELLS), spark.createDataFrame(hits, HITS)).collect()
    return {r["qid"]: r for r in rows}


def test_golden_scores(spark):
    hits = [("m", 0, q, 0, "c/q.py", "") for q in "abcd"] + [("m", 0, q, 1, "src/a/x.py", "X.run") for q in "abcd"]
    got = score(
        spark,
        [
            ("m", 0, "a", ["a/x.py", "b/"], None),
            ("m", 0, "b", [], []),
            ("m", 0, "c", ["a/x.py"], ["Y"]),
            ("m", 0, "d", ["a/x.py", "a/x.py"], ["X.", "run", "Z"]),
            ("m", 0, "none", ["a"], ["b"]),
        ],
        hits,
    )
    a = got["a"]
    assert (a["p_hit_at_1"], a["p_hit_at_3"], a["p_hit_at_10"], a["p_mrr"], a["path_coverage"]) == (0, 1, 1, 0.5, 0.5)
    assert (a["hit_at_3"], a["mrr"], a["num_hits_in_topk"], a["symbol_coverage"]) == (1, 0.5, 1, 1.0)
    assert a["hit_paths"] == ["c/q.py", "src/a/x.py"]
    b = got["b"]
    assert (b["p_hit_at_10"], b["hit_at_10"], b["path_coverage"], b["symbol_coverage"]) == (0, 0, 1.0, 1.0)
    assert (got["c"]["hit_at_10"], got["c"]["p_hit_at_10"], got["c"]["symbol_coverage"]) == (0, 1, 0.0)
    assert (got["d"]["path_coverage"], round(got["d"]["symbol_coverage"], 6)) == (1.0, 0.666667)
    none = got["none"]
    assert (none["mrr"], none["p_mrr"], none["path_coverage"], none["hit_paths"]) == (0.0, 0.0, 0.0, [])


def plain_score(paths, syms, hits):
    ok_path = [any(p in h[0] for p in paths) for h in hits]
    ok = [p and (not syms or any(s in h[1] for s in syms)) for p, h in zip(ok_path, hits)]
    first = next((i for i, x in enumerate(ok) if x), None)
    p_first = next((i for i, x in enumerate(ok_path) if x), None)
    cover = lambda want, at: sum(any(w in h[at] for h in hits) for w in want) / len(want) if want else 1.0
    return (
        [int(first is not None and first < n) for n in (1, 3, 10)] + [int(p_first is not None and p_first < n) for n in (1, 3, 10)],
        1 / (first + 1) if first is not None else 0.0, sum(ok), cover(paths, 0), cover(syms or [], 1),
    )


names = st.text("ab/", min_size=1, max_size=3)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.lists(names, max_size=3), st.one_of(st.none(), st.lists(names, max_size=2)), st.lists(st.tuples(names, names), max_size=12)),
        min_size=20, max_size=20,
    )
)
def test_scores_equal_a_plain_loop(spark, cases):
    cells = [("m", 0, str(i), paths, syms) for i, (paths, syms, _) in enumerate(cases)]
    hits = [("m", 0, str(i), r, p, s) for i, (_, _, found) in enumerate(cases) for r, (p, s) in enumerate(found)]
    got = score(spark, cells, hits)
    for i, case in enumerate(cases):
        r = got[str(i)]
        depths = [r[f"{p}hit_at_{n}"] for p in ("", "p_") for n in (1, 3, 10)]
        assert (depths, r["mrr"], r["num_hits_in_topk"], r["path_coverage"], r["symbol_coverage"]) == plain_score(*case)
        assert r["hit_at_1"] <= r["hit_at_3"] <= r["hit_at_10"] <= r["p_hit_at_10"]


def facts(spark, rows):
    df = spark.createDataFrame(rows, "method string, category string, run int, v double, judge_score int")
    return df.select("*", *[F.col("v").alias(m) for m in metrics.FACT_METRICS if m != "judge_score"])


def test_mean_and_deviation_over_runs(spark):
    got = {
        r["method"]: r
        for r in summary.by_method(
            facts(
                spark,
                [
                    ("two", "c", 0, 0.4, 2), ("two", "c", 1, 0.6, None), ("one", "c", 0, 0.4, None), ("one", "d", 0, 0.4, None),
                    ("zero", "c", 0, 1.0, 0),
                ],
            ),
            rounded=False,
        ).collect()
    }
    two, one = got["two"], got["one"]
    assert (two["n_questions"], two["n_runs"], round(two["mrr_mean"], 6), round(two["mrr_std"], 6)) == (1, 2, 0.5, 0.141421)
    assert (two["judge_score_mean"], two["judge_score_std"]) == (2.0, 0.0)
    assert (one["n_questions"], one["mrr_mean"], one["mrr_std"], one["judge_score_mean"]) == (2, 0.4, 0.0, None)
    assert got["zero"]["judge_score_mean"] is None


def test_categories_and_printing(spark):
    table = facts(spark, [("m", "c", 0, 0.25, 1), ("m", "c", 1, 0.75, 2), ("m", "d", 0, 1.0, None), ("m", "d", 1, 1.0, 3)])
    got = {r["category"]: (r["n"], r["mrr"]) for r in summary.by_category(table).collect()}
    assert got == {"c": (1, 0.5), "d": (1, 1.0)}
    card = summary.printable(summary.scorecard(summary.by_method(table), summary.STRICT_CARD), summary.STRICT_CARD).first()
    assert (card["Q"], card["mrr"]) == (2, "0.75±0.18")  # run means 0.625 and 0.875


@pytest.mark.parametrize("runs", [1, 3])
def test_cells(spark, runs):
    questions = spark.createDataFrame([("q1",), ("q2",)], "qid string")
    assert metrics.evaluation_cells(questions, ["a", "b"], runs).distinct().count() == 4 * runs

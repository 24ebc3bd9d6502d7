"""Values that the SQL twins share with the code, spelled out once more."""

from gleaner.functions import replies, text
from gleaner.operators import metrics, summary

STOP = (
    "a an and are as at be been but by class cls def did do does false for from had has have if in is it its no none "
    "not of on or return self that the this to true was were with"
)


def test_stop_words():
    assert sorted(text.STOP_WORDS) == STOP.split()


def test_metrics_and_cards():
    assert list(metrics.FACT_METRICS) == (
        "hit_at_1 hit_at_3 hit_at_10 mrr p_hit_at_1 p_hit_at_3 p_hit_at_10 p_mrr path_coverage symbol_coverage judge_score"
    ).split()
    assert list(summary.PATH_CARD) == "p_hit_at_1 p_hit_at_3 p_hit_at_10 p_mrr path_coverage judge_score".split()
    assert list(summary.STRICT_CARD) == "hit_at_1 hit_at_3 hit_at_10 mrr symbol_coverage".split()


def test_categories_and_marks():
    assert replies.CATEGORIES == ("factual", "where_is", "conceptual", "multi_hop")
    assert replies.INSUFFICIENT == "<INSUFFICIENT_CONTEXT>"

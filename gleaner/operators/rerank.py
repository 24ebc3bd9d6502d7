"""Re-ordering of hits by a scorer, with pinned hits left in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions.arrays import let
from gleaner.operators.joins import top_ranked

# A scorer reads (question, text) and returns a double; a model goes in as a pandas UDF.
Scorer = Callable[[Column, Column], Column]

REMOTE_TEXT_CHARS = 4000


def overlap_scorer(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that occur in the text."""
    return let(
        F.array_distinct(tx.tokens(question)),
        lambda asked: F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(
            F.size(F.array_intersect(asked, tx.tokens(text))).cast("double") / F.size(asked)
        ),
    )


def best_scored(
    hits: DataFrame,
    k: int,
    scorer: Scorer = overlap_scorer,
    tag: str = "rerank",
    text_chars: int | None = None,
) -> DataFrame:
    """hits(qid, question, rank, chunk_idx, text, score, source, pinned) -> the k best without text, + rerank_score.

    Pinned hits stay first and are not scored; the rest is ordered by the
    scorer, equal scores by their earlier rank, and all is cut to k.  None for
    `text_chars` shows the scorer whole texts.  Texts are scored where they are:
    only ids and scores are brought together.
    """
    text = F.col("text") if text_chars is None else F.substring("text", 1, text_chars)
    scored = hits.withColumn(
        "rerank_score", F.when(~F.col("pinned"), scorer(F.col("question"), text))
    ).withColumn(
        "source",
        F.when(F.col("pinned") | F.col("source").contains(tag), F.col("source")).otherwise(
            F.concat("source", F.lit("+" + tag))
        ),
    )
    order = [
        F.col("pinned").desc(),
        F.round("rerank_score", 9).desc_nulls_last(),
        F.col("prior_rank"),
    ]
    return top_ranked(scored.drop("text").withColumnRenamed("rank", "prior_rank"), ["qid"], order, k).drop("prior_rank")

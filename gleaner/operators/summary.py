"""Evaluation facts summed up by method and by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.metrics import FACT_METRICS

CATEGORY_METRICS = ("hit_at_3", "mrr", "path_coverage")
# Fixed values.
DIGITS = 3
JUDGE_DIGITS = 2


def by_method(facts: DataFrame, rounded: bool = True) -> DataFrame:
    """Mean and sample deviation of the per-run means, one row per method.

    A metric that is null in a cell is left out of that run's mean; a single
    run has deviation zero; a judge mean of zero counts as no verdict.
    """
    runs = facts.groupBy("method", "run").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in FACT_METRICS]
    )
    columns: list[Column] = [
        F.floor(F.sum("n") / F.count(F.lit(1))).cast("bigint").alias("n_questions"),
        F.count(F.lit(1)).alias("n_runs"),
    ]
    for m in FACT_METRICS:
        columns.append(F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean"))
        columns.append(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))
    out = runs.groupBy("method").agg(*columns)
    judged = F.col("judge_score_mean") != 0
    out = out.withColumn("judge_score_std", F.when(judged, F.col("judge_score_std"))).withColumn(
        "judge_score_mean", F.when(judged, F.col("judge_score_mean"))
    )
    if not rounded:
        return out
    return out.select(
        "method",
        "n_questions",
        "n_runs",
        *[
            F.round(f"{m}_{part}", JUDGE_DIGITS if m == "judge_score" else DIGITS).alias(f"{m}_{part}")
            for m in FACT_METRICS
            for part in ("mean", "std")
        ],
    )


def by_category(facts: DataFrame, rounded: bool = True) -> DataFrame:
    """Mean over all runs of three metrics, one row per method and category."""
    runs = facts.groupBy("method", "category", "run").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in CATEGORY_METRICS]
    )
    total = F.sum("n")

    def shown(m: str) -> Column:
        mean = F.sum(m) / total
        return (F.round(mean, DIGITS) if rounded else mean).alias(m)

    return runs.groupBy("method", "category").agg(
        F.floor(total / F.count(F.lit(1))).cast("bigint").alias("n"), *[shown(m) for m in CATEGORY_METRICS]
    )


PATH_CARD = ("p_hit_at_1", "p_hit_at_3", "p_hit_at_10", "p_mrr", "path_coverage", "judge_score")
STRICT_CARD = ("hit_at_1", "hit_at_3", "hit_at_10", "mrr", "symbol_coverage")


def scorecard(summary: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """The columns of one card: method, n_questions, and mean and std of its metrics."""
    return summary.select(
        "method", "n_questions", "n_runs", *[f"{m}_{part}" for m in metrics for part in ("mean", "std")]
    )


def printable(card: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """A card as text: two decimals, with the deviation where there were several runs."""

    def cell(m: str) -> Column:
        mean, std = F.col(f"{m}_mean"), F.col(f"{m}_std")
        alone = F.format_string("%.2f", mean)
        both = F.format_string("%.2f±%.2f", mean, std)
        return F.when(mean.isNull(), "—").when(F.col("n_runs") > 1, both).otherwise(alone).alias(m)

    return card.select("method", F.col("n_questions").alias("Q"), *[cell(m) for m in metrics])

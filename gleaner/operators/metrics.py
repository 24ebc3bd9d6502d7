"""Scores of ranked hits against the paths and symbols a question expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("method", "run", "qid")
HIT_DEPTHS = (1, 3, 10)
FACT_METRICS = (
    "hit_at_1", "hit_at_3", "hit_at_10", "mrr",
    "p_hit_at_1", "p_hit_at_3", "p_hit_at_10", "p_mrr",
    "path_coverage", "symbol_coverage", "judge_score",
)


def matched_positions(value: Column, expected: Column) -> Column:
    """Positions of the expected substrings found in the value (literally, no patterns)."""
    found = F.transform(expected, lambda e, i: F.when(F.contains(F.coalesce(value, F.lit("")), e), i))
    return F.coalesce(F.array_compact(found), F.array().cast("array<int>"))


def hit_flags(hits: DataFrame) -> DataFrame:
    """hits(source_path, symbol, expected_paths, expected_symbols)
    + path_found, symbol_found (positions), path_hit, strict_hit.

    Without expected symbols every symbol will do; without expected paths
    nothing is a hit.
    """
    wants_symbol = F.coalesce(F.size("expected_symbols") > 0, F.lit(False))
    return (
        hits.withColumn("path_found", matched_positions(F.col("source_path"), F.col("expected_paths")))
        .withColumn("symbol_found", matched_positions(F.col("symbol"), F.col("expected_symbols")))
        .withColumn("path_hit", F.size("path_found") > 0)
        .withColumn("strict_hit", F.col("path_hit") & (~wants_symbol | (F.size("symbol_found") > 0)))
    )


def evaluation_cells(questions: DataFrame, methods: list[str], runs: int = 1) -> DataFrame:
    """Every question once per method and run."""
    return questions.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).withColumn(
        "run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    )


def _coverage(found: str, expected: str) -> Column:
    distinct = F.size(F.array_distinct(F.flatten(F.collect_list(found))))
    wanted = F.coalesce(F.first(F.size(expected)), F.lit(0))
    return F.when(wanted > 0, distinct / wanted).otherwise(F.lit(1.0))


def score_cells(cells: DataFrame, hits: DataFrame) -> DataFrame:
    """cells(method, run, qid, expected_paths, expected_symbols, ...), hits(method, run, qid, rank, source_path, symbol)
    -> one row per cell with all metrics; a cell without hits scores zero.
    """
    given = [c for c in cells.columns if c not in CELL]
    found = hit_flags(cells.join(hits.select(*CELL, "rank", "source_path", "symbol"), list(CELL), "left"))
    strict = F.min(F.when(F.col("strict_hit"), F.col("rank")))
    by_path = F.min(F.when(F.col("path_hit"), F.col("rank")))
    paths = F.array_sort(
        F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", F.coalesce("source_path", F.lit("")).alias("path"))))
    )
    per_cell = found.groupBy(*CELL).agg(
        *[F.first(c).alias(c) for c in given],
        strict.alias("first_strict"),
        by_path.alias("first_path"),
        F.coalesce(F.sum(F.col("strict_hit").cast("int")), F.lit(0)).cast("int").alias("num_hits_in_topk"),
        _coverage("path_found", "expected_paths").alias("path_coverage"),
        _coverage("symbol_found", "expected_symbols").alias("symbol_coverage"),
        paths.alias("paths"),
    )

    def rank_metrics(prefix: str, first: str) -> list[Column]:
        depth = [
            F.coalesce((F.col(first) < n).cast("int"), F.lit(0)).alias(f"{prefix}hit_at_{n}") for n in HIT_DEPTHS
        ]
        return [*depth, F.coalesce(1.0 / (F.col(first) + 1), F.lit(0.0)).cast("double").alias(f"{prefix}mrr")]

    return per_cell.select(
        *CELL,
        *given,
        *rank_metrics("", "first_strict"),
        "num_hits_in_topk",
        *rank_metrics("p_", "first_path"),
        "path_coverage",
        "symbol_coverage",
        F.transform("paths", lambda p: p["path"]).alias("hit_paths"),
    )

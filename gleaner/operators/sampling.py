"""Seeded samples and the filter for chunks worth a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import MODULE_SYMBOL

# Fixed values.
MIN_TEXT_CHARS = 200
TEST_MARKS = ("/tests/", "/test_")
SKIPPED_PREFIXES = ("tests/", "dev/", "devel-common/")


def shuffled_order(seed: int, key: str) -> list[Column]:
    """The same pseudo-random order on every run and every cluster."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(*shuffled_order(seed, key)).limit(n)


def worth_asking(chunks: DataFrame) -> DataFrame:
    """Substantial chunks with a real symbol, outside tests and development tools."""
    path = F.col("source_path")
    unwanted = F.lit(False)
    for mark in TEST_MARKS:
        unwanted = unwanted | F.contains(path, F.lit(mark))
    for prefix in SKIPPED_PREFIXES:
        unwanted = unwanted | F.startswith(path, F.lit(prefix))
    return chunks.where(
        (F.coalesce("symbol", F.lit("")) != "")
        & (F.col("symbol") != MODULE_SYMBOL)
        & (F.col("kind") != "class_header")
        & ~unwanted
        & (F.length("text") >= MIN_TEXT_CHARS)
    )


def question_sources(chunks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first n chunks of the shuffled order that are worth a question.

    The filter comes first and only ids are ordered; the texts are read for
    the drawn ids alone.
    """
    drawn = hash_sample(worth_asking(chunks).select("chunk_id"), n, "chunk_id", seed)
    return chunks.join(drawn, "chunk_id", "left_semi")

"""Connected components of a graph given by its edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import durable

MAX_ROUNDS = 60


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (a, b) with b the smallest vertex of a's component, a not b.

    Alternates the large-star and the small-star step until the edges stay as
    they are: a number of rounds about logarithmic in the vertices.  A vertex
    with very many edges is only joined with its smallest neighbour, one row,
    so its edges may lie in several tasks.  Every round is written.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = durable(edges.where("a != b").select(larger, smaller).distinct())
    seen = _print(now)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            return now
        now = durable(_small_star(_large_star(now)))
        last, seen = seen, _print(now)
        if last == seen:
            return now
    raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")


def _print(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = edges.select(F.explode(ways).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    both = edges.join(least, "a").select(F.explode(pairs).alias("e")).select("e.*")
    return both.where("a != b").distinct()

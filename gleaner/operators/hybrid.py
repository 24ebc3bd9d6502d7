"""Reciprocal-rank fusion of the two legs, with exact symbol matches pinned first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.joins import top_ranked

# Fixed values of the fusion rule.
RRF_K = 60
PIN_LIMIT = 3
GENERIC_MATCHES = 5
MIN_FETCH = 60
FETCH_FACTOR = 10
MIN_RERANK_POOL = 30
RERANK_POOL_FACTOR = 5


def pool_size(k: int, widen: bool) -> int:
    """Hits kept before re-ranking: only a widening re-ranker sees more than k."""
    return max(RERANK_POOL_FACTOR * k, MIN_RERANK_POOL) if widen else k


def fetch_size(pool: int) -> int:
    return max(FETCH_FACTOR * pool, MIN_FETCH)


def pin_budget(k: int) -> int:
    return max(1, min(PIN_LIMIT, k // 3))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (RRF_K + rank), F.lit(0.0))


def _lists(leg: DataFrame, name: str) -> DataFrame:
    rows = F.struct(*[c for c in leg.columns if c != "qid"])
    return leg.groupBy("qid").agg(F.collect_list(rows).alias(name))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, vector_tag: str = "vector") -> DataFrame:
    """Sum 1 / (60 + rank) over both legs.

    vector_hits(qid, rank, chunk_idx), keyword_hits(qid, rank, chunk_idx, injected, searchable)
    -> (qid, chunk_idx, score, vector_rank, keyword_rank, injected_rank, tags).
    A chunk injected for a question without tokens is no keyword hit, but can be pinned.
    """
    near = vector_hits.select("qid", "chunk_idx", F.col("rank").alias("vector_rank"))
    words = keyword_hits.select(
        "qid",
        "chunk_idx",
        F.when(F.col("searchable"), F.col("rank")).alias("keyword_rank"),
        F.when(F.col("injected"), F.col("rank")).alias("injected_rank"),
    )
    # Both legs arrive partitioned by question.  As lists of bounded length they
    # are joined, opened and grouped under that one partitioning.
    both = _lists(near, "near").join(_lists(words, "words"), "qid", "full")
    none = F.lit(None).cast("int")
    hits = F.concat(
        F.transform(
            F.coalesce("near", F.array()),
            lambda h: F.struct(h["chunk_idx"].alias("chunk_idx"), h["vector_rank"].alias("v"), none.alias("w"), none.alias("i")),
        ),
        F.transform(
            F.coalesce("words", F.array()),
            lambda h: F.struct(
                h["chunk_idx"].alias("chunk_idx"), none.alias("v"), h["keyword_rank"].alias("w"), h["injected_rank"].alias("i")
            ),
        ),
    )
    fused = (
        both.select("qid", F.explode(hits).alias("h"))
        .groupBy("qid", F.col("h.chunk_idx").alias("chunk_idx"))
        .agg(
            F.max("h.v").alias("vector_rank"), F.max("h.w").alias("keyword_rank"), F.max("h.i").alias("injected_rank")
        )
    )
    return fused.withColumn(
        "score", reciprocal(F.col("vector_rank")) + reciprocal(F.col("keyword_rank"))
    ).withColumn(
        "tags",
        F.array_compact(
            F.array(
                F.when(F.col("vector_rank").isNotNull(), F.lit(vector_tag)),
                F.when(F.col("keyword_rank").isNotNull(), F.lit("bm25")),
            )
        ),
    )


def pin_and_cut(fused: DataFrame, k: int, pool: int, pin: bool = True) -> DataFrame:
    """Order the fused hits and keep `pool` per question.

    A name that matches more than five chunks is generic and pins nothing.
    Equal scores keep the order of first appearance: vector leg, then keyword leg.
    -> (qid, rank, chunk_idx, score, source, pinned).
    """
    if pin:
        # The keyword leg is long enough to hold more than five injected chunks.
        named = F.count("injected_rank").over(Window.partitionBy("qid"))
        fused = fused.withColumn("_named", named).withColumn(
            "pinned",
            F.coalesce(
                (F.col("injected_rank") < pin_budget(k)) & (F.col("_named") <= GENERIC_MATCHES), F.lit(False)
            ),
        )
    else:
        fused = fused.withColumn("pinned", F.lit(False))
    tags = F.when(F.col("pinned"), F.array_append("tags", F.lit("symbol"))).otherwise(F.col("tags"))
    order = [
        F.col("pinned").desc(),
        F.when(F.col("pinned"), F.col("injected_rank")).asc_nulls_last(),
        F.round("score", 12).desc(),
        F.col("vector_rank").asc_nulls_last(),
        F.col("keyword_rank").asc_nulls_last(),
    ]
    kept = fused.where("pinned OR vector_rank IS NOT NULL OR keyword_rank IS NOT NULL")
    return top_ranked(kept, ["qid"], order, pool).select(
        "qid",
        "rank",
        "chunk_idx",
        "score",
        F.array_join(F.array_sort(tags), "+").alias("source"),
        "pinned",
    )

"""Retrieval queries: keyword, vector and hybrid search."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import sql, views
from gleaner.operators import hybrid, keyword, vector
from gleaner.operators.joins import estimated_bytes
from gleaner.operators.keyword import KeywordIndex
from gleaner.operators.vector_index import VectorIndex, centroids
from gleaner.session import checkpoint_dir
from gleaner.sources.store import read_keywords, sized_shards, write_keywords

K = 10
_indexes: dict[tuple[str, str], KeywordIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The stored keyword index of all documents, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        name = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
        root = f"{checkpoint_dir(spark)}/gleaner/{spark.sparkContext.applicationId}/{name}"
        size = estimated_bytes(views.table(spark, sf_dir, "documents"))
        shards = max(spark.sparkContext.defaultParallelism, sized_shards(size))
        gen = time.time_ns()  # a new generation, should an earlier attempt have died half-way
        write_keywords(views.corpus(spark, sf_dir), root, gen, shards, size)
        _indexes[key] = read_keywords(spark, root, [gen], shards)
    return _indexes[key]


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = keyword.bm25_scores(views.questions(spark, sf_dir), index(spark, sf_dir), K)
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), "chunk_idx", F.round("score", 6).alias("score"))


def bm25_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = keyword.keyword_search(views.named_questions(spark, sf_dir), index(spark, sf_dir), K)
    return hits.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "chunk_idx", F.round("score", 6).alias("score"), "injected"
    )


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), "embedding")
    hits = vector.nearest(vectors, views.question_vectors(spark, sf_dir), K)
    return hits.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "chunk_idx", F.round("similarity", 6).alias("similarity")
    )


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through stored cells of vectors, as many as make it exact."""
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), "embedding")
    root = f"{checkpoint_dir(spark)}/gleaner/{spark.sparkContext.applicationId}/cells-{time.time_ns()}"
    centre = centroids(vectors)
    VectorIndex.write(vectors, root, centre)
    hits, _ = VectorIndex.read(spark, centre, [root]).search(views.question_vectors(spark, sf_dir), K)
    return hits.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "chunk_idx", F.round("similarity", 6).alias("similarity")
    )


def hybrid_hits(spark: SparkSession, sf_dir: str, k: int, widen: bool = False, named: bool = True, pin: bool = True) -> DataFrame:
    pool = hybrid.pool_size(k, widen)
    fetch = hybrid.fetch_size(pool)
    asked = views.named_questions(spark, sf_dir) if named else views.questions(spark, sf_dir)
    near = vector.nearest(views.corpus_vectors(spark, sf_dir), views.question_vectors(spark, sf_dir), fetch)
    words = keyword.keyword_leg(asked, index(spark, sf_dir), fetch)
    return hybrid.pin_and_cut(hybrid.fuse(near, words), k, pool, pin)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "chunk_idx", F.round("score", 9).alias("score"), "source"
    )


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(hybrid_hits(spark, sf_dir, 6, named=False, pin=False))


def hybrid_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(hybrid_hits(spark, sf_dir, 6))


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_injected": bm25_injected,
    "vector_topk": vector_topk,
    "vector_index_topk": vector_index_topk,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_pinned": hybrid_pinned,
}

_KEYWORD = (sql.CORPUS, sql.INDEXED)
# Plain vector search reads every vector, those without a document, too.
_ALL_VECTORS = sql.VECTORS.replace(" WHERE vec_id IN (SELECT doc_id FROM documents)", "")
NAMED = sql.ctes(*_KEYWORD, sql.NAMED_QUESTIONS, sql.NAMES, sql.SYMBOLS, sql.INJECT, sql.scores())
PLAIN = sql.ctes(*_KEYWORD, sql.QUESTIONS, sql.NAMES, sql.SYMBOLS, sql.INJECT, sql.scores())


def named_hybrid(k: int, pool: int, fetch: int) -> str:
    return ",\n".join((NAMED, sql.keyword_leg(fetch), sql.VECTORS, sql.vector_leg(fetch), sql.hybrid(k, pool)))


ORACLES = {
    "bm25_topk": sql.ctes(*_KEYWORD, sql.QUESTIONS, sql.scores("questions")) + f"""
SELECT qid, rank, chunk_idx, round(score, 6) AS score FROM (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_idx) - 1 AS rank, chunk_idx, score
  FROM scored WHERE score > 0) WHERE rank < {K}""",
    "bm25_injected": f"{NAMED},{sql.keyword_leg(K)}\nSELECT qid, rank, chunk_idx, round(score, 6) AS score, injected FROM kleg",
    "vector_topk": f"{sql.ctes(_ALL_VECTORS, sql.vector_leg(K))}\nSELECT qid, rank, chunk_idx, round(similarity, 6) AS similarity FROM vleg",
    "vector_index_topk": f"{sql.ctes(_ALL_VECTORS, sql.vector_leg(K))}\nSELECT qid, rank, chunk_idx, round(similarity, 6) AS similarity FROM vleg",
    "hybrid_rrf": ",\n".join((PLAIN, sql.keyword_leg(60), sql.VECTORS, sql.vector_leg(60), sql.hybrid(6, 6, pin=False)))
    + "\nSELECT qid, rank, chunk_idx, round(score, 9) AS score, source FROM hyb",
    "hybrid_pinned": named_hybrid(6, 6, 60) + "\nSELECT qid, rank, chunk_idx, round(score, 9) AS score, source FROM hyb",
}

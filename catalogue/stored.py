"""The stored corpus through its own interface: ingests, known ids, index, rebuild."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import sql, views
from gleaner.session import checkpoint_dir
from gleaner.sources.store import Store


def _lengths(store: Store, name: str) -> DataFrame:
    return store.keywords().postings.groupBy("chunk_idx").agg(F.max("dl").cast("bigint").alias(name))


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after two overlapping ingests, with its indexed length before and after a rebuild."""
    store = Store(spark, f"{checkpoint_dir(spark)}/gleaner/{spark.sparkContext.applicationId}/roundtrip-{time.time_ns()}")
    docs = views.corpus(spark, sf_dir)
    order = [F.col("source_path")]
    store.add(docs.where("chunk_idx % 2 = 0").drop("chunk_idx"), order)
    store.add(docs.drop("chunk_idx"), order)
    appended = _lengths(store, "n_appended")
    store.rebuild_keywords()
    chunks = store.chunks().select("chunk_idx", "chunk_id", F.md5("text").alias("digest"))
    return (
        chunks.join(appended, "chunk_idx", "left")
        .join(_lengths(store, "n_rebuilt"), "chunk_idx", "left")
        .select("chunk_id", "digest", "n_appended", "n_rebuilt")
    )


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after three ingests whose generations were merged, with its indexed length."""
    store = Store(spark, f"{checkpoint_dir(spark)}/gleaner/{spark.sparkContext.applicationId}/compacted-{time.time_ns()}")
    docs = views.corpus(spark, sf_dir)
    for part in range(3):
        store.add(docs.where(F.col("chunk_idx") % 3 <= part).drop("chunk_idx"), [F.col("source_path")])
    store.compact(fanout=2)
    chunks = store.chunks().select("chunk_idx", "chunk_id", F.md5("text").alias("digest"))
    return chunks.join(_lengths(store, "n_indexed"), "chunk_idx", "left").select("chunk_id", "digest", "n_indexed")


QUERIES = {"store_roundtrip": store_roundtrip, "store_compacted": store_compacted}

_STORED = f"""{sql.ctes(sql.CORPUS, sql.INDEXED)},
{sql.tokens("it", "indexed", "chunk_idx", "body")},
dl AS (SELECT chunk_idx, count(*) AS n FROM it GROUP BY 1)"""

ORACLES = {
    "store_compacted": f"""{_STORED}
SELECT chunk_id, md5(text) AS digest, n AS n_indexed FROM corpus c LEFT JOIN dl ON dl.chunk_idx = c.chunk_idx""",
    "store_roundtrip": f"""{_STORED}
SELECT chunk_id, md5(text) AS digest, n AS n_appended, n AS n_rebuilt FROM corpus c LEFT JOIN dl ON dl.chunk_idx = c.chunk_idx""",
}

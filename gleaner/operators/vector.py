"""Exact nearest neighbours by cosine for many query vectors at once.

Each task multiplies its slice of the vectors with all query vectors and hands
on only its own k best per query, so neither the pairs nor the corpus are
shuffled.  Ranking uses the similarity rounded to nine digits, then the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.joins import BROADCAST_BYTES, many_tasks, top_ranked

BROADCAST_QUERIES = 20_000
QUERY_SLICE = 512
CELL_VECTORS = 50_000
CELL_QUERIES = 50_000
DIGITS = 9


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


class _Best:
    """The k best (query, id, similarity) seen so far, for all queries of a task."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.inf)
        empty = np.empty(0, dtype=np.int64)
        self.q, self.ids, self.sim = empty, empty, np.empty(0)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        found = [(self.q, self.ids, self.sim)]
        for start in range(0, len(self.queries), QUERY_SLICE):
            part = self.queries[start : start + QUERY_SLICE]
            sim = np.round(part @ vectors.T, DIGITS)
            floor = self.floor[start : start + QUERY_SLICE]
            if len(ids) > self.k:
                kth = np.partition(sim, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                floor = np.maximum(floor, kth)
            q, v = np.nonzero(sim >= floor[:, None])
            found.append((q + start, ids[v], sim[q, v]))
        q, ids, sim = (np.concatenate(col) for col in zip(*found))
        order = np.lexsort((ids, -sim, q))
        q, ids, sim = q[order], ids[order], sim[order]
        first = np.searchsorted(q, np.arange(len(self.queries)))
        place = np.arange(len(q)) - first[q]
        keep = place < self.k
        last = keep & (place == self.k - 1)
        self.floor[q[last]] = sim[last]
        self.q, self.ids, self.sim = q[keep], ids[keep], sim[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    broadcast_queries: int = BROADCAST_QUERIES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """vectors(chunk_idx, embedding), queries(qid, embedding)
    -> (qid, rank, chunk_idx, similarity), the k most similar per query."""
    vectors = vectors.select("chunk_idx", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    # One bounded read both fetches a small query table and finds out that it is small.
    table = queries.limit(broadcast_queries + 1).toArrow()
    if table.num_rows <= broadcast_queries and table.nbytes <= broadcast_bytes:
        local = _nearest_broadcast(vectors, table, k)
    else:
        local = _nearest_cells(vectors, queries, k)
    order = [F.col("similarity").desc(), F.col("chunk_idx")]
    return top_ranked(local, ["qid"], order, k, spread_by="chunk_idx" if many_tasks(vectors) else None).select(
        "qid", "rank", "chunk_idx", "similarity"
    )


def _nearest_broadcast(vectors: DataFrame, table: pa.Table, k: int) -> DataFrame:
    names = table.column("qid").to_pylist()
    matrix = _unit(_matrix(pa.concat_arrays(table.column("embedding").chunks)) if names else np.empty((0, 0)))
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))
    schema = "qid string, chunk_idx bigint, similarity double"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, wanted = shared.value
        if not qids:
            return
        best = _Best(wanted, k)
        for batch in batches:
            if batch.num_rows:
                best.offer(batch.column("chunk_idx").to_numpy(), _unit(_matrix(batch.column("embedding"))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(qids, dtype=object)[best.q], pa.string()), pa.array(best.ids), pa.array(best.sim)],
            names=["qid", "chunk_idx", "similarity"],
        )

    return vectors.mapInArrow(search, schema)


def _nearest_cells(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Too many queries to broadcast: meet in cells of bounded size.

    A cell joins one block of queries with one block of vectors; cells are
    independent tasks and each hands on its own k best.
    """
    query_blocks = max(1, math.ceil(queries.count() / CELL_QUERIES))
    vector_blocks = max(1, math.ceil(vectors.count() / CELL_VECTORS))
    placed_vectors = vectors.withColumn("vb", F.pmod(F.xxhash64("chunk_idx"), F.lit(vector_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    placed_queries = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int")).withColumn(
        "vb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(vector_blocks - 1).cast("bigint")))
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "chunk_idx": [], "similarity": []})
        best = _Best(_unit(np.stack(right["embedding"].to_numpy())), k)
        best.offer(left["chunk_idx"].to_numpy(), _unit(np.stack(left["embedding"].to_numpy())))
        return pd.DataFrame(
            {"qid": right["qid"].to_numpy()[best.q], "chunk_idx": best.ids, "similarity": best.sim}
        )

    return (
        placed_vectors.groupBy("qb", "vb")
        .cogroup(placed_queries.groupBy("qb", "vb"))
        .applyInPandas(meet, "qid string, chunk_idx bigint, similarity double")
    )

"""Packing chunks into embedding requests under a token budget."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.chunking import whitespace_tokens

# Fixed values.
FLUSH_BITS = 8  # 256 rows
REQUEST_TOKENS = 20_000


def request_batches(sized: DataFrame, budget: int = REQUEST_TOKENS) -> DataFrame:
    """sized(chunk_idx, n_tokens) -> (flush, batch, chunk_idx, n_tokens).

    Chunks are flushed 256 at a time, and each flush is packed in order: a
    batch closes when the next text would go over the budget.  The fold never
    sees more than one flush, so no group grows with the data.  Stored ids are
    dense within a block and a block starts a flush, so only the last flush of
    a block is short.
    """
    flushes = (
        sized.withColumn("flush", F.shiftright("chunk_idx", FLUSH_BITS))
        .groupBy("flush")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "n_tokens"))).alias("rows"))
    )
    start = F.struct(
        F.lit(0).alias("batch"),
        F.lit(0).cast("bigint").alias("used"),
        F.array().cast("array<int>").alias("batches"),
    )

    def add(acc, row):
        over = (F.size(acc["batches"]) > 0) & (acc["used"] + row["n_tokens"] > budget)
        batch = acc["batch"] + F.when(over, 1).otherwise(0)
        used = F.when(over, F.lit(0).cast("bigint")).otherwise(acc["used"]) + row["n_tokens"]
        return F.struct(batch.alias("batch"), used.alias("used"), F.array_append(acc["batches"], batch).alias("batches"))

    packed = flushes.withColumn("batches", F.aggregate("rows", start, add)["batches"])
    return packed.select("flush", F.explode(F.arrays_zip("rows", "batches")).alias("z")).select(
        "flush", F.col("z.batches").alias("batch"), "z.rows.chunk_idx", "z.rows.n_tokens"
    )


def batched_embeddings(
    chunks: DataFrame, embed_batch: Callable[[Sequence[str]], Sequence[Sequence[float]]], budget: int = REQUEST_TOKENS, pause: float = 0.0
) -> DataFrame:
    """chunks(chunk_idx, text) -> (chunk_idx, embedding), one provider call per packed request.

    Requests are those of `request_batches` over the same chunks.  A task waits
    `pause` seconds between two calls.
    """
    sized = chunks.select("chunk_idx", F.size(whitespace_tokens(F.col("text"))).alias("n_tokens"))
    placed = request_batches(sized, budget).join(chunks, "chunk_idx")
    ordered = placed.repartition("flush").sortWithinPartitions("flush", "batch", "chunk_idx").select("flush", "batch", "chunk_idx", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        calls = 0

        def request() -> pa.RecordBatch:
            nonlocal calls
            if calls and pause:
                time.sleep(pause)
            calls += 1
            vectors = embed_batch([r["text"] or "" for r in held])
            if len(vectors) != len(held):
                raise ValueError(f"{len(held)} texts were sent and {len(vectors)} vectors came back")
            ids = pa.array([r["chunk_idx"] for r in held], pa.int64())
            return pa.RecordBatch.from_arrays([ids, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=["chunk_idx", "embedding"])

        # A request ends with its number; rows of one may lie in two Arrow batches.
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["flush"], held[0]["batch"]) != (row["flush"], row["batch"]):
                    yield request()
                    held = []
                held.append(row)
        if held:
            yield request()

    return ordered.mapInArrow(run, "chunk_idx bigint, embedding array<float>")

"""Whole-number vectors in packed blocks, and queries that meet blocks in cells.

Rows are sorted and packed into blocks of bounded size; a block is one row of a
written table.  A directory with a line per block is small enough for every
task, because blocks grow with the table once there are too many of them.
Queries are planned against the directory, and only (query, block) pairs that a
bound cannot rule out are worked on, in cells of one block and a bounded number
of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.llm.common import written

SCALE = 256
#: Squared length from which products of two vectors may not fit a long.
LONGEST = float(1 << 62)
BLOCK_BYTES = 1 << 20
LEAST_ROWS, MOST_ROWS = 64, 4096
DIRECTORY_BYTES = 16 << 20
CELL_QUERIES = 1024
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(vec_id, vec, dim, ...): components as floor(256 * x).

    Null vectors, null or non-finite components, rows without an id, and vectors
    longer than 2 ** 31 after scaling (their products need not fit a long) go.
    """
    v = F.col("raw")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    squares = F.aggregate(v, F.lit(0.0), lambda total, x: total + F.floor(x * SCALE) * F.floor(x * SCALE).cast("double"))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"), *more
    ).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & (squares < LONGEST))
    names = [c for c in rows.columns if c not in ("vec_id", "raw")]
    whole = F.transform(v, lambda x: F.floor(x * SCALE).try_cast("int"))
    return rows.select("vec_id", whole.alias("vec"), F.size(v).alias("dim"), *names)


def block_rows(rows: int, dimension: int, line_bytes: int) -> int:
    """Rows of a block: about BLOCK_BYTES, more where the directory would outgrow its bound."""
    usual = min(max(BLOCK_BYTES // max(4 * dimension, 1), LEAST_ROWS), MOST_ROWS)
    return max(usual, -(-rows * line_bytes // DIRECTORY_BYTES))


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """A list column, all lists of one length, as rows of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimension)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which inner products of the rows are exact: doubles (fast), or longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float64 if most < EXACT else np.int64


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(1))


def packed(
    rows: DataFrame,
    order: Sequence[str],
    cut: Sequence[str],
    size: int,
    describe: Callable[[np.ndarray, dict[str, np.ndarray]], dict],
    described: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Sort (vec_id, vec, dim, ...) and pack runs of equal `cut` columns into blocks of at most `size` rows.

    -> (block, dim, ids, cells, <carry as lists>, <described>).  Ties of `order`
    are dealt by a hash of the id, so that no value fills a task of its own.
    """
    keys = [F.col(c) for c in order] + [F.xxhash64("vec_id"), F.col("vec_id"), F.col("vec")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*dict.fromkeys(["vec_id", "dim", "vec", *order, *cut, *carry]))
    lists = "".join(f", {c}_list array<{dict(rows.dtypes)[c]}>" for c in carry)
    schema = f"dim int, ids array<bigint>, cells array<int>{lists}, {described}"

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        column = {c: table.column(c).to_numpy() for c in table.column_names if c != "vec"}
        change = np.zeros(len(table), bool)
        for c in {"dim", *cut}:
            change[1:] |= column[c][1:] != column[c][:-1]
        starts = [0, *np.flatnonzero(change), len(table)]
        vec = table.column("vec").combine_chunks()
        for first, last in zip(starts, starts[1:]):
            dimension = int(column["dim"][first]) if last > first else 0
            for at in range(first, last, size):
                end = min(at + size, last)
                own = {c: v[at:end] for c, v in column.items()}
                cells = matrix(vec.slice(at, end - at), dimension)
                out = {"dim": dimension, "ids": own["vec_id"], "cells": cells.ravel().astype(np.int32)}
                out |= {f"{c}_list": own[c] for c in carry} | describe(cells, own)
                yield pa.RecordBatch.from_pylist([out], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 4 * size:
                # The last block of a stretch may be shorter than it could be.
                yield from whole(held)
                held, count = [], 0
        if count:
            yield from whole(held)

    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return written(placed.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()))


def meet(
    work: DataFrame, blocks: DataFrame, compute: Callable[[pa.Table, pa.Table], pa.Table], schema: str, queries: int = CELL_QUERIES
) -> DataFrame:
    """`compute` over every block with the queries that are sent to it, in cells of about `queries` queries.

    work(block, query_id, ...), blocks(block, ...).  Only blocks with work travel;
    one that many queries ask for is copied once per cell.
    """
    grid = work.groupBy("block").agg(F.ceil(F.count("*") / queries).cast("int").alias("chunks"))
    left = work.join(F.broadcast(grid), "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    right = blocks.join(F.broadcast(grid), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = ["block", "chunk"]
    return left.drop("chunks").groupBy(*cell).cogroup(right.drop("chunks").groupBy(*cell)).applyInArrow(compute, schema)

"""Exact largest inner products by a pivot-distance index.

Every row is filed under its nearest pivot and its distance from it; the rows of
a pivot, sorted by distance, are cut into annuli (`cells.packed`).  The triangle
inequality bounds what an annulus can offer a query: a row x at distance r from
the pivot p is at least |d(q, p) - r| from q, and

    q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2.

Each query takes the annuli in the order of that bound, a few in the first round
and four times as many in each later one, and stops before the first annulus
whose bound is below its k-th score.  Nothing is skipped otherwise, so results
are exact.

Pivots are chosen from a sample of at most SAMPLE rows; every row is indexed.
Vectors of another dimension than most use the origin as their pivot, and are
compared with vectors of their own dimension only.  Null vectors, null or
non-finite components, rows without an id, and vectors longer than 2 ** 31 after
scaling take no part.  Empty and zero vectors take part.  Rows that share the
query's id are not its candidates; of rows that share a query id, the smallest
vector asks.  Repeated rows are listed each.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import cells
from gleaner.llm.common import written

K = 5
#: Rows that pivots are chosen from, at most.
SAMPLE = 4096
MOST_PIVOTS = 256
ORIGIN = -1
FIRST_STEP, GROWTH = 1, 4
LINE_BYTES = 48
PLANNED = 1 << 20


def choose(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Pivots: means of the sample's rows nearest to them, started from spread rows."""
    if not len(sample) or count < 1:
        return np.empty((0, sample.shape[1] if sample.ndim == 2 else 0))
    points = sample.astype(np.float64)
    pivots = points[:: max(1, len(points) // count)][:count].copy()
    for _ in range(rounds):
        home = _distances(points, pivots).argmin(1)
        for p in range(len(pivots)):
            own = points[home == p]
            if len(own):
                pivots[p] = own.mean(0)
    return np.unique(pivots, axis=0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def filed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, vec, dim, pivot, distance): the nearest pivot of every row."""
    dimension = pivots.shape[1] if len(pivots) else -1
    schema = "vec_id bigint, vec array<int>, dim int, pivot int, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            pivot, distance = np.full(len(dims), ORIGIN, np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                own = cells.matrix(batch.column("vec").take(pa.array(at)), int(d)).astype(np.float64)
                if d == dimension:
                    # Differences, not products: small distances keep their digits.
                    home = _distances(own, pivots).argmin(1)
                    pivot[at], distance[at] = home, np.sqrt(((own - pivots[home]) ** 2).sum(1))
                else:
                    distance[at] = np.sqrt((own * own).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), batch.column("dim"), pa.array(pivot), pa.array(distance)],
                names=["vec_id", "vec", "dim", "pivot", "distance"],
            )

    return rows.select("vec_id", "vec", "dim").mapInArrow(run, schema)


def annuli(rows: DataFrame, size: int) -> DataFrame:
    def describe(own: np.ndarray, columns: dict[str, np.ndarray]) -> dict:
        distance = columns["distance"]
        longest = float((own.astype(np.float64) ** 2).sum(1).max(initial=0))
        return {"pivot": int(columns["pivot"][0]), "near": float(distance.min()), "far": float(distance.max()), "longest": longest}

    described = "pivot int, near double, far double, longest double"
    return cells.packed(rows, ["dim", "pivot", "distance"], ["pivot"], size, describe, described)


def bounds(vectors: np.ndarray, pivots: np.ndarray, lines: dict[str, np.ndarray]) -> np.ndarray:
    """No row of an annulus (column) has a larger product with a query (row)."""
    square = (vectors * vectors).sum(1)
    away = np.c_[_distances(vectors, pivots), np.sqrt(square)] if len(pivots) and pivots.shape[1] == vectors.shape[1] else np.sqrt(square)[:, None]
    away = away[:, lines["pivot"]]  # the origin, -1, is the last column
    slack = 1e-7 * (away + lines["far"] + 1)
    gap = np.maximum(np.maximum(away - lines["far"], lines["near"] - away) - slack, 0)
    total = square[:, None] + lines["longest"]
    most = np.minimum((total - gap * gap) / 2, np.sqrt(square)[:, None] * np.sqrt(lines["longest"]))
    return most + 1e-9 * total + 1e-3


def _plan(pivots: np.ndarray, directory: dict[str, np.ndarray], k: int, visited: int, step: int):
    """The next annuli of every query that may still hold one of its k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            best = batch.column("best")
            for d in np.unique(dims):
                own = np.flatnonzero(directory["dim"] == d)
                lines = {c: v[own] for c, v in directory.items()}
                at = np.flatnonzero(dims == d)
                for rows in np.array_split(at, -(-len(at) * max(len(own), 1) // PLANNED)):
                    if not len(own) or not len(rows):
                        continue
                    vectors = cells.matrix(batch.column("vec").take(pa.array(rows)), int(d)).astype(np.float64)
                    most = bounds(vectors, pivots, lines)
                    order = np.argsort(-most, axis=1, kind="stable")[:, visited : visited + step]
                    lists = [best[int(i)].as_py() for i in rows]
                    least = np.array([x[-1]["score"] if len(x) == k else -np.inf for x in lists])
                    q, place = np.nonzero(np.take_along_axis(most, order, 1) >= least[:, None])
                    if len(q):
                        picked = batch.select(["query_id", "dim", "vec"]).take(pa.array(rows[q]))
                        floor = pa.array(least[q], pa.float64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(lines["block"][order[q, place]]), *picked.columns, floor], names=["block", "query_id", "dim", "vec", "least"]
                        )

    return run


def _best(k: int):
    """The k best rows of an annulus for each query of a cell."""

    def run(work: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        if len(work) and len(blocks):
            dimension = blocks.column("dim")[0].as_py()
            ids = np.asarray(blocks.column("ids")[0].values)
            rows = np.asarray(blocks.column("cells")[0].values).astype(np.int64).reshape(len(ids), dimension)
            for at in range(0, len(work), 256):
                some = work.slice(at, 256)
                own = some.column("query_id").to_numpy()
                asked = cells.matrix(some.column("vec"), dimension)
                kind = cells.exact_type(asked, rows)
                score = asked.astype(kind) @ rows.astype(kind).T
                open_ = (own[:, None] != ids[None, :]) & (score >= some.column("least").to_numpy()[:, None])
                if len(ids) > k:
                    masked = np.where(open_, score, np.iinfo(np.int64).min if kind is np.int64 else -np.inf)
                    open_ &= masked >= np.partition(masked, len(ids) - k, axis=1)[:, len(ids) - k, None]
                q, r = np.nonzero(open_)
                order = np.lexsort((ids[r], -score[q, r], q))
                q, r = q[order], r[order]
                keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(own)))[q] < k
                q, r = q[keep], r[keep]
                found.append((own[q], ids[r], score[q, r].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def search(
    vectors: DataFrame,
    asks: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rows_per_block: int | None = None,
    first_step: int = FIRST_STEP,
) -> DataFrame:
    """(query_id, rank, vec_id, score, n_annuli) for the rows whose `vec_id` meets the condition.

    `n_annuli` is the number of annuli that were read for the query.
    """
    rows = cells.quantised(vectors, id_col, vector_col)
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    dimension, total = next(iter(sizes), 0), sum(sizes.values())
    sample = (
        rows.where(F.col("dim") == dimension).select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    )
    pivots = choose(cells.matrix(sample.column("vec"), dimension), min(max(int(total**0.5) // 4, 1), MOST_PIVOTS)) if len(sample) else np.empty((0, 0))
    size = rows_per_block or cells.block_rows(total, dimension, LINE_BYTES)
    blocks = annuli(filed(rows, pivots), size)
    # A line per annulus: their number is bounded by `block_rows`.
    table = blocks.select("block", "dim", "pivot", "near", "far", "longest").toArrow()
    directory = {c: table.column(c).to_numpy() for c in table.column_names}
    state = written(
        rows.where(asks)
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min(F.struct("dim", "vec")).alias("v"))
        .select(
            "query_id", "v.dim", "v.vec",
            F.array().cast("array<struct<order:bigint,vec_id:bigint,score:bigint>>").alias("best"), F.lit(0).cast("long").alias("n_annuli"),
        )
    )
    visited, step = 0, first_step
    while visited < max(len(table), 1):
        plan = state.mapInArrow(
            _plan(pivots, directory, k, visited, step), "block bigint, query_id bigint, dim int, vec array<int>, least double"
        )
        work = written(plan)
        if work.isEmpty():
            break
        found = cells.meet(work, blocks, _best(k), "query_id bigint, vec_id bigint, score bigint")
        # Scores may be the smallest long, so order by the complement, not by the negative.
        new = found.groupBy("query_id").agg(
            F.collect_list(F.struct(F.bitwise_not("score").alias("order"), "vec_id", "score")).alias("more")
        )
        read = work.groupBy("query_id").agg(F.count("*").alias("read"))
        both = F.concat("best", F.coalesce("more", F.array().cast("array<struct<order:bigint,vec_id:bigint,score:bigint>>")))
        state = written(
            state.join(new, "query_id", "left").join(read, "query_id", "left").select(
                "query_id", "dim", "vec", F.slice(F.sort_array(both), 1, k).alias("best"),
                (F.col("n_annuli") + F.coalesce("read", F.lit(0))).alias("n_annuli"),
            )
        )
        visited, step = visited + step, step * GROWTH
    return state.select("query_id", "n_annuli", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "b.vec_id", "b.score", "n_annuli"
    )

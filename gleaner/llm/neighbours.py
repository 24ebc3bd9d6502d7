"""Nearest neighbours through learned partitions.

On a bounded sample of the vectors a graph of nearest neighbours is cut into
balanced parts, and a small network learns to tell the part of a vector.  Every
row of the table is filed under its most probable part.  A query goes to
several of the most probable parts, and the rows there are ranked by their
exact distance.  How many parts are asked is set on the sample: as many as find
`RECALL` of the true neighbours of sample vectors that training did not see.

Parts are searched in cells of bounded rows and queries, however many rows fall
into one part.  A query is sent to further parts until they hold k rows beside
itself, so that it gets k answers if there are k.

Vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part.  Vectors of another dimension than most are
compared with each other, each dimension as a part of its own.  Rows that
share a query's id are not its neighbours; of rows that share a query id, the
smallest vector asks.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import durable

K = 10
PARTS = 32
#: Rows that the index is fitted on, at most.
SAMPLE = 8192
HIDDEN = 128
EPOCHS = 30
RECALL = 0.97
CELL_ROWS = 16384
CELL_QUERIES = 2048
SEED = 10


# -- fitting, on the sample --------------------------------------------------------


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    k = min(k, len(vectors) - 1)
    out = np.empty((len(vectors), k), np.int64)
    for at in range(0, len(vectors), 1024):
        far = _distances(vectors[at : at + 1024], vectors)
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        out[at : at + 1024] = np.argpartition(far, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(vectors: np.ndarray, edges: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Cut a neighbour graph into parts of about equal size with few edges between them.

    Halving along the widest direction gives the first parts; then rows move to
    the part that holds most of their neighbours, while it has room.
    """
    label = np.zeros(len(vectors), np.int64)
    for _ in range(int(np.log2(parts))):
        halves = np.empty_like(label)
        for part in np.unique(label):
            own = np.flatnonzero(label == part)
            centred = vectors[own] - vectors[own].mean(0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            halves[own] = 2 * part
            halves[own[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]]] = 2 * part + 1
        label = halves
    room = int(np.ceil(1.1 * len(vectors) / parts))
    sizes = np.bincount(label, minlength=parts)
    ends = np.repeat(np.arange(len(vectors)), edges.shape[1])
    links = np.r_[edges.ravel(), ends], np.r_[ends, edges.ravel()]
    for _ in range(rounds):
        votes = np.zeros((len(vectors), parts), np.int32)
        np.add.at(votes, (links[1], label[links[0]]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(vectors)), best] - votes[np.arange(len(vectors)), label]
        moved = 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            if sizes[best[row]] < room:
                sizes[label[row]] -= 1
                sizes[best[row]] += 1
                label[row], moved = best[row], moved + 1
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; `probes` parts are asked."""

    shift: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors - self.shift) / self.scale
        hidden = np.maximum(np.c_[x, np.ones(len(x))] @ self.inner, 0)
        return np.c_[hidden, np.ones(len(hidden))] @ self.outer


def _train(vectors: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator) -> Router:
    shift, scale = vectors.mean(0), vectors.std(0) + 1e-9
    x = np.c_[(vectors - shift) / scale, np.ones(len(vectors))]
    weights = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
        rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN + 1, parts)),
    ]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            before = x[rows] @ weights[0]
            hidden = np.c_[np.maximum(before, 0), np.ones(len(rows))]
            score = hidden @ weights[1]
            odds = np.exp(score - score.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(len(rows)), label[rows]] -= 1
            odds /= len(rows)
            back = (odds @ weights[1].T)[:, :-1] * (before > 0)
            step += 1
            for w, m, g in zip(weights, moments, (x[rows].T @ back, hidden.T @ odds)):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                rate = 0.003 * (1 - epoch / EPOCHS)
                w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Router(shift, scale, weights[0], weights[1], parts)


def fit(sample: np.ndarray, k: int = K, parts: int = PARTS, recall: float = RECALL) -> Router | None:
    """Learn the parts; None where the sample is too small to be cut."""
    rng = np.random.default_rng(SEED)
    if len(sample) < 20 * parts:
        return None
    sample = sample[rng.permutation(len(sample))]
    held = len(sample) // 5
    seen = sample[held:]
    router = _train(seen, balanced_parts(seen, graph(seen, k), parts), parts, rng)
    near = graph(sample, k)[:held]
    home = router.scores(sample).argmax(1)
    order = np.argsort(-router.scores(sample[:held]), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = place[np.arange(held)[:, None], home[near]]
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= recall:
            break
    return Router(router.shift, router.scale, router.inner, router.outer, probes)


# -- searching ----------------------------------------------------------------------


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def _stacked(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def _route(router: Router | None, dimension: int, counts: dict[int, int] | None, k: int):
    """The parts of each vector, as lists; with counts, the parts that a query asks."""

    def parts_of(series: pd.Series) -> list[list[int]]:
        out: list[list[int]] = [[-len(v)] for v in series]
        own = [i for i, v in enumerate(series) if len(v) == dimension]
        if router is None or not own:
            return [[0] if p == [-dimension] else p for p in out]
        order = np.argsort(-router.scores(_stacked(series.iloc[own])), axis=1, kind="stable")
        for i, row in zip(own, order):
            take = 1
            if counts is not None:
                held = np.cumsum([counts.get(int(p), 0) for p in row])
                take = max(router.probes, int(np.searchsorted(held, k + 1)) + 1)
            out[i] = [int(p) for p in row[:take]]
        return out

    return parts_of


def file_rows(rows: DataFrame, parts_of) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(parts=parts_of(frame["vec"]))

    return rows.mapInPandas(run, "vec_id long, vec array<double>, parts array<int>")


def _nearest(k: int):
    """The k nearest rows of a cell for each of its queries; ties to the smaller id."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            ids, b = rows["vec_id"].to_numpy(), _stacked(rows["vec"])
            for at in range(0, len(queries), 128):
                some = queries.iloc[at : at + 128]
                a, own = _stacked(some["vec"]), some["vec_id"].to_numpy()
                rough = _distances(a, b)
                rough[own[:, None] == ids[None, :]] = np.inf
                last = min(k, len(ids)) - 1
                edge = np.partition(rough, last, axis=1)[:, last]
                slack = 1e-9 * ((a * a).sum(1) + (b * b).sum(1).max())
                for i in range(len(a)):
                    near = np.flatnonzero((rough[i] <= edge[i] + slack[i]) & np.isfinite(rough[i]))
                    score = np.sqrt(((b[near] - a[i]) ** 2).sum(1))
                    first = np.lexsort((ids[near], score))[:k]
                    found.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[near][first], "score": score[first]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def search(vectors: DataFrame, asks, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose `vec_id` column meets the condition."""
    rows = valid(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = common["n"] if common else 0
    spread = [F.xxhash64("vec_id"), F.col("vec_id")]
    sample = rows.where(F.size("vec") == dimension).orderBy(*spread).limit(SAMPLE).toPandas()
    router = fit(_stacked(sample["vec"]), k) if len(sample) else None
    filed = durable(
        file_rows(rows, _route(router, dimension, None, k)).select("vec_id", "vec", F.col("parts")[0].alias("part"))
    )
    counts = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}
    queries = rows.where(asks).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    sent = durable(
        file_rows(queries, _route(router, dimension, counts, k)).select("vec_id", "vec", F.explode("parts").alias("part"))
    )
    # Cells: a share of the rows of a part against a share of its queries.
    row_cells = filed.groupBy("part").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("row_cells"))
    query_cells = sent.groupBy("part").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("query_cells"))
    grid = durable(row_cells.join(query_cells, "part"))
    share = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row_side = filed.join(F.broadcast(grid), "part").select("part", "vec_id", "vec", share("row_cells").alias("r"), every("query_cells").alias("q"))
    query_side = sent.join(F.broadcast(grid), "part").select("part", "vec_id", "vec", share("query_cells").alias("q"), every("row_cells").alias("r"))
    cell = ["part", "r", "q"]
    found = (
        query_side.groupBy(*cell)
        .cogroup(row_side.groupBy(*cell))
        .applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )

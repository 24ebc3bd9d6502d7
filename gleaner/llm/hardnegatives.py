"""Hard negatives by threshold joins over an inverted index with norm bounds.

An anchor's positives are its best rows of the same label; for each positive, its
negatives are the best rows of other labels whose score lies in a window below
the positive's.  Both are threshold joins: find all rows whose score with the
anchor reaches t, with t lowered until enough are found or the window ends.

Rows are packed in blocks, sorted by label.  Inside a cell (a block and some
anchors) the rows are an inverted index over dimensions, in groups, those of
most energy first:

* the list of a dimension leaves out the rows whose remaining norm from there on,
  times the longest remaining anchor, cannot reach the smallest threshold;
* scores are accumulated list by list, and a pair is dropped once its partial
  score plus the product of both remaining norms is below its threshold;
* pairs that are left get the rest of their product, so scores are exact.

A block is not visited by an anchor whose threshold is above the sum of its
largest products in each dimension, or the product of the norms.

Thresholds start where the moments of a bounded sample let expect enough rows,
and allow for eight times as many rows in each round; the last one lets
everything through.  They decide how much is read, never what is found.

Rows with a null label or id, a null vector or null or non-finite components, and
vectors longer than 2 ** 31 after scaling take no part.  Rows of one dimension
are compared with each other only.  Rows that share the anchor's id are not its
positives or negatives; of rows that share an anchor id, the one with the
smallest (label, vector) asks.  Repeated rows count each.  A negative positive
score has an empty window.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import cells
from gleaner.llm.common import written
from gleaner.operators.joins import stack, top_ranked

POSITIVES, NEGATIVES = 5, 3
#: The window: LEAST * positive <= 100 * negative <= MOST * positive.
LEAST, MOST = 50, 95
#: Rows that moments are taken from, at most.
SAMPLE = 4096
#: Dimensions of one step of the accumulation.
GROUP = 8
GROWTH = 8
#: Share of pairs from which the rest is finished pair by pair.
SPARSE = 0.05
SLICE = 256


def joined(anchors: np.ndarray, least: np.ndarray, rows: np.ndarray, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (anchor, row, score) whose score reaches the anchor's threshold, and the products that were accumulated."""
    kind = cells.exact_type(anchors, rows)
    a, b = anchors.astype(kind), rows.astype(kind)
    n, dims = b.shape
    starts = np.arange(0, max(dims, 1), group)
    rest = lambda x: np.sqrt(np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1))[:, ::-1]
    edge = lambda x: np.c_[rest(x)[:, starts], np.zeros(len(x))] if dims else np.zeros((len(x), 2))
    rest_a, rest_b = edge(a), edge(b)
    slack = 1e-9 * (rest_a[:, :1] * rest_b[:, 0].max(initial=0)) + 1e-3
    floor = least[:, None] - slack
    # Lists end where the norms that are left cannot reach any threshold of the cell.
    kept = (rest_b * rest_a.max(0, initial=0)[None, :] >= floor.min(initial=np.inf))[:, :-1]
    length = np.where(kept.all(1), len(starts), kept.argmin(1))
    order = np.argsort(-length, kind="stable")
    b, rest_b, length = b[order], rest_b[order], length[order]
    score = np.zeros((len(a), n), kind)
    alive = np.zeros((len(a), n), bool)
    alive[:, : np.searchsorted(-length, 0)] = True
    done, products, listed = length.copy(), 0, int(np.searchsorted(-length, 0))
    for g, at in enumerate(starts):
        listed = int(np.searchsorted(-length, -g))  # rows whose lists reach this group
        if not listed or not dims:
            break
        score[:, :listed] += a[:, at : at + group] @ b[:listed, at : at + group].T
        products += len(a) * listed * min(group, dims - at)
        alive[:, :listed] &= score[:, :listed] + rest_a[:, g + 1, None] * rest_b[None, :listed, g + 1] >= floor
        if g + 1 < len(starts) and alive.sum() < SPARSE * alive.size:
            done = np.minimum(length, g + 1)
            break
    i, j = np.nonzero(alive)
    found = score[i, j]
    upto = np.minimum(done[j] * group, dims)
    for p in np.unique(upto):
        own = np.flatnonzero(upto == p)
        if p < dims:
            found[own] += np.einsum("ij,ij->i", a[i[own], p:], b[j[own], p:])
            products += len(own) * (dims - int(p))
    hit = found >= least[i]
    return i[hit], order[j[hit]], found[hit].astype(np.int64), products


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, vec, dim, label), those of a label side by side, with the extremes of every dimension."""

    def describe(own: np.ndarray, columns: dict[str, np.ndarray]) -> dict:
        return {
            "low": own.min(0).astype(np.int32), "high": own.max(0).astype(np.int32), "longest": float(cells.norms(own).max(initial=0)),
            "first": int(columns["label"].min()), "last": int(columns["label"].max()),
        }

    described = "low array<int>, high array<int>, longest double, first bigint, last bigint"
    return cells.packed(rows, ["dim", "label", "lead"], [], size, describe, described, carry=["label"])


class Moments:
    """Mean and spread of an anchor's scores, for first guesses of thresholds."""

    def __init__(self, sample: np.ndarray, total: int):
        self.total = max(total, 1)
        points = sample.astype(np.float64)
        self.mean = points.mean(0) if len(points) else np.zeros(sample.shape[1])
        self.spread = np.cov(points.T).reshape(len(self.mean), -1) if len(points) > 1 else np.zeros((len(self.mean),) * 2)

    def _of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if vectors.shape[1] != len(self.mean):
            return np.zeros(len(vectors)), np.zeros(len(vectors))
        return vectors @ self.mean, np.sqrt(np.maximum(((vectors @ self.spread) * vectors).sum(1), 0))

    def reached_by(self, vectors: np.ndarray, rows: float, beyond: np.ndarray | None = None) -> np.ndarray:
        """Scores that about `rows` rows reach, besides those that reach `beyond`; all of them: minus infinity."""
        mean, spread = self._of(vectors)
        normal, out = NormalDist(), np.full(len(vectors), -np.inf)
        for i in np.flatnonzero(spread > 0):
            share = rows / self.total
            if beyond is not None:
                share += 1 - normal.cdf(float(np.clip((beyond[i] - mean[i]) / spread[i], -8, 8)))
            if share < 0.5:
                out[i] = mean[i] + spread[i] * normal.inv_cdf(1 - share)
        return out


def _plan(directory: dict[str, np.ndarray], moments: Moments, level: int, same: bool):
    """(block, anchor, threshold) wherever a block may hold rows that reach the threshold.

    An anchor that no block meets has one line without a block, for its threshold.
    """
    names = ["block", "query_id", "dim", "vec", "label", "highs", "lows", "least"]

    def meetings(own: pa.RecordBatch, dimension: int) -> Iterator[pa.RecordBatch]:
        lines = np.flatnonzero(directory["dim"] == dimension)
        low, high = (np.array([directory[c][i] for i in lines], np.float64).reshape(len(lines), dimension) for c in ("low", "high"))
        first, last = directory["first"][lines], directory["last"][lines]
        vec = cells.matrix(own.column("vec"), dimension).astype(np.float64)
        label = own.column("label").to_numpy()[:, None]
        if same:
            highs = lows = [[] for _ in range(own.num_rows)]
            least = moments.reached_by(vec, POSITIVES * float(GROWTH) ** level)
            meets = (first <= label) & (label <= last)
        else:
            windows = own.column("windows").to_pylist()
            highs, lows = ([[w[c] for w in x] for x in windows] for c in ("high", "low"))
            beyond = np.array([min(x) for x in highs], np.float64)
            least = moments.reached_by(vec, NEGATIVES * float(GROWTH) ** (level + 1), beyond)
            least = np.maximum(least, np.array([min(x) for x in lows], np.float64))
            meets = (first != label) | (last != label)
        most = np.maximum(vec, 0) @ high.T + np.minimum(vec, 0) @ low.T
        most = np.minimum(most, cells.norms(vec)[:, None] * directory["longest"][lines])
        most += 1e-9 * np.abs(most) + 1e-3
        meets = meets & (most >= least[:, None])
        q, at = np.nonzero(meets)
        alone = np.flatnonzero(~meets.any(1))
        block = pa.array(np.r_[directory["block"][lines[at]], np.zeros(len(alone), np.int64)], mask=np.r_[np.zeros(len(q), bool), np.ones(len(alone), bool)])
        q = np.r_[q, alone]
        picked = [own.column(c).take(pa.array(q)) for c in ("query_id", "dim", "vec", "label")]
        lists = [pa.array([x[i] for i in q], pa.list_(pa.int64())) for x in (highs, lows)]
        yield pa.RecordBatch.from_arrays([block, *picked, *lists, pa.array(least[q])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for rows in np.array_split(at, -(-len(at) // 128)):
                    yield from meetings(batch.take(pa.array(rows)), int(d))

    return run


PLANNED = "block bigint, query_id bigint, dim int, vec array<int>, label bigint, highs array<bigint>, lows array<bigint>, least double"
FOUND = "query_id bigint, window int, vec_id bigint, score bigint"


def _cell(same: bool, keep: int):
    """The `keep` best rows of a block for each anchor (same label) or each of its windows (other labels)."""

    def run(work: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        if len(work) and len(blocks):
            dimension = blocks.column("dim")[0].as_py()
            ids = np.asarray(blocks.column("ids")[0].values)
            labels = np.asarray(blocks.column("label_list")[0].values)
            rows = np.asarray(blocks.column("cells")[0].values).astype(np.int64).reshape(len(ids), dimension)
            # Dimensions of most energy first; sums do not depend on their order.
            order = np.argsort(-(rows.astype(np.float64) ** 2).sum(0), kind="stable")
            rows = rows[:, order]
            for at in range(0, len(work), SLICE):
                some = work.slice(at, SLICE)
                own, label, least = (some.column(c).to_numpy() for c in ("query_id", "label", "least"))
                i, j, score, _ = joined(cells.matrix(some.column("vec"), dimension)[:, order], least, rows)
                fits = (own[i] != ids[j]) & ((label[i] == labels[j]) == same)
                i, j, score = i[fits], j[fits], score[fits]
                highs, lows = (some.column(c).to_pylist() for c in ("highs", "lows"))
                for w in range(1 if same else max(map(len, highs))):
                    p, q, s = i, j, score
                    if not same:
                        # Anchors with fewer windows have an empty one.
                        high = np.array([x[w] if w < len(x) else -1 for x in highs])
                        low = np.array([x[w] if w < len(x) else 0 for x in lows])
                        inside = (s <= high[p]) & (s >= low[p])
                        p, q, s = p[inside], q[inside], s[inside]
                    by = np.lexsort((ids[q], -s, p))
                    p, q, s = p[by], q[by], s[by]
                    best = np.arange(len(p)) - np.searchsorted(p, np.arange(len(own)))[p] < keep
                    p, q, s = p[best], q[best], s[best]
                    found.append((own[p], np.full(len(p), w, np.int32), ids[q], s))
        kinds = (np.int64, np.int32, np.int64, np.int64)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, k) for k in kinds]
        return pa.table(dict(zip(("query_id", "window", "vec_id", "score"), columns)))

    return run


_HITS = "array<struct<window:int,rank:int,vec_id:bigint,score:bigint>>"


def _rounds(state: DataFrame, blocks: DataFrame, directory: dict[str, np.ndarray], moments: Moments, same: bool, keep: int, closed: Column) -> DataFrame:
    """Lower thresholds until `closed`, a condition on `hits` and `reached`, holds for every row of `state`; adds its `hits`."""
    done, level, last = [], 0, False
    while not last:
        # From here on a threshold lets all rows through, or ends with its window.
        last = float(GROWTH) ** level >= moments.total
        work = written(state.mapInArrow(_plan(directory, moments, level, same), PLANNED))
        found = cells.meet(work, blocks, _cell(same, keep), FOUND)
        ranked = top_ranked(found, ["query_id", "window"], [F.col("score").desc(), F.col("vec_id")], keep)
        hits = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("window", "rank", "vec_id", "score"))).alias("found"))
        reached = work.groupBy("query_id").agg(F.min("least").alias("reached"))
        both = written(
            state.join(reached, "query_id").join(hits, "query_id", "left")
            .withColumn("hits", F.coalesce("found", F.array().cast(_HITS))).withColumn("closed", closed | F.lit(last)).drop("found", "reached")
        )
        done.append(both.where("closed").drop("closed"))
        state = both.where("NOT closed").drop("hits", "closed")
        if state.isEmpty():
            break
        level += 1
    return stack(*done)


def _share(score: Column, percent: int, up: bool) -> Column:
    """`percent` of a score, rounded up or down, without leaving the longs."""
    whole = lambda a: F.call_function("div", a, F.lit(100))
    rest = F.pmod(score, F.lit(100)) * percent
    return (whole(score) * percent + whole(rest + (99 if up else 0))).cast("long")


def mine(
    vectors: DataFrame,
    asks: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    rows_per_block: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    label = F.col(label_col).cast("long").alias("label")
    kept = cells.quantised(vectors.where(F.col(label_col).isNotNull()), id_col, vector_col, label)
    rows = kept.withColumn("lead", F.when(F.col("dim") > 0, F.get("vec", F.lit(0))).otherwise(0))
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    dimension, total = next(iter(sizes), 0), sum(sizes.values())
    sample = rows.where(F.col("dim") == dimension).select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    moments = Moments(cells.matrix(sample.column("vec"), dimension) if len(sample) else np.empty((0, dimension)), total)
    blocks = blocks_of(rows, rows_per_block or cells.block_rows(total, dimension, 8 * dimension + 48))
    table = blocks.select("block", "dim", "low", "high", "longest", "first", "last").toArrow()
    directory = {c: table.column(c).to_numpy() for c in ("block", "dim", "longest", "first", "last")}
    for c in ("low", "high"):
        directory[c] = np.empty(len(table), object)
        directory[c][:] = [np.asarray(x.values) for x in table.column(c)]
    anchors = written(
        kept.where(asks).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "dim", "vec")).alias("v"))
        .select("query_id", "v.dim", "v.vec", "v.label")
    )
    # Every row that reaches the threshold is found: as many as are wanted are the best ones.
    near = _rounds(anchors, blocks, directory, moments, True, POSITIVES, F.size("hits") >= POSITIVES)
    window = lambda h: F.struct(
        h["vec_id"].alias("positive_id"), h["score"].alias("positive_score"),
        _share(h["score"], LEAST, True).alias("low"), _share(h["score"], MOST, False).alias("high"),
    )
    windows = F.filter(F.transform("hits", window), lambda w: (w["positive_score"] >= 0) & (w["low"] <= w["high"]))
    asked = written(near.withColumn("windows", windows).drop("hits").where(F.size("windows") > 0))
    full = lambda w, i: (F.size(F.filter("hits", lambda h: h["window"] == i)) >= NEGATIVES) | (F.col("reached") <= w["low"])
    closed = F.forall(F.transform("windows", full), lambda x: x)
    far = _rounds(asked, blocks, directory, moments, False, NEGATIVES, closed)
    hit = far.select("query_id", "windows", F.explode("hits").alias("h"))
    w = F.get("windows", F.col("h.window"))
    return hit.select(
        F.col("query_id").alias("anchor_id"), w["positive_id"].alias("positive_id"), (F.col("h.rank") + 1).alias("rank"),
        F.col("h.vec_id").alias("negative_id"), w["positive_score"].alias("positive_score"), F.col("h.score").alias("negative_score"),
    )

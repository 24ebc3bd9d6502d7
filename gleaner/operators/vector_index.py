"""A stored vector index: coarse cells and quantised residuals, with an exact re-rank.

Unit vectors are filed under the nearest of some centroids, fitted on a bounded
sample.  What is left of a vector is stored in one byte per component, with the
length of the rounding error.  A search reads the codes of a few cells, bounds
every similarity from both sides, and fetches the true vectors of rows that may
be among the k best, from the same sorted files.

Without `probes` the result is that of `vector.nearest`: cells are added until no
other can hold a better vector (centroid similarity plus cell radius).  With
`probes`, so many cells are read for each query and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.joins import fits_broadcast, many_tasks, stack, top_ranked
from gleaner.operators.vector import DIGITS, _matrix, _unit
from gleaner.session import checkpointed

SAMPLE = 16_384
MOST_CELLS = 1024
FIRST_CELLS = 4
QUERY_BATCH = 4096
#: So many cells go into the scan as a filter.
LISTED_CELLS = 500
SLICE = 256
CODE_SCHEMA = "cell int, chunk_idx bigint, same bigint, scale float, error float, code binary, embedding array<float>"
SLACK = 1e-6


def centroids(vectors: DataFrame, cells: int | None = None, rounds: int = 8) -> np.ndarray:
    """Centres of about sqrt(rows) cells, from a sample of at most SAMPLE rows."""
    rows = vectors.where(F.size("embedding") > 0).select("chunk_idx", F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = cells or min(max(int(rows.count() ** 0.5), 1), MOST_CELLS)
    sample = rows.orderBy(F.xxhash64("chunk_idx"), "chunk_idx").limit(SAMPLE).toArrow()
    if not len(sample):
        return np.zeros((0, 0))
    points = _unit(_matrix(sample.column("embedding").combine_chunks()))
    centre = points[:: max(1, len(points) // wanted)][:wanted].copy()
    for _ in range(rounds):
        home = (points @ centre.T - (centre * centre).sum(1) / 2).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, home, points)
        size = np.bincount(home, minlength=len(centre))[:, None]
        centre = np.where(size > 0, total / np.maximum(size, 1), centre)
    return centre


def encoded(vectors: DataFrame, centre: np.ndarray) -> DataFrame:
    """Vectors as CODE_SCHEMA, sorted by cell: row groups hold few cells each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("embedding")))
            cell = (unit @ centre.T - (centre * centre).sum(1) / 2).argmax(1)
            rest = unit - centre[cell]
            scale = (np.abs(rest).max(1) / 127).astype(np.float32)
            code = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).clip(-127, 127).astype(np.int8)
            error = np.sqrt(((rest - code * scale[:, None].astype(np.float64)) ** 2).sum(1)).astype(np.float32)
            codes = pa.array([row.tobytes() for row in code], pa.binary())
            columns = [pa.array(cell.astype(np.int32)), batch.column("chunk_idx"), batch.column("same"), pa.array(scale), pa.array(error), codes]
            yield pa.RecordBatch.from_arrays(
                [*columns, batch.column("embedding")], names=["cell", "chunk_idx", "same", "scale", "error", "code", "embedding"]
            )

    rows = vectors.select(
        "chunk_idx", F.xxhash64(F.col("embedding").cast("array<double>")).alias("same"), F.col("embedding").cast("array<float>").alias("embedding")
    )
    coded = rows.where(F.size("embedding") == centre.shape[1]).mapInArrow(run, CODE_SCHEMA) if len(centre) else rows.sparkSession.createDataFrame([], CODE_SCHEMA)
    return coded.repartitionByRange("cell", F.xxhash64("chunk_idx")).sortWithinPartitions("cell", "chunk_idx")


def cell_sizes(codes: DataFrame, centre: np.ndarray) -> DataFrame:
    """(cell, n, radius): rows of each cell, and the farthest one's distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("cell").to_numpy()
                away = np.sqrt(((_unit(_matrix(batch.column("embedding"))) - centre[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(away)], names=["cell", "away"])

    away = codes.select("cell", "embedding").mapInArrow(run, "cell int, away double")
    return away.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))


@dataclass(frozen=True)
class VectorIndex:
    """codes (CODE_SCHEMA), the centres, and rows and radius of each cell."""

    codes: DataFrame
    centre: np.ndarray
    n: np.ndarray
    radius: np.ndarray

    @staticmethod
    def write(vectors: DataFrame, root: str, centre: np.ndarray) -> None:
        """Codes and cell sizes of some vectors, below `root`."""
        encoded(vectors, centre).write.parquet(f"{root}/codes")
        codes = vectors.sparkSession.read.schema(CODE_SCHEMA).parquet(f"{root}/codes")
        cell_sizes(codes, centre).coalesce(1).write.parquet(f"{root}/sizes")

    @staticmethod
    def write_centres(spark: SparkSession, root: str, centre: np.ndarray) -> None:
        rows = [(i, row.tolist()) for i, row in enumerate(centre)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{root}/centres")

    @staticmethod
    def read_centres(spark: SparkSession, root: str) -> np.ndarray:
        rows = spark.read.parquet(f"{root}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))

    @staticmethod
    def read(spark: SparkSession, centre: np.ndarray, roots: list[str]) -> VectorIndex:
        """The index made of what was written below the given roots."""
        sizes = spark.read.schema("cell int, n bigint, radius double").parquet(*[f"{r}/sizes" for r in roots])
        n, radius = np.zeros(len(centre), np.int64), np.zeros(len(centre))
        for row in sizes.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
            n[row["cell"]], radius[row["cell"]] = row["n"], row["radius"]
        return VectorIndex(spark.read.schema(CODE_SCHEMA).parquet(*[f"{r}/codes" for r in roots]), centre, n, radius)

    def _first(self, near: np.ndarray, k: int, probes: int) -> np.ndarray:
        """For each query the `probes` nearest cells, and more until they hold k rows."""
        order = np.argsort(-np.where(self.n > 0, near, -np.inf), axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1)
        take = np.maximum(probes, (held < k).sum(1) + 1)[:, None]
        mask = np.zeros(near.shape, bool)
        np.put_along_axis(mask, order, np.arange(near.shape[1])[None, :] < take, axis=1)
        return mask & (self.n > 0)

    def _listed(self, df: DataFrame, cells: np.ndarray) -> DataFrame:
        # Sorted files: the scan skips row groups without these cells.
        return df.where(F.col("cell").isin([int(c) for c in cells])) if len(cells) <= LISTED_CELLS else df

    def _bounded(self, queries: np.ndarray, mask: np.ndarray, k: int, least: np.ndarray) -> DataFrame:
        """(q, cell, chunk_idx, low, high) of rows that may be among the k best of their task."""
        centre, hold = self.centre, self._hold
        shared = self.codes.sparkSession.sparkContext.broadcast((queries, mask, least, centre))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, wanted, floor, centre = shared.value
            floor = floor.copy()
            held: dict[int, list] = {}
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                for cell in np.unique(cells):
                    at, who = np.flatnonzero(cells == cell), np.flatnonzero(wanted[:, cell])
                    if not len(who):
                        continue
                    own = batch.take(pa.array(at))
                    code = np.frombuffer(b"".join(own.column("code").to_pylist()), np.int8).reshape(len(at), -1)
                    vector = centre[cell] + code * own.column("scale").to_numpy()[:, None].astype(np.float64)
                    error = own.column("error").to_numpy().astype(np.float64) + SLACK
                    ids, same = own.column("chunk_idx").to_numpy(), own.column("same").to_numpy()
                    for start in range(0, len(who), SLICE):
                        some = who[start : start + SLICE]
                        about = asked[some] @ vector.T
                        q, row = np.nonzero(about + error >= floor[some][:, None])
                        for i in np.unique(q):
                            rows = row[q == i]
                            new = (ids[rows], same[rows], about[i, rows] - error[rows], about[i, rows] + error[rows], np.full(len(rows), cell))
                            hold(held, floor, int(some[i]), new, k)
            for q, rows in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows[0]), q, np.int32)), pa.array(rows[4].astype(np.int32)), *map(pa.array, (rows[0], rows[2], rows[3]))],
                    names=["q", "cell", "chunk_idx", "low", "high"],
                )

        read = self._listed(self.codes.select("cell", "chunk_idx", "same", "scale", "error", "code"), np.flatnonzero(mask.any(0)))
        return read.mapInArrow(run, "q int, cell int, chunk_idx bigint, low double, high double")

    @staticmethod
    def _hold(held: dict[int, list], floor: np.ndarray, q: int, new: tuple, k: int) -> None:
        """Rows of a query whose upper bound reaches the k-th lower bound; of equal vectors the k smallest ids."""
        rows = [np.concatenate(c) for c in zip(held[q], new)] if q in held else list(new)
        if len(rows[0]) > k:
            order = np.lexsort((rows[0], rows[1]))
            rows = [c[order] for c in rows]
            start = np.flatnonzero(np.r_[True, rows[1][1:] != rows[1][:-1]])
            copy = np.arange(len(rows[1])) - np.repeat(start, np.diff(np.r_[start, len(rows[1])]))
            rows = [c[copy < k] for c in rows]
        if len(rows[0]) >= k:
            floor[q] = max(floor[q], np.partition(rows[2], len(rows[2]) - k)[len(rows[2]) - k])
            rows = [c[rows[3] >= floor[q]] for c in rows]
        held[q] = rows

    def _exact(self, found: DataFrame, qids: list, queries: np.ndarray) -> DataFrame:
        """The true similarities of the rows that are left."""
        cells = found.select("cell").distinct()
        listed = [r["cell"] for r in cells.collect()] if len(self.centre) <= LISTED_CELLS else []
        stored = self.codes.select("cell", "chunk_idx", "embedding")
        if listed:
            stored = self._listed(stored, np.array(listed))
        small = fits_broadcast(found)
        fetched = stored.join(F.broadcast(found) if small else found, ["cell", "chunk_idx"]).select("q", "chunk_idx", "embedding")
        shared = self.codes.sparkSession.sparkContext.broadcast((qids, queries))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            for batch in batches:
                if batch.num_rows:
                    q = batch.column("q").to_numpy()
                    sim = np.round(np.einsum("ij,ij->i", asked[q], _unit(_matrix(batch.column("embedding")))), DIGITS)
                    who = pa.array(np.asarray(names, dtype=object)[q], pa.string())
                    yield pa.RecordBatch.from_arrays([who, batch.column("chunk_idx"), pa.array(sim)], names=["qid", "chunk_idx", "similarity"])

        return fetched.mapInArrow(run, "qid string, chunk_idx bigint, similarity double")

    def _searched(self, table: pa.Table, k: int, probes: int | None) -> tuple[DataFrame, int]:
        """The answer of one batch of queries, and the rows whose codes were compared."""
        qids = table.column("qid").to_pylist()
        queries = _unit(_matrix(table.column("embedding").combine_chunks()))
        near = queries @ self.centre.T
        mask = self._first(near, k, probes or FIRST_CELLS)
        found = self._bounded(queries, mask, k, np.full(len(qids), -np.inf)).persist()
        try:
            least = np.full(len(qids), -np.inf)
            ranked = top_ranked(found, ["q"], [F.col("low").desc()], k)
            for row in ranked.groupBy("q").agg(F.min("low").alias("low"), F.count("*").alias("n")).collect():
                if row["n"] == k:
                    least[row["q"]] = row["low"]
            more = ~mask & (self.n > 0) & (near + self.radius + SLACK >= least[:, None]) if probes is None else np.zeros_like(mask)
            limits = self.codes.sparkSession.createDataFrame(list(enumerate(least.tolist())), "q int, least double")
            kept = found.join(F.broadcast(limits), "q").where("high >= least").drop("least")
            if more.any():
                kept = stack(kept, self._bounded(queries, more, k, least))
            # Candidates are read twice: for the cells to open, and for the join.
            kept = checkpointed(kept.select("q", "cell", "chunk_idx"))
        finally:
            found.unpersist()
        return self._exact(kept, qids, queries), int(((mask | more) @ self.n).sum())

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> tuple[DataFrame, float]:
        """queries(qid, embedding) -> ((qid, rank, chunk_idx, similarity), share of codes compared per query).

        Queries go in batches of bounded size, each a pass over the cells it needs.
        """
        queries = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
        queries = queries.where(F.size("embedding") == (self.centre.shape[1] if len(self.centre) else -1))
        few = queries.limit(QUERY_BATCH + 1).toArrow()
        total = len(few) if len(few) <= QUERY_BATCH else queries.count()
        batches = 1 if total <= QUERY_BATCH else -(-2 * total // QUERY_BATCH)
        found, read = [], 0
        for batch in range(batches):
            own = few if batches == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(batches)) == batch).toArrow()
            if len(own):
                hits, compared = self._searched(own, k, probes)
                found.append(hits)
                read += compared
        if not found:
            empty = self.codes.sparkSession.createDataFrame([], "qid string, rank int, chunk_idx bigint, similarity double")
            return empty, 0.0
        order: list[Column] = [F.col("similarity").desc(), F.col("chunk_idx")]
        spread = "chunk_idx" if many_tasks(self.codes) else None
        ranked = top_ranked(stack(*found), ["qid"], order, k, spread_by=spread).select("qid", "rank", "chunk_idx", "similarity")
        return ranked, read / max(1, total * int(self.n.sum()))

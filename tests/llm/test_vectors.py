"""Exact searches over whole-number vectors, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import cells, hardnegatives, pivots, queries

VECTORS = "vec_id bigint, embedding array<double>, label int, dim int, block string, pivot int, vec string"


def scaled(rows):
    """(id, label, whole numbers) of the rows that take part."""
    out = []
    for vec_id, vector, label in rows:
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            out.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def top(rows, asks, k):
    rows = scaled(rows)
    want = set()
    for asked in {r[0] for r in rows if asks(r[0])}:
        q = min((len(v), v) for i, _, v in rows if i == asked)[1]
        found = sorted((-product(q, v), i) for i, _, v in rows if i != asked and len(v) == len(q))
        want.update((asked, rank + 1, i, -s) for rank, (s, i) in enumerate(found[:k]))
    return want


def negatives(rows, asks):
    rows = [r for r in scaled(rows) if r[1] is not None]
    want = set()
    for asked in {r[0] for r in rows if asks(r[0])}:
        label, _, q = min((lab, len(v), v) for i, lab, v in rows if i == asked)
        others = sorted((-product(q, v), i, lab) for i, lab, v in rows if i != asked and len(v) == len(q))
        for p, i, _ in [x for x in others if x[2] == label][:5]:
            fits = [(s, j) for s, j, lab in others if lab != label and 50 * -p <= 100 * -s <= 95 * -p]
            want.update((asked, i, rank + 1, j, -p, -s) for rank, (s, j) in enumerate(fits[:3]))
    return want


def table(spark, rows):
    more = [(i, v, label, 7, "b", 1, "v") for i, v, label in rows]
    return spark.createDataFrame(more, VECTORS).repartition(5)


def listed(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SEARCHED = ("query_id", "rank", "vec_id", "score")
MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def clustered(n, dims=8, seed=1, spread=0.02):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(20)]
    return [(i, [x + rng.gauss(0, spread) for x in centres[i % 20]], i % 4) for i in range(n)]


def odd_rows():
    rows = [(i, [math.sin(i * j + 1) for j in range(5)], i % 3) for i in range(1, 160)]
    rows += [(200 + i, [0.5] * 5, i % 2) for i in range(80)]  # ties
    rows += [(300, None, 1), (350, [1.0, None, 1.0, 1.0, 1.0], 1), (400, [float("nan")] * 5, 1), (450, [float("-inf")] * 5, 1)]
    rows += [(None, [1.0] * 5, 1), (500, [0.0] * 5, 0), (550, [], 0), (551, [], 1), (600, [1.0, -2.0], 0), (650, [3.0, 1.0], 1)]
    rows += [(700, [-1.0] * 5, 2), (750, [0.1, 0.2, 0.3, 0.4, 0.5], None)]
    rows += [(800, [1e5, -1e5, 3e4, 7e4, 1.0], 0), (801, [1e5, -1e5, 3e4, 7e4, 2.0], 1), (802, [1e5, 2e4, 3e4, 7e4, 2.0], 0)]  # products beyond 2 ** 53
    return rows


def test_queries(spark, sf_dir):
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    asks = lambda i: i % 50 == 0
    assert listed(queries.op12_pivot_search(spark, sf_dir), *SEARCHED) == top(stored, asks, 5)
    moved = [(i, v, (lab + 1) % 10 if i is not None and i % 7 == 0 and lab is not None else lab) for i, v, lab in stored]
    assert listed(queries.op11_threshold_negatives(spark, sf_dir), *MINED) == negatives(moved, asks)


def test_empty_tables(spark, empty):
    assert queries.op11_threshold_negatives(spark, empty).collect() == []
    assert queries.op12_pivot_search(spark, empty).collect() == []


@pytest.mark.parametrize("size", [4, None])
def test_odd_rows(spark, size):
    rows, asks = odd_rows(), lambda i: i % 50 == 0
    df = table(spark, rows)
    condition = F.col("vec_id") % 50 == 0
    found = pivots.search(df, condition, rows_per_block=size)
    assert listed(found, *SEARCHED) == top(rows, asks, 5)
    mined = hardnegatives.mine(df, condition, rows_per_block=size)
    assert listed(mined, *MINED) == negatives(rows, asks)


def test_too_long_vectors_take_no_part(spark):
    df = table(spark, [(0, [1e300, 1.0], 0), (1, [1.0, 1.0], 0), (2, [2.0, 1.0], 0), (100, [1.0, 1.0], 0)])
    assert listed(pivots.search(df, F.col("vec_id") % 50 == 0), *SEARCHED) == {(100, 1, 2, 3 * 65536), (100, 2, 1, 2 * 65536)}


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.5], 0)] * 2 + [(0, [0.5, 0.5], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.7, 0.7], 1)]
    df = table(spark, rows)
    found = sorted(tuple(r) for r in pivots.search(df, F.col("vec_id") == 0).select(*SEARCHED).collect())
    low, high = product([128, 128], [179, 179]), product([128, 128], [256, 256])
    assert found == [(0, 1, 1, high), (0, 2, 1, high), (0, 3, 2, low)]
    mined = sorted(tuple(r) for r in hardnegatives.mine(df, F.col("vec_id") == 0).select(*MINED).collect())
    assert mined == [(0, 1, 1, 2, high, low)] * 2


def test_annuli_are_skipped(spark):
    """On vectors in clusters the bounds leave most of the index unread; results stay whole."""
    rows = clustered(4000)
    found = pivots.search(table(spark, rows), F.col("vec_id") % 400 == 0, rows_per_block=20).cache()
    assert listed(found, *SEARCHED) == top(rows, lambda i: i % 400 == 0, 5)
    assert found.agg(F.max("n_annuli")).first()[0] < 4000 // 20 / 2


def test_bounds_hold():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(300, 6))).astype(np.int64)
    asked = np.floor(256 * rng.normal(size=(20, 6)))
    centres = pivots.choose(rows, 7)
    home = pivots._distances(rows.astype(float), centres).argmin(1)
    away = np.sqrt(((rows - centres[home]) ** 2).sum(1))
    lines = {"pivot": home, "near": away, "far": away, "longest": (rows.astype(float) ** 2).sum(1)}
    assert (pivots.bounds(asked, centres, lines) >= asked @ rows.T).all()


@pytest.mark.parametrize("least", [-np.inf, 0.0, 2e5, 4e5, 1e7])
@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_threshold_join(least, scale):
    rng = np.random.default_rng(6)
    decay = np.exp(-np.arange(30) / 4)
    rows = np.floor(256 * scale * rng.normal(size=(500, 30)) * decay).astype(np.int64)
    anchors = np.floor(256 * scale * rng.normal(size=(40, 30)) * decay).astype(np.int64)
    score = anchors @ rows.T
    limit = np.full(40, least * scale**2)
    i, j, s, products = hardnegatives.joined(anchors, limit, rows)
    assert {*zip(i.tolist(), j.tolist(), s.tolist())} == {(a, b, int(score[a, b])) for a, b in zip(*np.nonzero(score >= limit[:, None]))}
    assert products <= anchors.shape[0] * rows.shape[0] * rows.shape[1]
    if least >= 4e5:
        assert products < 0.6 * anchors.shape[0] * rows.shape[0] * rows.shape[1]


def test_directory_stays_bounded():
    for rows in (10**4, 10**7, 10**10, 10**13):
        assert rows / cells.block_rows(rows, 64, 48) * 48 <= cells.DIRECTORY_BYTES

"""Shards along a Hilbert curve.

Several metadata columns are quantised to a few bits each, by quantiles, and
joined into a cell on a Hilbert curve.  Rows are put in the order of the curve,
and the order is cut into runs, one per shard: rows that are alike in several
columns share a shard, and the ranges of every column in a shard are narrow, so
that readers skip shards by any of the columns (`ranges`).

The law is `rows`: shards differ by one row at most.  Rows of one cell, such as
a hot source, are ordered by a hash of the id, so a cell may be cut anywhere.

Quantiles of strings are taken over whole values, by the rows before each
distinct one, so values that begin alike fall into different bins.

A null in a dimension counts as the smallest value (of strings, as the empty one); a null text has no bytes.
Null and repeated ids are placed row by row.  Fewer rows than shards leave
shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import durable, positioned, whole

SHARDS = 40
DIMENSIONS = ("lang", "source", "n_chars")
BITS = 4
ACCURACY = 10_000


def curve(dimensions: int, bits: int) -> list[int]:
    """Place on the Hilbert curve of every cell, cells listed with the last dimension fastest.

    Follows the curve by its self-similarity: a cube of 2 ** dimensions boxes is
    walked in Gray code order, each box turned so that its ends meet the next.
    """
    size = 1 << dimensions
    rotate = lambda x, by: ((x << by % dimensions) | (x >> (dimensions - by % dimensions))) & (size - 1)
    places = []
    for cell in product(range(1 << bits), repeat=dimensions):
        entry, turn, place = 0, 0, 0
        for level in reversed(range(bits)):
            corner = sum(((x >> level) & 1) << (dimensions - 1 - d) for d, x in enumerate(cell))
            gray = rotate(corner ^ entry, dimensions - turn)
            step = gray
            for shift in range(1, dimensions):
                step ^= gray >> shift
            place = place << dimensions | step
            start = 0 if step == 0 else (lambda e: e ^ e >> 1)(2 * ((step - 1) // 2))
            entry ^= rotate(start, turn)
            along = 0 if step == 0 else _trailing_ones(step if step % 2 else step - 1)
            turn = (turn + along + 1) % dimensions
        places.append(place)
    return places


def _trailing_ones(x: int) -> int:
    n = 0
    while x & 1:
        x, n = x >> 1, n + 1
    return n


def _numeric_cuts(rows: DataFrame, dimensions: Sequence[str], shares: Sequence[float]) -> list[list]:
    """Quantiles of several columns of numbers, dates or times, in one pass."""
    found = rows.agg(*[F.percentile_approx(_ordered(rows, c), list(shares), ACCURACY).alias(c) for c in dimensions]).first()
    return [found[c] or [] for c in dimensions]


def _string_cuts(rows: DataFrame, dimension: str, bins: int) -> list[str]:
    """Least value of every bin of a column of strings, by the rows before each distinct value.

    Distinct values are counted first, so a hot one is a single row; they are
    sorted in ranges and summed within them.  A row per bin comes to the driver.
    """
    value = F.col("__value")
    counted = rows.groupBy(_ordered(rows, dimension).alias("__value")).agg(F.count("*").alias("__rows"))
    ranged = durable(counted.repartitionByRange("__value").withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__part")
        .agg(F.sum("__rows").alias("__sum"))
        .select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"), F.sum("__sum").over(Window.partitionBy()).alias("__total"))
    )
    inside = Window.partitionBy("__part").orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__rows").over(inside), F.lit(0))
    numbered = ranged.withColumn("__first", first).join(F.broadcast(offsets), "__part")
    bin_ = F.floor(F.lit(bins) * (F.col("__first") + F.col("__offset")) / F.col("__total"))
    cuts = numbered.groupBy(bin_.alias("bin")).agg(F.min(value).alias("cut")).orderBy("bin").collect()
    return [r["cut"] for r in cuts[1:]]


def _ordered(rows: DataFrame, dimension: str) -> Column:
    """The column without nulls, which come first."""
    if isinstance(rows.schema[dimension].dataType, T.StringType):
        return F.coalesce(F.col(dimension), F.lit(""))
    return F.coalesce(F.col(dimension).cast("double"), F.lit(float("-inf")))


def curve_index(rows: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> Column:
    """Place of each row on the curve.  Only the bounds of the bins come to the driver."""
    bins = 1 << bits
    strings = [c for c in dimensions if isinstance(rows.schema[c].dataType, T.StringType)]
    numbers = [c for c in dimensions if c not in strings]
    bounds = {c: _string_cuts(rows, c, bins) for c in strings}
    bounds |= dict(zip(numbers, _numeric_cuts(rows, numbers, [i / bins for i in range(1, bins)]) if numbers else []))
    cell = F.lit(0)
    for c in dimensions:
        value = _ordered(rows, c)
        # A string starts the bin whose least value it is; a number at a quantile ends a bin.
        over = (lambda step: value >= F.lit(step)) if c in strings else (lambda step: value > F.lit(step))
        bin_ = sum((F.when(over(step), 1).otherwise(0) for step in sorted(set(bounds[c]))), F.lit(0))
        cell = F.shiftleft(cell, bits) + bin_
    return F.get(F.array(*[F.lit(p) for p in curve(len(dimensions), bits)]), cell)


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: Sequence[str] = DIMENSIONS,
    shards: int = SHARDS,
) -> DataFrame:
    """One row per document: id, dimensions, `__size`, `__crc`, `__curve`, `__shard` and `__slot`."""
    text = whole(text_col)
    narrow = docs.select(
        F.col(id_col).alias("__id"),
        *[F.col(c).alias(f"__d{i}") for i, c in enumerate(dimensions)],
        (F.octet_length(text) + 16).cast("long").alias("__size"),
        F.crc32(text).alias("__crc"),
    )
    rows = durable(narrow)  # texts are read once
    index = curve_index(rows, [f"__d{i}" for i in range(len(dimensions))])
    spread = rows.withColumn("__curve", index).withColumn("__mix", F.xxhash64("__id", "__crc"))
    placed = positioned(spread, ["__curve", "__mix", "__id", "__crc", "__size"], "__pos")
    total = rows.count()
    number = F.expr(f"cast((__pos * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(cast(__shard as bigint) * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("__shard", number).withColumn("__slot", F.col("__pos") - first).drop("__mix", "__pos")


def ranges(placed: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Per shard its rows and the least and largest value of every dimension: the index that readers prune by."""
    bounds = []
    for i, c in enumerate(dimensions):
        bounds += [F.min(f"__d{i}").alias(f"min_{c}"), F.max(f"__d{i}").alias(f"max_{c}")]
    return placed.groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("rows"), *bounds)

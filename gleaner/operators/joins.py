"""Joins of a huge side with a lookup side, and ranking that stays distributed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SPREAD_BYTES = 256 << 20
ROW_OVERHEAD_BYTES = 16
SALTS = 32
# About a thousand scan tasks of the default size.
MANY_TASKS_BYTES = 128 << 30


def stack(*frames: DataFrame) -> DataFrame:
    """Union by column name.

    Spark 4.1 may plan a group or join above a union without a shuffle, because
    all inputs are partitioned alike, and then read a reused shuffle as further
    partitions: groups come out in pieces.  Unions are told not to claim a
    partitioning.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, frames)


def measured_bytes(df: DataFrame) -> int:
    """Size of a (small) table: one aggregate, one number back to the driver."""
    row_bytes = F.octet_length(F.to_json(F.struct(*df.columns))) + ROW_OVERHEAD_BYTES * len(df.columns)
    return df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for a file scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def many_tasks(df: DataFrame) -> bool:
    """Is the table scanned by so many tasks that their top-k lists add up?"""
    return estimated_bytes(df) > MANY_TASKS_BYTES


def spread_small(df: DataFrame, limit: int = SPREAD_BYTES) -> DataFrame:
    """Give every core a share of a small table before heavy per-row work.

    A small table often sits in one row group, which a single task reads; its
    rows are dealt out once.  A table above the limit has row groups enough and
    is left as it is: nothing large is shuffled here.
    """
    if estimated_bytes(df) > limit:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def join_lookup(big: DataFrame, lookup: DataFrame, key: str, spread_by: str, small: bool) -> DataFrame:
    """Inner join on `key` without putting a hot key into one task.

    A lookup side of proven size is broadcast and the big side is never
    shuffled.  Otherwise every key is cut into SALTS parts by `spread_by`, a
    column of the big side, and the lookup side is repeated once per part.
    """
    if small:
        return big.join(F.broadcast(lookup), key)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def top_ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    spread_by: str | None = None,
) -> DataFrame:
    """First k rows of every group, with their 0-based rank.

    Filtering the raw row_number lets Spark cut each map-side partition to k
    rows per group before the shuffle.  With `spread_by` a first round ranks
    within slices of a group, so that the last task of a hot group reads
    SALTS * k rows instead of k per input partition.
    """
    conf, threshold = df.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if k > int(conf.get(threshold, "1000")):
        conf.set(threshold, str(k))  # long lists, too, are cut before the shuffle
    if spread_by is not None:
        slices = [*by, "_slice"]
        cut = Window.partitionBy(*slices).orderBy(*order)
        df = (
            df.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
            .withColumn("_rn", F.row_number().over(cut))
            .where(F.col("_rn") <= k)
            .drop("_rn", "_slice")
        )
    whole = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= k)
        .withColumn(rank, F.col("_rn") - 1)
        .drop("_rn")
    )

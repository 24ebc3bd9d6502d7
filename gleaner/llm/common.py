"""Column and table helpers that several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir, checkpointed

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: monotonically_increasing_id() keeps the partition above this bit.
PARTITION_BIT = 33


def durable(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder of `spark.checkpoint.dir`."""
    return checkpointed(df)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in a new folder below `spark.checkpoint.dir`.

    Takes a third of the space of `durable`, but nothing deletes it.
    """
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def whole(text: str | Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters other than blanks (space, tab to carriage return)."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))


def n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK_RUN, -1))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running `merge` (sum, greatest, least) over an array of longs.

    Arrays can only grow by copying, so it works in square-root sized blocks:
    n ** 1.5 steps for n values, not n ** 2.
    """
    none = F.array().cast("array<bigint>")
    last = lambda a: F.element_at(a, -1)

    def grow(done: Column, value: Column) -> Column:
        return F.array_append(done, F.when(F.size(done) == 0, value).otherwise(merge(last(done), value)))

    def blocks(array: Column, step: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(array), step)
        return F.transform(starts, lambda at: F.aggregate(F.slice(array, at, step), none, grow))

    def joined(parts: Column) -> Column:
        totals = F.aggregate(parts, none, lambda done, part: grow(done, last(part)))
        return let(
            totals,
            lambda total: F.flatten(
                F.transform(
                    parts,
                    lambda part, i: F.when(i == 0, part).otherwise(
                        F.transform(part, lambda value: merge(F.get(total, i - 1), value))
                    ),
                )
            ),
        )

    def scan(array: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(array))).cast("int")
        return let(blocks(array, step), joined)

    return F.when(F.size(values) == 0, none).otherwise(let(values, scan))


def positioned(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based place of every row in the order of the given columns.

    Rows are range-partitioned and sorted, written once, and numbered inside
    their partition; one count per partition gives the offsets, so what is
    broadcast has a row per partition.  Give `order` a column that splits ties
    (a hash of the id), or a hot value ends in one partition.
    """
    place = "__place"
    sort = [F.col(c).asc_nulls_first() for c in order]
    kept = durable(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(place, F.monotonically_increasing_id())
    )
    part = F.shiftright(place, PARTITION_BIT)
    inside = F.col(place).bitwiseAND((1 << PARTITION_BIT) - 1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        kept.groupBy(part.alias("__part"))
        .agg(F.count("*").alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        kept.withColumn("__part", part)
        .withColumn(name, inside)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col(name) + F.col("__offset"))
        .drop(place, "__part", "__offset")
    )

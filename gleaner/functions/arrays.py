"""Small array helpers on top of Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`.

    Catalyst may copy an expensive projected column into every place that
    mentions it; a lambda variable is computed once per row instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(first, last) -> Column:
    """The integers first..last, empty when last < first (sequence() counts down)."""
    first, last = F.lit(first), F.lit(last)
    return F.when(last >= first, F.sequence(first, last)).otherwise(
        F.array().cast("array<int>")
    )


def counted(items: Column, item: str = "item", n: str = "n") -> Column:
    """Multiset of an array as array<struct<item, n>>, sorted by item.

    Equal items are neighbours after sorting, so each count is the distance
    between two run starts.  The count never leaves the row, which saves the
    shuffle that explode + groupBy would need.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            positions(1, F.size(s)),
            lambda i: (i == 1) | (F.get(s, i - 2) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda i, p: F.struct(
                    F.get(s, i - 1).alias(item),
                    (F.coalesce(F.get(at, p + 1), F.size(s) + 1) - i).alias(n),
                ),
            ),
        )

    return let(F.sort_array(items), runs)

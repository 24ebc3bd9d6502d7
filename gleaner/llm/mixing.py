"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the mix by weight, but none takes more than `cap`
times its own words; what it cannot take is shared among the others by weight
(water filling: one level for all sources below their cap).

Within a source every document is taken `floor(e)` times, `e` being the target
over the words of the source, and the rest of the target is a Pareto order
sample: documents are ranked by the odds of a uniform number divided by the
odds of their inclusion probability, and the first ones are taken until the
words of the source come nearest to its target.  The uniform number is a hash
of seed and id, so reruns agree.

Inclusion probabilities differ by size.  With `f` the fraction of `e`, a
document has `f * (1 + (1 - f) * pull * g)`, where `g` is its appeal,
`size / (size + half)`, less the mean appeal of a word of its source.  So long
documents are taken more often than short ones, every probability lies in
(0, 1), and the expected words of the source are still its target.  Appeals are
whole 1024ths: sums are exact, whatever order they are made in.  `pull` 0 gives
all documents of a source the same odds.

Ranking needs no sorted source: words are first summed in slices of the rank
order, the target falls into one slice, and only that slice is ordered.  A
source ends in a cut, a place in the rank order, that documents are compared
with where they are read; texts are not shuffled.

A null text has no words.  Null is a source of its own, the last.  Null ids
hash as one id.  Repeated rows share their rank, so they are taken alike.
Sources without words get target 0 and are not taken.  Empty tables give empty
mixes; all columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import durable, n_words, whole
from gleaner.operators.joins import fits_broadcast, join_lookup

WEIGHTS = (1, 2, 3)
CAP = 3
SLICES = 4096
#: Words at which a document has half of the largest appeal.
HALF = 256
_BITS = 52
_STEPS = 1024


def uniform(id_col: Column, seed: int) -> Column:
    """In (0, 1), from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("double")
    return (number + 0.5) / float(1 << _BITS)


def appeal(size: Column, half: int = HALF) -> Column:
    """How much a document is wanted, from 0 to 1024, by its words."""
    return F.floor(size * _STEPS / (size + half))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add `target` to sources(source, source_size, ...).  One row per source goes through one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("limit", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    ranked = (
        sources.withColumn("weight", weight.cast("double"))
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("limit", F.col("most") / F.col("weight"))
    )
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0))
    levels = ranked.withColumn("__level", left / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("__level") <= F.col("limit"), F.struct("limit", "__level"))).over(all_rows)
    target = F.least(F.col("most").cast("double"), F.col("weight") * level["__level"])
    return levels.select(*sources.columns, F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: int = 8,
    slices: int = SLICES,
    half: int = HALF,
    pull: float = 1.0,
) -> DataFrame:
    """All documents with `__size`, `__source_size`, `__target` and `__copies`, how often each is taken.

    `pull`, from 0 to 1, says how far the inclusion odds lean towards long documents.
    """
    if not 0 <= pull <= 1:
        raise ValueError("pull must lie between 0 and 1")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    rows = docs.select(
        row.alias("__row"),
        F.to_json(named).alias("__source"),
        F.col(source_col).alias("__name"),
        n_words(whole(text_col)).alias("__size"),
        uniform(F.col(id_col), seed).alias("__u"),
        F.col(id_col).alias("__id"),
    )
    sized = durable(rows.drop("__row"))
    wanted = F.sum(F.col("__size") * appeal(F.col("__size"), half))
    sources = sized.groupBy("__source", F.col("__name").alias("source")).agg(F.sum("__size").alias("source_size"), wanted.alias("wanted"))
    shares = targets(sources.drop("__source"), weights, cap)
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"))
    shares = durable(
        shares.select(
            F.to_json(key).alias("__source"),
            F.col("source_size").alias("__source_size"),
            F.col("target").alias("__target"),
            F.when(F.col("source_size") > 0, F.col("wanted") / F.col("source_size")).otherwise(0.0).alias("__mean"),
        )
        .withColumn("__expected", F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0))
        .withColumn("__sure", F.least(F.floor("__expected"), F.lit(cap)).cast("int"))
        .withColumn("__left", F.col("__target") - F.col("__sure") * F.col("__source_size"))
    )
    part = F.col("__expected") - F.col("__sure")
    chance = part * (1 + (1 - part) * (pull * (appeal(F.col("__size"), half) - F.col("__mean")) / _STEPS))
    odds = F.col("__u") / (1 - F.col("__u"))
    # The rank: odds over inclusion odds, as a share of one, so that it can be sliced.
    rank = odds * (1 - chance) / (odds * (1 - chance) + chance)
    order = F.struct(rank.alias("rank"), F.col("__id").alias("id"), F.col("__size").alias("size"))
    open_ = (part > 0) & (F.col("__size") > 0)
    # A hot source must not be one task: a few sources are broadcast, very many are salted.
    few = fits_broadcast(shares)
    ranked = join_lookup(sized, shares, "__source", "__u", few).where(open_).withColumn("__order", order)
    slice_ = F.least(F.floor(F.col("__order.rank") * slices), F.lit(slices - 1)).cast("int")
    sliced = ranked.select("__source", "__left", "__order", slice_.alias("__slice"))
    upto = Window.partitionBy("__source").orderBy("__slice")
    found = (
        sliced.groupBy("__source", "__slice", "__left")
        .agg(F.sum("__order.size").alias("__words"))
        .withColumn("__before", F.sum("__words").over(upto) - F.col("__words"))
        .where((F.col("__before") <= F.col("__left")) & (F.col("__left") < F.col("__before") + F.col("__words")))
        .select("__source", "__slice", "__before")
    )
    inside = Window.partitionBy("__source").orderBy("__order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.abs(F.col("__total") - F.col("__left"))
    best = (
        join_lookup(sliced, found.withColumnRenamed("__slice", "__at"), "__source", "__order", few)
        .where(F.col("__slice") == F.col("__at"))
        .withColumn("__total", F.col("__before") + F.sum("__order.size").over(inside))
        .groupBy("__source")
        .agg(
            F.min(F.struct(near.alias("gap"), F.col("__order").alias("order"))).alias("__best"),
            F.min(F.col("__left") - F.col("__before")).alias("__none"),
        )
    )
    # Before the first document of the slice the source stands `__none` words short.
    start = F.struct(
        (F.col("__slice") / slices).alias("rank"),
        F.lit(None).cast(sized.schema["__id"].dataType).alias("id"),
        F.lit(-1).cast("long").alias("size"),
    )
    cuts = best.join(found, "__source").select(
        "__source",
        F.when(F.col("__best.gap") <= F.col("__none"), F.col("__best.order")).otherwise(start).alias("__cut"),
    )
    plan = shares.join(cuts, "__source", "left")
    extra = F.when(open_ & (F.col("__order") <= F.col("__cut")), 1).otherwise(0)
    return (
        join_lookup(rows, plan, "__source", "__u", few)
        .withColumn("__order", order)
        .withColumn("__copies", F.when(F.col("__size") > 0, F.col("__sure") + extra).otherwise(0))
        .select("__row.*", "__size", "__source_size", "__target", "__copies")
    )

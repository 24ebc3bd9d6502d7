"""Near copies: components of texts whose shingles of five words are alike by 0.8 or more.

Similarity is the exact Jaccard of the sets of shingle hashes; normalisation is
that of the fingerprints.  Candidates come from two sources, and only connect:

* SimHash: fingerprints of five words within the radius,
* MinHash: BANDS bands of ROWS minima each.  A pair at 0.8 misses all bands with
  a chance of (1 - 0.8 ** 5) ** 40 = 1.3e-7, a more similar one with less.

64 bits alone do not do: texts at 0.8 differ in about 10 bits, many in 13 and
more, and a radius that holds them links unlike texts.

The components of the candidates hold those of the similar pairs.  Inside each
one the texts are compared in cells of bounded size: common shingles are counted
by a matrix product, and a cell hands on a forest of the pairs that are similar.
A large component is dealt into parts, and every text goes to one part only; one
text of each group found goes on to the next round, so many variants of one
template shrink to a few at once and each text is sent about once.

Texts of a large component that are still in different groups after that may be
alike all the same.  Two sets that are alike share one of their rarest shingles
(a fifth of them, in any order that is the same for all).  Texts that share none
with another group are done; only the others meet in all pairs of parts.

Texts with the same shingles are one vertex, named by a hash of the set.  Texts
of fewer than five words have one shingle; null, empty and blank ones have none
and are copies of each other.  Ids are treated as in `simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import simhash
from gleaner.llm.common import durable
from gleaner.llm.components import stars
from gleaner.llm.texts import Unpack, packed
from gleaner.operators.joins import fits_broadcast, join_lookup, stack

WORDS = 5
#: Least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
BANDS = 40
ROWS = 5
#: Texts that one part of a split component holds, on average.
PART = 256
#: Shingles that it holds, on average, where texts are long.
PART_SHINGLES = 1 << 21
#: Counters of how often shingles occur, to order them by; shingles may share one.
COUNTERS = 1 << 18
_COLUMNS = 1 << 13
_AT_ONCE = 1 << 12
_FACTORS, _SHIFTS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(simhash.hashes(text, n))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key of each band; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _AT_ONCE):
        mixed = (found[at : at + _AT_ONCE] ^ _SHIFTS) * _FACTORS
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(id, text_hash, node, weight, fingerprint, keys) of every row; `node` names the set of shingles, `weight` is its size."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")
    )
    long = T.LongType()
    schema = T.StructType(
        [
            *rows.schema.fields[:2],
            *[T.StructField(name, long) for name in ("node", "weight", "fingerprint")],
            T.StructField("keys", T.ArrayType(long)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, weights, prints, keys = [], [], [], []
            for text in batch.column(2):
                hashes = simhash.hashes(text.as_py(), n)
                found = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                weights.append(len(found))
                prints.append(simhash.majority(hashes))
                keys.append(band_keys(found))
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(weights, pa.int64()),
                pa.array(np.array(prints, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def candidates(rows: DataFrame, radius: int = simhash.RADIUS, blocks: int = simhash.BLOCKS) -> DataFrame:
    """(a, b): edges between nodes that connect all candidates."""
    # Nodes that share a key are linked to the smallest of them.
    keyed = rows.dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").drop("last")
    banded = keyed.join(firsts, "key").where("node > b").select(F.col("node").alias("a"), "b")
    printed = rows.select("node", "fingerprint").distinct()
    named = durable(printed.groupBy("fingerprint").agg(F.min("node").alias("first")))
    same = printed.join(named, "fingerprint").where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = simhash.links(named.select("fingerprint"), radius, blocks)
    a, b = (named.select(F.col("fingerprint").alias(side), F.col("first").alias(f"node_{side}")) for side in "ab")
    near = near.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return banded.unionByName(same).unionByName(near)


def alike(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all pairs of sets of that similarity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    new = np.cumsum(times > 1) - 1
    row, column = row[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    width = int((times > 1).sum())
    for at in range(0, width, _COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
        holds = np.zeros((len(sets), min(_COLUMNS, width - at)), np.float32)
        holds[row[lo:hi], column[lo:hi] - at] = 1
        common += (holds @ holds.T).astype(np.int64)  # at most _COLUMNS, exact
    up, down = similarity
    return np.nonzero(np.triu(down * common >= up * (sizes[:, None] + sizes - common), 1))


def _dealt(texts: DataFrame, part: int) -> DataFrame:
    """Add the number of `parts` that the texts of a root are dealt into."""
    nodes, weight = F.count("*"), F.sum("weight")
    one = (nodes <= 2 * part) & (weight <= 2 * PART_SHINGLES)
    parts = F.when(one, 1).otherwise(F.greatest(F.ceil(nodes / part), F.ceil(weight / PART_SHINGLES))).cast("int")
    parts = durable(texts.groupBy("root").agg(parts.alias("parts")))
    return join_lookup(texts, parts, "root", "node", fits_broadcast(parts))


def _part() -> Column:
    return F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")


def _compared(cells: DataFrame, n: int, similarity: tuple[int, int], leaders: bool = True) -> DataFrame:
    """Links (a, b) that connect what is alike in a cell.

    With `leaders`, texts of split roots that are not linked to a smaller place
    come back whole, with b null, for the next round.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "root", "weight")] + [T.StructField("packed", T.BinaryType())])

    def groups(root: int, parts: int, nodes: list[int], weights: list[int], texts: list[pa.Scalar]) -> Iterator[pa.RecordBatch]:
        parent = np.arange(len(nodes))
        if len(nodes) > 1:
            unpack = Unpack()
            sets = [shingles(unpack(t).decode("utf-8", "surrogatepass"), n) for t in texts]
            simhash._join_up(parent, *alike(sets, similarity))
            simhash._join_up(parent, np.zeros(1, np.int64), np.zeros(1, np.int64))
        first = parent == np.arange(len(nodes))
        out = np.flatnonzero(~first | (leaders and parts > 1))
        if len(out):
            names, leads = np.array(nodes, np.int64), first[out]
            columns = [
                pa.array(names[out]),
                pa.array(names[parent[out]], mask=leads),
                pa.array(np.full(len(out), root, np.int64), mask=~leads),
                pa.array(np.array(weights, np.int64)[out], mask=~leads),
                pa.array([texts[i].as_py() if lead else None for i, lead in zip(out, leads)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            roots, places, parts, names, weights = (batch.column(i).to_pylist() for i in range(5))
            for root, place, of, name, weight, text in zip(roots, places, parts, names, weights, batch.column(5)):
                if (root, place, of) != now:
                    if now is not None:
                        yield from groups(now[0], now[2], *held)
                    now, held = (root, place, of), ([], [], [])
                for column, value in zip(held, (name, weight, text)):
                    column.append(value)
        if now is not None:
            yield from groups(now[0], now[2], *held)

    rows = cells.select("root", "cell", "parts", "node", "weight", "packed")
    return rows.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(run, schema)


def _rarity(texts: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each counter occur; COUNTERS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, counts = Unpack(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = shingles(unpack(text).decode("utf-8", "surrogatepass"), n)
                counts += np.bincount((found % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["counter", "times"])

    total = np.zeros(COUNTERS, np.int64)
    found = texts.select("packed").mapInArrow(run, "counter long, times long").groupBy("counter").agg(F.sum("times").alias("times")).toArrow()
    total[found.column("counter").to_numpy()] = found.column("times").to_numpy()
    return total


def _rarest(texts: DataFrame, rarity: np.ndarray, n: int, similarity: tuple[int, int]) -> DataFrame:
    """(root, shingle, node, label): of each set so many of its rarest shingles that alike sets share one."""
    up, down = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Unpack()
        for batch in batches:
            roots, nodes, labels = (batch.column(i).to_pylist() for i in range(3))
            for root, node, label, text in zip(roots, nodes, labels, batch.column(3)):
                found = shingles(unpack(text).decode("utf-8", "surrogatepass"), n)
                least = -(-up * len(found) // down)  # what a set that is alike has in common with it, at least
                times = rarity[(found % np.uint64(COUNTERS)).astype(np.int64)]
                found = found[np.lexsort((found, times))[: len(found) - least + 1]].view(np.int64)
                same = [pa.array(np.full(len(found), value, np.int64)) for value in (root, node, label)]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(found), *same[1:]], names=["root", "shingle", "node", "label"])

    rows = texts.select("root", "node", "label", "packed")
    return rows.mapInArrow(run, "root long, shingle long, node long, label long")


def verified(texts: DataFrame, n: int = WORDS, similarity: tuple[int, int] = SIMILARITY, part: int = PART) -> DataFrame:
    """(a, b): of (root, node, weight, packed), edges that connect what is similar among the nodes of a root."""
    rounds, active, before = [], texts, None
    while True:
        seen = durable(_compared(_dealt(active, part).withColumn("cell", _part()), n, similarity))
        rounds.append(seen.where("b IS NOT NULL").select("a", "b"))
        leaders = seen.where("b IS NULL").select("root", F.col("a").alias("node"), "weight", "packed")
        left = leaders.count()
        if before is None:
            split = leaders.select("root").distinct()
        if left == 0 or before is not None and 2 * left > before:
            break
        active, before = leaders, left
    if before is None:
        return rounds[0]
    return stack(*rounds, _between_groups(texts, split, rounds, n, similarity, part))


def _between_groups(texts: DataFrame, split: DataFrame, rounds: list[DataFrame], n: int, similarity: tuple[int, int], part: int) -> DataFrame:
    """Edges between groups that no round has brought together."""
    labelled = texts.select("root", "node", F.col("node").alias("label"))
    split = durable(split)
    labelled = join_lookup(labelled, split, "root", "node", fits_broadcast(split))
    for links in rounds:
        up = links.select(F.col("a").alias("label"), F.col("b").alias("up"))
        labelled = labelled.join(up, "label", "left").select("root", "node", F.coalesce("up", "label").alias("label"))
    several = labelled.groupBy("root").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("root")
    several = durable(several)
    labelled = durable(join_lookup(labelled, several, "root", "node", fits_broadcast(several)))
    if labelled.isEmpty():
        return rounds[0].limit(0)
    rest = durable(texts.join(labelled.select("node", "label"), "node"))
    rarest = _rarest(rest, _rarity(rest, n), n, similarity)
    shared = (
        rarest.groupBy("root", "shingle")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo < hi")
        .select("root", "shingle")
    )
    unsure = durable(rarest.join(shared, ["root", "shingle"], "left_semi").select("node").distinct())
    dealt = _dealt(durable(rest.join(unsure, "node", "left_semi").drop("label")), part)
    mine, parts = _part(), F.col("parts")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.least(mine, other) * parts + F.greatest(mine, other))
    return _compared(dealt.withColumn("cell", F.explode(pairs)), n, similarity, leaders=False).select("a", "b")


def _rooted(
    rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, similarity: tuple[int, int], radius: int, blocks: int
) -> DataFrame:
    """(node, first, root): of each distinct set the row with the smallest id, and the component."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    distinct = durable(rows.groupBy("node").agg(first, F.max("weight").alias("weight")))
    coarse = stars(candidates(rows, radius, blocks))
    members = coarse.select(F.col("a").alias("node"), F.col("b").alias("root"))
    members = members.unionByName(coarse.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    wanted = durable(
        distinct.join(members, "node").select("root", "node", "weight", F.col("first.id").alias("id"), F.col("first.text_hash").alias("hash"))
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash"), F.col(text_col).alias("text"))
    same = texts["__id"].eqNullSafe(wanted["id"]) & (texts["__hash"] == wanted["hash"])
    # Candidates are few beside the documents, as a rule; their texts are then picked where they are read.
    texts = texts.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, same)
    texts = durable(packed(texts.select("root", "node", "weight", "text")).dropDuplicates(["node"]))
    roots = stars(verified(texts, n, similarity))
    rooted = distinct.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    return rooted.select("node", "first", F.coalesce("root", "node").alias("root"))


def _how(n: int = WORDS, similarity: tuple[int, int] = SIMILARITY, radius: int = simhash.RADIUS, blocks: int = simhash.BLOCKS) -> tuple:
    return n, similarity, radius, blocks


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, text_hash, node, component_id, chosen) of every row, as `simhash.clusters` has them.

    `how` is any of n, similarity, radius and blocks.
    """
    n, *rest = _how(**how)
    rows = durable(sketches(docs, id_col, text_col, n))
    rooted = _rooted(rows, docs, id_col, text_col, n, *rest)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("chosen"))
    named = rooted.join(firsts, "root").select("node", "chosen")
    return rows.select("id", "text_hash", "node").join(named, "node").withColumn("component_id", F.col("chosen.id"))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns."""
    n, *rest = _how(**how)
    rows = durable(sketches(docs, id_col, text_col, n))
    # Only the row that stands for a component is asked for: no large component is joined with its members.
    chosen = _rooted(rows, docs, id_col, text_col, n, *rest).groupBy("root").agg(F.min("first").alias("chosen"))
    return simhash.standing(docs, chosen, id_col, text_col)

"""SimHash near-duplicates, compared in bit slices.

Fingerprints are taken of shingles of words.  Two that differ in at most
`radius` of 64 bits agree on `BLOCKS - radius` of BLOCKS blocks of bits at
least, so every choice of that many blocks is a table, and rows meet where they
agree on all its bits.  A bucket of a table is compared bit-sliced: its
fingerprints stand in 64 bit planes, one lane each; a fingerprint is compared
with 64 lanes at a time by adding up the planes that differ in carry-save
counters, and lanes are given up as soon as all of a word exceed the radius.

Only distinct fingerprints are compared, and a task hands on a spanning forest
of the links it found, not the pairs.  Large buckets are dealt out in cells of
bounded size, every pair of parts in one cell, so no link is lost.  Components
of the links are found in rounds of joins.

A null text counts as empty; texts without words share the fingerprint zero.
Null ids are never a representative unless their component has no other id.
Repeated rows share a fingerprint.  Empty tables give empty results.  Other
columns are not read, and `kept` returns all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import durable
from gleaner.llm.components import stars

WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
#: Fingerprints that one part of a split bucket holds, on average.
PART = 1024
#: Comparisons of a fingerprint with a word of 64 lanes that are under way at once.
AT_ONCE = 1 << 19
_BATCH = 1 << 17


# -- fingerprints ---------------------------------------------------------------


def hashes(text: str | None, n: int = WORDS, seed: int = SEED) -> np.ndarray:
    """A hash of every shingle; of fewer words than `n`, one of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and blanks only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(n, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(ends))


def majority(hashes: np.ndarray) -> int:
    """64 bits; a bit is set if over half of the hashes have it."""
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BATCH):
        octets = hashes[at : at + _BATCH].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, n: int = WORDS, seed: int = SEED) -> int:
    return majority(hashes(text, n, seed))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(id, text_hash, fingerprint) of every row; the fingerprint as a signed long."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")
    )
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _signed([fingerprint(text.as_py(), n) for text in batch.column(2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found)], names=["id", "text_hash", "fingerprint"]
            )

    return rows.mapInArrow(run, schema)


# -- bit-sliced comparison ------------------------------------------------------


def _planes(prints: np.ndarray, places: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes over lanes, and the lanes in use: lane `places[i]` holds prints[i]."""
    lanes = np.zeros(64 * n_words, np.uint8)
    packed = lambda: np.packbits(lanes, bitorder="little").view("<u8")
    planes = np.empty((64, n_words), np.uint64)
    for bit in range(64):
        lanes[places] = (prints >> np.uint64(bit)) & np.uint64(1)
        planes[bit] = packed()
    lanes[places] = 1
    return planes, packed()


def _near(prints: np.ndarray, rows: np.ndarray, words: np.ndarray, planes: np.ndarray, used: np.ndarray, radius: int):
    """(row, word, lanes) with lanes the ones within the radius of the row."""
    width = max(3, (radius + 1).bit_length())
    counters = np.zeros((width, len(rows)), np.uint64)
    over = np.zeros(len(rows), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = prints[rows]

    def differing(bit: int) -> np.ndarray:
        flip = ((own >> np.uint64(bit)) & np.uint64(1)) * full
        return planes[bit][words] ^ flip

    def beyond() -> np.ndarray:
        """Lanes whose count exceeds the radius: count - (radius + 1) does not borrow."""
        borrow = np.zeros(len(rows), np.uint64)
        for place in range(width):
            subtrahend = full if (radius + 1) >> place & 1 else np.uint64(0)
            borrow = (~counters[place] & (subtrahend | borrow)) | (subtrahend & borrow)
        return over | ~borrow

    for at in range(0, 64, 3):
        planes_now = [differing(bit) for bit in range(at, min(at + 3, 64))]
        if len(planes_now) == 3:  # full adder: three planes into a sum and a carry
            half = planes_now[0] ^ planes_now[1]
            carry = (planes_now[0] & planes_now[1]) | (half & planes_now[2])
            total = half ^ planes_now[2]
        else:
            total, carry = planes_now[0], np.zeros(len(rows), np.uint64)
        up = counters[0] & total
        counters[0] ^= total
        half = counters[1] ^ carry
        up, counters[1] = (counters[1] & carry) | (half & up), half ^ up
        for place in range(2, width):
            up, counters[place] = counters[place] & up, counters[place] ^ up
        over |= up
        if at % 6 == 3 or at + 3 >= 64:
            near = used[words] & ~beyond()
            alive = near != 0
            if not alive.all():
                rows, words, own, over, near = rows[alive], words[alive], own[alive], over[alive], near[alive]
                counters = counters[:, alive]
            if not len(rows):
                break
    else:
        return rows, words, near
    return rows, words, np.zeros(0, np.uint64)


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of a[i] and b[i]; a root is the smallest of its tree."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(buckets: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius in a bucket; equal buckets stand together."""
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(buckets)])
    several = np.repeat(sizes > 1, sizes)
    prints, sizes = prints[several], sizes[sizes > 1]
    if not len(sizes):
        return prints[:0], prints[:0]
    n_words = -(-sizes // 64)
    first_row, first_word = np.cumsum(sizes) - sizes, np.cumsum(n_words) - n_words
    inside = np.arange(len(prints)) - np.repeat(first_row, sizes)
    own_word = np.repeat(first_word, sizes) + inside // 64
    planes, used = _planes(prints, own_word * 64 + inside % 64, int(n_words.sum()))
    row_of = np.full(64 * len(used), -1, np.int64)
    row_of[own_word * 64 + inside % 64] = np.arange(len(prints))
    todo = np.repeat(first_word + n_words, sizes) - own_word  # words from the own one on
    ends = np.cumsum(todo)
    parent, row = np.arange(len(prints)), 0
    while row < len(prints):
        upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + AT_ONCE, "right")))
        rows = np.repeat(np.arange(row, upto), todo[row:upto])
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(todo[row:upto]) - todo[row:upto], todo[row:upto])
        rows, words, near = _near(prints, rows, own_word[rows] + offset, planes, used, radius)
        for at in range(0, len(rows), 1 << 14):
            lanes = np.unpackbits(near[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, lane = np.nonzero(lanes)
            _join_up(parent, rows[at + which], row_of[words[at + which] * 64 + lane])
        row = upto
    _join_up(parent, np.zeros(1, np.int64), np.zeros(1, np.int64))
    linked = np.flatnonzero(parent != np.arange(len(prints)))
    return prints[linked], prints[parent[linked]]


def _masks(radius: int, blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of the table within the radius."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    tables = F.array(
        *[F.struct(F.lit(t).alias("table"), F.col("fingerprint").bitwiseAND(m).alias("key")) for t, m in enumerate(_masks(radius, blocks))]
    )
    keyed = prints.select("fingerprint", F.explode(tables).alias("k")).select("fingerprint", "k.*")
    large = keyed.groupBy("table", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * part)
    parts = large.select("table", "key", F.ceil(F.col("rows") / part).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    cell = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(mine, other) * F.col("parts") + F.greatest(mine, other)
    )
    cells = (
        keyed.join(parts, ["table", "key"], "left")
        .withColumn("cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(cell)))
        .select(F.xxhash64("table", "key", "cell").alias("bucket"), "fingerprint")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for last, batch in _with_last(batches):
            if batch is not None:
                held_b = np.r_[held_b, batch.column(0).to_numpy()]
                held_p = np.r_[held_p, batch.column(1).to_numpy().view(np.uint64)]
            if not len(held_b) or not last and len(held_b) < _BATCH:
                continue
            upto = len(held_b) if last else int(np.searchsorted(held_b, held_b[-1], "left"))
            a, b = forest(held_b[:upto], held_p[:upto], radius)
            held_b, held_p = held_b[upto:], held_p[upto:]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    # Buckets are told apart by a hash: two that fall together only add comparisons.
    return cells.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


# -- components -----------------------------------------------------------------


def clusters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, n: int = WORDS, blocks: int = BLOCKS
) -> DataFrame:
    """(id, text_hash, fingerprint, component_id, chosen) of every row.

    `component_id` is the smallest id of the component, `chosen` the id and
    text hash of the row that stands for it.
    """
    rows = durable(fingerprints(docs, id_col, text_col, n))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    distinct = durable(rows.groupBy("fingerprint").agg(first))
    roots = stars(links(distinct.select("fingerprint"), radius, blocks))
    rooted = distinct.join(roots.select(F.col("a").alias("fingerprint"), F.col("b").alias("root")), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("chosen"))
    named = rooted.join(firsts, "root").select("fingerprint", "chosen")
    return rows.join(named, "fingerprint").withColumn("component_id", F.col("chosen.id"))


def kept(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, n: int = WORDS, blocks: int = BLOCKS
) -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns."""
    return standing(docs, clusters(docs, id_col, text_col, radius, n, blocks), id_col, text_col)


def standing(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stand for the components of `found`, with all their columns."""
    chosen = found.select(F.col("chosen.id").alias("__id"), F.col("chosen.text_hash").alias("__hash")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash"), row.alias("__row"))
    same = rows["__id"].eqNullSafe(chosen["__id"]) & (rows["__hash"] == chosen["__hash"])
    return rows.join(chosen, same, "left_semi").dropDuplicates(["__id", "__hash"]).select("__row.*")

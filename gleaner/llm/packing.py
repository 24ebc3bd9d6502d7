"""Best-two-fit packing of tokenised documents into sequences.

A bin is filled greedily, the largest document that fits first.  Then its
smallest document is replaced by two unpacked ones if these fill the gap that
its removal leaves more tightly.

Lengths are whole numbers up to the size of a sequence, so the plan is made on
the number of pieces of each length, at most `size` numbers whatever the
corpus: a bin's pattern is used as often as the counts allow, and each use of a
length in a pattern owns a range of the pieces of that length.  Pieces are
ordered by length over the cluster, and a piece finds its sequence by its
place in that order.

A null text is an empty document, one end token.  Null and repeated ids are
packed row by row.  An empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import durable, positioned

SIZE = 1024
END = 2
TOKENIZER = "byte_bpe_50k"
#: A stretch without blanks of this length goes to the slower library, which takes it in linear time.
LONG_STRETCH = 4_000


# -- tokens ---------------------------------------------------------------------


@lru_cache(maxsize=2)
def encoder(folder: str | None, name: str) -> Callable[[str], np.ndarray]:
    """Text to ids.  The same byte-level vocabulary is read by two libraries: the
    faster one takes ordinary texts, the other one is the definition."""
    import os

    import public_tokenizers
    import tiktoken
    import tokenizers

    at = (lambda f: os.path.join(folder, f)) if folder else public_tokenizers.path
    slow = tokenizers.Tokenizer.from_file(at(f"{name}.json"))
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    with open(at(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        if len(text) <= LONG_STRETCH or max(map(len, text.split()), default=0) <= LONG_STRETCH:
            if "  " * 500 not in text:
                return np.asarray(fast.encode(text, allowed_special="all"), np.uint32)
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end: int = END,
    folder: str | None = None,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(id, piece, start, length, crc): documents with their end token, cut where longer than a sequence.

    The remainder of a cut document is its first piece.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("crc", T.LongType()))]
    schema = T.StructType([rows.schema["id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), piece.append(n), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            columns = [pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


# -- the plan -------------------------------------------------------------------


@dataclass(frozen=True)
class Use:
    """Pieces of one length from `first` on fill `offsets`, in turn, of sequences from `sequence` on."""

    length: int
    first: int
    sequence: int
    offsets: tuple[int, ...]


class _Stock:
    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.count)

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            del self.count[length]
            self.lengths.remove(length)

    def give(self, length: int) -> None:
        if length not in self.count:
            self.count[length] = 0
            insort(self.lengths, length)
        self.count[length] += 1

    def largest(self, most: int) -> int:
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else 0

    def best_two(self, most: int, least: int) -> tuple[int, int] | None:
        """The two pieces whose sum comes nearest to `most`, above `least`."""
        best, found = least, None
        for at in range(bisect_right(self.lengths, most - 1), 0, -1):
            a = self.lengths[at - 1]
            if 2 * a <= best:
                break
            b = self.largest(min(a, most - a))
            if b == a and self.count[a] < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == most:
                    break
        return found


def _bin(stock: _Stock, size: int) -> list[int]:
    """Take one bin from the stock."""
    inside, gap = [], size
    while gap and (length := stock.largest(gap)):
        stock.take(length)
        inside.append(length)
        gap -= length
    while gap and inside:
        smallest = inside[-1]
        two = stock.best_two(gap + smallest, smallest)
        if not two:
            break
        stock.give(smallest)
        inside.pop()
        for length in two:
            stock.take(length)
        inside = sorted([*inside, *two], reverse=True)
        gap = size - sum(inside)
    return inside


def plan(counts: dict[int, int], size: int = SIZE) -> list[Use]:
    """Which pieces go where, from the number of pieces of each length."""
    stock, used, uses, sequence = _Stock(counts), dict.fromkeys(counts, 0), [], 0
    while stock.lengths:
        inside = _bin(stock, size)
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in inside:
            offsets.setdefault(length, []).append(at)
            at += length
        again = min(stock.count.get(length, 0) // len(places) for length, places in offsets.items())
        for length, places in offsets.items():
            uses.append(Use(length, used[length], sequence, tuple(places)))
            used[length] += (again + 1) * len(places)
            if again:
                stock.count[length] -= again * len(places)
                if not stock.count[length]:
                    del stock.count[length]
                    stock.lengths.remove(length)
        sequence += again + 1
    return uses


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add `sequence` and `offset` to pieces.  `size` counts at most come to the driver."""
    cut = durable(cut)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    before, first = {}, 0
    for length in sorted(counts):
        before[length], first = first, first + counts[length]
    uses = sorted(plan(counts, size), key=lambda use: before[use.length] + use.first)
    starts = np.array([before[u.length] + u.first for u in uses], np.int64)
    sequences = np.array([u.sequence for u in uses], np.int64)
    widths = np.array([len(u.offsets) for u in uses], np.int64)
    first_offset = np.cumsum(widths) - widths
    offsets = np.array([o for u in uses for o in u.offsets], np.int64)
    placed = positioned(cut.withColumn("mix", F.xxhash64("id", "piece", "crc")), ["length", "mix", "id", "piece", "crc"], "pos").drop("mix")
    schema = T.StructType([*placed.drop("pos").schema.fields, T.StructField("sequence", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(batch.schema.get_field_index("pos")).to_numpy()
            use = np.searchsorted(starts, pos, "right") - 1
            copy, slot = np.divmod(pos - starts[use], widths[use])
            kept = [batch.column(batch.schema.get_field_index(n)) for n in schema.names[:-2]]
            found = [pa.array(sequences[use] + copy), pa.array(offsets[first_offset[use] + slot])]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=schema.names)

    return placed.mapInArrow(run, schema)

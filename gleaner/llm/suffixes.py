"""Repeated byte strings by external induced sorting of suffixes.

A document loses every byte covered by a string of `length` bytes that also
starts in a document with a smaller id: suffixes whose common prefix is that
long.  Not all suffixes are sorted.  As in induced sorting, a sample of them is
(the anchors, chosen by content: every string of the length holds one), and the
others get their order from these:

1. Anchors are named by the gram they start with and by the block of strings
   around them, and sorted by name in Spark's shuffle, which spills sorted runs
   to disk and merges them with a priority queue, so a shard may be far larger
   than memory.  Tuples with a name of their own drop out.  A block with one
   name in several documents is decided as a whole.
2. Where one gram has several blocks, anchor suffixes are sorted by their bytes
   with the common prefix of neighbours.  The suffixes one byte further left
   are induced: stably by their first byte in the order found so far, with the
   common prefix one longer than the least that lies between.  Each step again
   carries (suffix, common prefix) to the next, up to the distance between a
   string and its anchor.  Suffixes that share `length` bytes stand in a run,
   and the smallest id of a run keeps the string.

A null text has no bytes.  A null id counts as the largest; rows with equal
ids never remove from each other, so repeated rows lose the same bytes.
Shorter documents keep all.  Empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import anchors
from gleaner.llm.common import written
from gleaner.llm.texts import Unpack, keyed, packed

LENGTH = 50
GRAM = 20
#: Anchor suffixes that are sorted together in a task.
CHUNK = 1 << 16
#: Suffixes of one gram that a task holds; of more, the strings are compared by two hashes.
GROUP = 1 << 18
_APART = -(1 << 20)
_BYTES = anchors.byte_units()


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def _named(lists: list[np.ndarray]) -> np.ndarray:
    """Names of the blocks that are listed for each of a few documents."""
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return anchors.keys(doc, np.concatenate(lists))


def _list(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy().view(np.uint64) if value.is_valid else np.zeros(0, np.uint64)


# -- naming anchors ---------------------------------------------------------------


def anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, content, doc) of every distinct block of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1))
            for some in anchors.grouped(zip(batch.column(0).to_pylist(), texts), lambda r: len(r[1])):
                joined = anchors.Joined([text for _, text in some])
                b = anchors.blocks(anchors.Ranges(joined.units), joined.ends, length, gram).distinct()
                doc = np.array([d for d, _ in some], np.int64)[b.doc]
                columns = [_longs(c) for c in (b.anchor, b.content, doc)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "doc"])

    return rows.select("doc", "text").mapInArrow(run, "anchor long, content long, doc long")


def shared_anchors(found: DataFrame) -> DataFrame:
    """Per document, `gone`: blocks that a smaller document has; `part`: blocks to sort.

    Rows arrive sorted by gram, block and document.  A block is sorted in its
    smallest document only, and only if its gram has other blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last block seen, its owner, whether its gram has several, and whether the owner is still to tell.
        last: tuple[int, int, int, bool] | None = None
        for batch in batches:
            anchor, content, doc = (c.to_numpy() for c in batch.columns)
            if not len(anchor):
                continue
            several, carried = False, last is not None
            if last is not None:
                anchor, content, doc = np.r_[last[0], anchor], np.r_[last[1], content], np.r_[last[2], doc]
                several = last[3]
            new_gram = np.r_[True, anchor[1:] != anchor[:-1]]
            new_block = new_gram | np.r_[True, content[1:] != content[:-1]]
            heads = np.flatnonzero(new_block)
            owner = doc[heads][np.cumsum(new_block) - 1]
            gram = np.cumsum(new_gram) - 1
            blocks = np.bincount(gram[heads])
            many = blocks > 1
            many[0] |= several
            gone = np.flatnonzero(doc > owner)
            part = heads[many[gram[heads]]]
            if carried and several:
                part = part[part > 0]  # told before
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[doc[gone], doc[part]]),
                    pa.array(np.r_[content[gone], content[part]]),
                    pa.array(np.r_[np.zeros(len(gone), bool), np.ones(len(part), bool)]),
                ],
                names=["doc", "content", "part"],
            )
            last = (anchor[-1], content[-1], owner[-1], bool(many[gram[-1]]))

    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "content", "doc")
    told = ordered.mapInArrow(run, "doc long, content long, part boolean")
    return told.groupBy("doc").agg(
        F.collect_list(F.when(~F.col("part"), F.col("content"))).alias("gone"),
        F.collect_list(F.when(F.col("part"), F.col("content"))).alias("part"),
    )


# -- sorting suffixes -------------------------------------------------------------


def suffix_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchor suffixes of the blocks to sort, with the bytes before them, nearest first.

    `low` and `high` bound the distance from a string of the block to the anchor.
    """
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Unpack()
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), map(unpack, batch.column(1)), map(_list, batch.column(2)))
            for some in anchors.grouped(rows, lambda r: len(r[1])):
                joined = anchors.Joined([text for _, text, _ in some])
                b = anchors.blocks(anchors.Ranges(joined.units), joined.ends, length, gram)
                b = b.take(np.isin(b.keys(), _named([part for _, _, part in some]))).distinct()
                starts = np.r_[0, joined.ends[:-1]]
                begin = np.maximum(b.place - reach, starts[b.doc]).tolist()
                end = np.minimum(b.place + length, joined.ends[b.doc]).tolist()
                place, whole = b.place.tolist(), joined.whole
                doc = np.array([d for d, _, _ in some], np.int64)[b.doc]
                columns = [
                    _longs(b.anchor),
                    pa.array([whole[p:e] for p, e in zip(place, end)], pa.binary()),
                    pa.array([whole[s:p][::-1] for s, p in zip(begin, place)], pa.binary()),
                    *map(_longs, (b.place - b.last, b.place - b.first, doc, b.content)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "right", "left", "low", "high", "doc", "content"])

    return texts.mapInArrow(run, "anchor long, right binary, left binary, low long, high long, doc long, content long")


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    """Bytes of the strings, -1 beyond their ends."""
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width).astype(np.int16)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    flat[np.arange(width)[None, :] >= lengths[:, None]] = -1
    return flat


def induce(
    group: np.ndarray, right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray, doc: np.ndarray, length: int
) -> np.ndarray:
    """For each anchor suffix the bits of the distances at which a smaller document has the string.

    Suffixes are given by group, sorted by `right` in each.
    """
    n, masks = len(group), np.zeros(len(group), np.int64)
    suffix, before = _matrix(right, length), _matrix(left, max(map(len, left), default=0) or 1)
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(1), differ.argmax(1), length)
    common = np.r_[_APART, np.where(group[1:] == group[:-1], common, _APART)]
    order = np.arange(n)
    for distance in range(int(high.max(initial=-1)) + 1):
        if distance:
            key = group[order] * 512 + before[order, distance - 1] + 1
            step = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[step][1:] == key[step][:-1]) + 1
            between = np.ravel(np.column_stack([step[same - 1] + 1, step[same] + 1]))
            longer = np.full(n, _APART)
            if len(same):
                longer[same] = 1 + np.minimum.reduceat(np.r_[common, 0], between)[::2]
            order, common = order[step], longer
        starts = np.flatnonzero(common < length)
        owner = np.minimum.reduceat(doc[order], starts)[np.cumsum(common < length) - 1]
        lost = order[(doc[order] > owner) & (low[order] <= distance) & (distance <= high[order])]
        masks[lost] |= 1 << distance
    return masks


def shared_strings(suffixes: DataFrame, length: int) -> DataFrame:
    """(doc, content, mask): distances at which the strings of a block also start in a smaller document."""

    def single(rows: dict) -> dict[str, np.ndarray]:
        """The strings of a very large group one by one, named by two hashes."""
        columns: list[list] = [[] for _ in range(5)]
        for left, right, low, high, doc, content in zip(*(rows[c] for c in ("left", "right", "low", "high", "doc", "content"))):
            data = np.frombuffer(left[::-1] + right, np.uint8)
            for distance in range(low, high + 1):
                at = len(left) - distance
                unit = _BYTES[data[at : at + length]]
                for c, v in zip(columns, (doc, content, 1 << distance, *(int(anchors.Ranges(unit, b).windows(length)[0]) for b in (anchors.BASE, anchors.OTHER_BASE)))):
                    c.append(v)
        names = ("doc", "content", "mask", "one", "two")
        return {c: np.array(v, np.uint64).view(np.int64) if c in ("one", "two") else np.array(v, np.int64) for c, v in zip(names, columns)}

    def table(found: dict[str, np.ndarray], lost: bool) -> pa.RecordBatch:
        columns = [pa.array(found[c]) for c in ("doc", "content", "mask", "one", "two")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), lost))], names=["doc", "content", "mask", "one", "two", "lost"])

    def induced(rows: dict) -> pa.RecordBatch:
        anchor = np.array(rows["anchor"], np.int64)
        group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]])
        low, high, doc, content = (np.array(rows[c], np.int64) for c in ("low", "high", "doc", "content"))
        masks = induce(group, rows["right"], rows["left"], low, high, doc, length)
        hit = masks != 0
        return table({"doc": doc[hit], "content": content[hit], "mask": masks[hit], "one": content[hit], "two": doc[hit]}, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        large: int | None = None  # the gram whose rows are sent on one by one
        for batch in batches:
            for c, values in batch.to_pydict().items():
                held.setdefault(c, []).extend(values)
            grams = held["anchor"]
            if len(grams) < CHUNK:
                continue
            edge = _first_of(grams, grams[-1])
            done = {c: v[:edge] for c, v in held.items()}
            held = {c: v[edge:] for c, v in held.items()}
            if large is not None and done["anchor"]:
                own = _past(done["anchor"], large)
                yield table(single({c: v[:own] for c, v in done.items()}), False)
                done = {c: v[own:] for c, v in done.items()}
            if done["anchor"]:
                yield induced(done)
            if len(held["anchor"]) > GROUP or large == held["anchor"][-1]:
                large = held["anchor"][-1]
                yield table(single(held), False)
                held = {c: [] for c in held}
            elif large != held["anchor"][-1]:
                large = None
        if held and held["anchor"]:
            own = _past(held["anchor"], large) if large is not None else 0
            if own:
                yield table(single({c: v[:own] for c, v in held.items()}), False)
            if own < len(held["anchor"]):
                yield induced({c: v[own:] for c, v in held.items()})

    ordered = suffixes.repartition("anchor").sortWithinPartitions("anchor", "right", "doc")
    rows = ordered.mapInArrow(run, "doc long, content long, mask long, one long, two long, lost boolean")
    owner = F.min("doc").over(Window.partitionBy("one", "two"))
    return rows.withColumn("owner", owner).where("lost or doc > owner").select("doc", "content", "mask")


def _first_of(values: list[int], value: int) -> int:
    at = len(values)
    while at and values[at - 1] == value:
        at -= 1
    return at


def _past(values: list[int], value: int) -> int:
    at = 0
    while at < len(values) and values[at] == value:
        at += 1
    return at


# -- removing ---------------------------------------------------------------------


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, spans, kept): spans are the removed byte ranges, ends exclusive; kept the other bytes."""
    if not 0 < length - gram < 63:
        raise ValueError("a gram must be shorter than the length, by less than 63")
    rows = keyed(docs, id_col, text_col)
    marked = written(shared_anchors(anchor_rows(rows, length, gram)))
    # The texts are shuffled once; both joins below reuse it.
    texts = packed(rows).repartition("doc")
    part = marked.where(F.size("part") > 0).select("doc", "part")
    suffixes = suffix_rows(texts.join(part, "doc").select("doc", "packed", "part"), length, gram)
    strings = shared_strings(suffixes, length).groupBy("doc").agg(F.collect_list(F.struct("content", "mask")).alias("strings"))
    lists = marked.where(F.size("gone") > 0).select("doc", "gone").join(strings, "doc", "full_outer")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Unpack()
        for batch in batches:
            counts, spans, kept = [], [], []
            rows = zip(map(unpack, batch.column(1)), map(_list, batch.column(2)), batch.column(3))
            for some in anchors.grouped(rows, lambda r: len(r[0])):
                joined = anchors.Joined([text for text, _, _ in some])
                b = anchors.blocks(anchors.Ranges(joined.units), joined.ends, length, gram)
                hit = np.isin(b.keys(), _named([gone for _, gone, _ in some]))
                _, starts = anchors.spread(b.first[hit], b.last[hit])
                lost = anchors.covered(np.r_[starts, _single(b, [strings for _, _, strings in some])], length, len(joined.data))
                for first, end in zip([0, *joined.ends[:-1].tolist()], joined.ends.tolist()):
                    own, data = lost[first:end], joined.data[first:end]
                    any_lost = own.any()
                    edge = np.flatnonzero(np.diff(np.r_[False, own, False])) if any_lost else np.zeros(0, np.int64)
                    counts.append(end - first)
                    spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                    kept.append(data[~own].tobytes() if any_lost else joined.whole[first:end])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=schema.names,
            )

    joined = texts.join(lists, "doc", "left").select("id", "packed", "gone", "strings")
    return joined.mapInArrow(run, schema)


def _single(b: anchors.Blocks, strings: list[pa.Scalar]) -> np.ndarray:
    """Starts of the strings that are listed for some documents by block and distance."""
    lists = [x.values for x in strings if x.is_valid]
    if not sum(map(len, lists)):
        return np.zeros(0, np.int64)
    doc = np.repeat(np.flatnonzero([x.is_valid for x in strings]), [len(x) for x in lists])
    content = np.concatenate([x.field("content").to_numpy().view(np.uint64) for x in lists])
    mask = np.concatenate([x.field("mask").to_numpy() for x in lists])
    named = anchors.keys(doc, content)
    order = np.argsort(named, kind="stable")
    names, first = np.unique(named[order], return_index=True)
    masks = np.bitwise_or.reduceat(mask[order], first)
    own = b.keys()
    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
    bits = np.where(names[at] == own, masks[at], 0)
    listed = np.flatnonzero(bits)
    which, distance = np.nonzero((bits[listed][:, None] >> np.arange(63)[None, :]) & 1)
    return b.place[listed[which]] - distance

"""Repeated word windows, by Rabin-Karp hashes counted in Spark.

A window is `length` consecutive words.  A document loses every word covered by
a window whose words also stand in a document with a smaller id; windows are
judged on the input.

Every document gets the rolling hash of all its windows.  Sending each would
shuffle several times the corpus, so windows travel in blocks (`anchors`): a
block is counted by one hash, and decides all its windows where another
document has the whole block.  Windows of blocks that are only partly shared
are sent one by one and counted by their own hash.  Removed windows merge into
maximal intervals where the text is.

A null text has no words.  A null id counts as the largest; rows with equal ids
never remove from each other, so repeated rows lose the same words.  Documents
below `length` words keep all.  Empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import anchors
from gleaner.llm.common import written
from gleaner.llm.texts import Unpack, keyed, packed

LENGTH = 50
GRAM = 8


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_longs(c) for c in columns.values()], names=list(columns))


def _list(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy().view(np.uint64) if value.is_valid else np.zeros(0, np.uint64)


def _named(lists: list[np.ndarray]) -> np.ndarray:
    """Names of what is listed for each of a few documents."""
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return anchors.keys(doc, np.concatenate(lists))


def block_rows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(anchor, content, doc) of every distinct block of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1))
            for some in anchors.grouped(zip(batch.column(0).to_pylist(), texts), lambda r: len(r[1])):
                words = anchors.Words([text for _, text in some])
                b = anchors.blocks(anchors.Ranges(words.units), words.ends, length, gram).distinct()
                doc = np.array([d for d, _ in some], np.int64)[b.doc]
                yield _table(anchor=b.anchor, content=b.content, doc=doc)

    return rows.select("doc", "text").mapInArrow(run, "anchor long, content long, doc long")


def marks(found: DataFrame) -> DataFrame:
    """Per document, `gone`: blocks that a smaller document has; `part`: blocks to look into.

    A block is looked into in its smallest document only, and only if its
    anchor has other blocks, too: all others share the fate of its windows.
    """
    owners = found.groupBy("anchor", "content").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
    several = owners.groupBy("anchor").agg(F.count("*").alias("blocks")).where("blocks > 1").select("anchor", F.lit(True).alias("several"))
    judged = (
        owners.join(several, "anchor", "left")
        .withColumn("several", F.coalesce("several", F.lit(False)))
        .where("several or owner < last")
    )
    rows = found.join(judged, ["anchor", "content"]).where("doc > owner or several")
    return rows.groupBy("doc").agg(
        F.collect_list(F.when(F.col("doc") > F.col("owner"), F.col("content"))).alias("gone"),
        F.collect_list(F.when(F.col("doc") == F.col("owner"), F.col("content"))).alias("part"),
    )


def window_rows(texts: DataFrame, marked: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(one, two, doc): two independent hashes of every distinct window of the blocks to look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Unpack()
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), map(unpack, batch.column(1)), map(_list, batch.column(2)))
            for some in anchors.grouped(rows, lambda r: len(r[1])):
                words = anchors.Words([text for _, text, _ in some])
                ranges = anchors.Ranges(words.units)
                b = anchors.blocks(ranges, words.ends, length, gram)
                b = b.take(np.isin(b.keys(), _named([part for _, _, part in some])))
                which, window = anchors.spread(b.first, b.last)
                doc = np.array([d for d, _, _ in some], np.int64)[b.doc[which]]
                one = ranges.windows(length)[window]
                two = anchors.Ranges(words.units, anchors.OTHER_BASE).windows(length)[window]
                at = np.unique(anchors.keys(b.doc[which], one), return_index=True)[1]
                yield _table(one=one[at], two=two[at], doc=doc[at])

    joined = texts.select("doc", "packed").join(marked.where(F.size("part") > 0).select("doc", "part"), "doc")
    return joined.mapInArrow(run, "one long, two long, doc long")


def shared_windows(windows: DataFrame) -> DataFrame:
    """(doc, windows): the windows that a smaller document has, per document."""
    windows = written(windows)
    owners = windows.groupBy("one", "two").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last")
    later = windows.join(owners, ["one", "two"]).where("doc > owner")
    return later.groupBy("doc").agg(F.collect_list("one").alias("windows"))


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, text, n_words, spans, kept_text): spans are the removed intervals of words, ends exclusive."""
    rows = keyed(docs, id_col, text_col)
    marked = written(marks(written(block_rows(rows, length, gram))))
    texts = packed(rows)
    windows = shared_windows(window_rows(texts, marked, length, gram))
    lists = marked.where(F.size("gone") > 0).select("doc", "gone").join(windows, "doc", "full_outer")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("kept_text", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Unpack()
        for batch in batches:
            counts, spans, kept = [], [], []
            rows = zip(map(unpack, batch.column(1)), map(_list, batch.column(2)), map(_list, batch.column(3)))
            for some in anchors.grouped(rows, lambda r: len(r[0])):
                words = anchors.Words([text for text, _, _ in some])
                ranges = anchors.Ranges(words.units)
                b = anchors.blocks(ranges, words.ends, length, gram)
                hit = np.isin(b.keys(), _named([gone for _, gone, _ in some]))
                _, starts = anchors.spread(b.first[hit], b.last[hit])
                which, window = anchors.spread(b.first, b.last)
                alone = np.isin(anchors.keys(b.doc[which], ranges.windows(length)[window]), _named([one for _, _, one in some]))
                lost = anchors.covered(np.r_[starts, window[alone]], length, len(words.start))
                for first, end in zip([0, *words.ends[:-1].tolist()], words.ends.tolist()):
                    own = lost[first:end]
                    edge = np.flatnonzero(np.diff(np.r_[False, own, False])) if own.any() else np.zeros(0, np.int64)
                    counts.append(end - first)
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                    stay = np.flatnonzero(~own) + first
                    kept.append(b" ".join(words.whole[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()),
                ],
                names=schema.names,
            )

    joined = texts.join(lists, "doc", "left").select("id", "packed", "gone", "windows")
    return joined.mapInArrow(run, schema)

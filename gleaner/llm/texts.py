"""Texts keyed by document, for operators that bring texts and findings together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST_ID = (1 << 63) - 1
LEVEL = 3


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, text): `doc` is the id, null as the largest."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    return docs.select(key.alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def packed(rows: DataFrame) -> DataFrame:
    """The last column, a text, becomes `packed`: its UTF-8 bytes, compressed, for the shuffle.

    Spark's own shuffle codec does not code entropy and hardly shortens prose;
    this halves what a shuffle of texts writes.  A null text is packed as empty.
    """
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            texts = [squeeze.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


class Unpack:
    """The bytes of a packed text."""

    def __init__(self) -> None:
        self.stream = zstandard.ZstdDecompressor()

    def __call__(self, value: pa.Scalar) -> bytes:
        data = value.as_buffer()
        return self.stream.decompress(data) if data.size else b""

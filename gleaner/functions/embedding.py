"""A model-free text embedding: hashed term counts on the unit sphere."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.arrow_tokens import blocks, token_counts

DIMENSIONS = 64


def bucket(term: str, dimensions: int = DIMENSIONS) -> int:
    return int.from_bytes(hashlib.md5(term.encode()).digest()[:4]) % dimensions


def _embedded(texts: pa.Array, dimensions: int) -> np.ndarray:
    """A row per text; a term is hashed once per block."""
    counts = token_counts(texts)
    place = np.array([bucket(t, dimensions) for t in counts.terms.to_pylist()], np.int64)
    cell = counts.owner * dimensions + place[counts.term]
    n = np.bincount(cell, counts.n, len(texts) * dimensions).reshape(-1, dimensions)
    norm = np.sqrt((n * n).sum(axis=1, keepdims=True))
    return (n / np.where(norm > 0, norm, 1)).astype(np.float32)


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """array<float> of length one; all zeros for a text without tokens."""

    @F.arrow_udf("array<float>")
    def embedded(texts: pa.Array) -> pa.Array:
        rows = [_embedded(own, dimensions) for _, own in blocks(texts)]
        flat = np.concatenate(rows).reshape(-1) if rows else np.empty(0, np.float32)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dimensions, pa.array(flat))

    return embedded(text)

"""Tokens of many texts at once, for jobs that read every text.

The same tokens as `text.tokens`, counted per text.  Words are cut from the bytes
of an Arrow array, and lower case, camel parts and stop words are worked out once
per distinct word of a block instead of once per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.functions.text import CAMEL_PART, CAMEL_SEAM, STOP_WORDS

# Text that is taken apart at once.
BLOCK_BYTES = 8 << 20
_STOP = pa.array(STOP_WORDS)


@dataclass(frozen=True)
class Counts:
    """(owner, term, n): how often a text has a term, by term and text.  Terms are numbered in code point order."""

    owner: np.ndarray
    term: np.ndarray
    n: np.ndarray
    terms: pa.Array


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of bounded size with their first row; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, texts.slice(at, until - at)
        at = until


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of ASCII letters and digits, and the text of each; a null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    # Letters are told in either case; smaller bytes wrap around.
    inside = (((raw | 0x20) - np.uint8(ord("a"))) < 26) | ((raw - np.uint8(ord("0"))) < 10)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    seam = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(raw))]  # a word ends with its text
    begins[seam] = inside[seam]
    stops[seam - 1] = inside[seam - 1]
    at = np.flatnonzero(begins)
    starts = np.zeros(len(at) + 1, np.int32)
    np.cumsum(np.flatnonzero(stops) + 1 - at, out=starts[1:])
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(raw[inside]))
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, ends))), words


def token_counts(texts: pa.Array) -> Counts:
    owner, words = _words(texts)
    coded = words.dictionary_encode()
    word, known = coded.indices.to_numpy(), coded.dictionary
    # Tokens of each distinct word: itself, and its parts where it has a seam.
    tokens, whose = [pc.ascii_lower(known)], [np.arange(len(known))]
    seams = np.flatnonzero(pc.match_substring_regex(known, CAMEL_SEAM).to_numpy(zero_copy_only=False))
    parts = [re.findall(CAMEL_PART, w) for w in known.take(pa.array(seams)).to_pylist()]
    tokens.append(pa.array([p.lower() for own in parts for p in own], pa.string()))
    whose.append(np.repeat(seams, [len(own) for own in parts]))
    token, whose = pa.concat_arrays(tokens), np.concatenate(whose)
    kept = pc.and_(pc.greater(pc.binary_length(token), 1), pc.invert(pc.is_in(token, value_set=_STOP)))
    token, whose = token.filter(kept), whose[kept.to_numpy(zero_copy_only=False)]
    terms = pc.unique(token)
    terms = terms.take(pc.array_sort_indices(terms))
    number = pc.index_in(token, value_set=terms).to_numpy()
    # Numbers of a word's tokens, one list after the other.
    order = np.argsort(whose, kind="stable")
    count = np.bincount(whose, minlength=len(known))
    begin = np.cumsum(count) - count
    each = count[word]
    place = np.repeat(begin[word] - np.cumsum(each) + each, each)
    place += np.arange(len(place))
    code = (number[order].astype(np.int64) * len(texts))[place]
    code += np.repeat(owner, each)
    code.sort()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    code = code[first]
    n = np.diff(np.append(first, len(place)))
    term = code // max(1, len(texts))
    return Counts(code - term * len(texts), term, n, terms)

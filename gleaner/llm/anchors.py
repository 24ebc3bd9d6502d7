"""Windows of a sequence grouped by anchors that depend on their content alone.

A window of `length` units holds `length - k + 1` grams of k units; its anchor
is the leftmost gram with the smallest hash.  Equal windows have equal anchors
at the same place, whatever surrounds them, so windows can only be equal if
their anchors are.  Neighbouring windows mostly share an anchor; a block is a
run of windows of a document with one anchor, and equal blocks hold the same
windows one by one.

Hashes are polynomials modulo 2 ** 64 over 64-bit unit hashes, taken as
differences of prefix sums.  They are used for up to about a hundred units;
patterns of which two share a polynomial of any base are some thousand units
long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD1342543DE82EF95
_PLACE_BITS = 28
#: Bytes from which a word is named by XXH64 instead.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of a hash."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base; the longest run asked for is kept."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(1 << max(14, n.bit_length()), base, np.uint64)
        kept[0] = 1
        kept = _POWERS[base] = np.cumprod(kept)
    return kept[:n]


@lru_cache(maxsize=4)
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_COUNT = np.arange(1 << 14, dtype=np.uint64)


def _count(n: int) -> np.ndarray:
    return _COUNT[:n] if n <= len(_COUNT) else np.arange(n, dtype=np.uint64)


class Ranges:
    """Hashes of any range of a sequence of unit hashes."""

    def __init__(self, units: np.ndarray, base: int = BASE):
        self.back = powers(_inverse(base), len(units) + 1)
        self.sums = np.empty(len(units) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(units * powers(base, len(units)), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of the length."""
        n = max(0, len(self.sums) - length)
        out = self.sums[length:] - self.sums[:n]
        out *= self.back[:n]
        return out


@dataclass
class Blocks:
    """Runs of windows with one anchor: document, first and last window, anchor place, anchor hash, block hash."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    content: np.ndarray

    def take(self, at: np.ndarray) -> Blocks:
        return Blocks(*(getattr(self, f.name)[at] for f in fields(self)))

    def keys(self) -> np.ndarray:
        return keys(self.doc, self.content)

    def distinct(self) -> Blocks:
        """One of the equal blocks of each document."""
        return self.take(np.unique(self.keys(), return_index=True)[1])


def keys(doc: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Names of blocks within a few documents."""
    return content ^ mix(doc.astype(np.uint64) + np.uint64(1))


def blocks(ranges: Ranges, ends: np.ndarray, length: int, k: int) -> Blocks:
    """The blocks of documents that stand behind each other, `ends` being their ends.

    Many short documents are taken at once: each step is one array operation.
    """
    total = len(ranges.sums) - 1
    n = max(0, total - length + 1)
    grams = ranges.windows(k)  # of random units: the high bits are as good as random
    width, step = length - k + 1, 1 << (_PLACE_BITS - 1)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    place = np.empty(n, np.int64)
    for at in range(0, n, step):  # places of a stretch fit the low bits
        some = grams[at : at + step + width - 1]
        least = some & ~low
        least |= _count(len(some))
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest, count = width - span, len(some) - width + 1
        least = np.minimum(least[:count], least[rest : rest + count])
        least &= low
        place[at : at + count] = least.view(np.int64)
        if at:
            place[at : at + count] += at
    starts = np.r_[0, ends[:-1]]
    # Windows start in [starts, ends - length]; all others reach into the next document.
    valid = np.zeros(n + 1, np.int8)
    long_enough = ends - starts >= length
    valid[starts[long_enough]] += 1
    valid[ends[long_enough] - length + 1] -= 1
    valid = np.cumsum(valid[:n], dtype=np.int8).view(bool)
    begins = valid.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    stops = valid.copy()
    stops[:-1] &= begins[1:] | ~valid[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    place = place[first]
    content = ranges.hash(first, last + length)
    shape = ((last - first).astype(np.uint64) << np.uint64(32)) | (place - first).astype(np.uint64)
    doc = np.searchsorted(ends, first, "right")
    return Blocks(doc, first, last, place, grams[place], mix(content + mix(shape + np.uint64(1))))


def grouped(rows: Iterable, size: Callable[[object], int], limit: int = 1 << 17) -> Iterator[list]:
    """Rows in lists whose sizes add up to about the limit."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def byte_units() -> np.ndarray:
    """A random unit hash for every byte."""
    return mix(np.arange(1, 257, dtype=np.uint64))


_BYTES = byte_units()


class Joined:
    """Texts behind each other, as bytes: their array, ends and unit hashes."""

    def __init__(self, texts: list[bytes]):
        self.whole = b"".join(texts)
        self.data = np.frombuffer(self.whole, np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.units = _BYTES[self.data]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of texts behind each other: where they are, ends by text, unit hashes."""

    def __init__(self, texts: list[bytes]):
        joined = Joined([t + b" " for t in texts])
        self.whole = joined.whole
        blank = _BLANK[joined.data]
        edge = np.flatnonzero(np.diff(np.r_[True, blank].view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        ranges = Ranges(joined.units)
        lengths = (self.end - self.start).astype(np.uint64)
        self.units = mix(ranges.hash(self.start, self.end) + mix(lengths))
        # Long runs of regular patterns can share a polynomial modulo 2 ** 64, whatever its base.
        for i in np.flatnonzero(lengths > LONG_WORD):
            self.units[i] = xxhash.xxh64_intdigest(self.whole[self.start[i] : self.end[i]], LONG_WORD)
        self.ends = np.searchsorted(self.start, joined.ends)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that starts at one of the starts."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:n]) > 0


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some blocks: the block's place in the list, the window."""
    sizes = last - first + 1
    which = np.repeat(np.arange(len(first)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which]

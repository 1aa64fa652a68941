"""Whole texts of an Arrow batch as numpy arrays of words: no Python object per word.

Texts are handled in slices of a few hundred kilobytes, so memory does not depend on the batch;
a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        size = max(SLICE_BYTES + 1, n)
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        steps[0] = 1
        kept = np.cumprod(steps, dtype=np.uint64)
        if n <= SLICE_BYTES + 1:
            _powers[base] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(values: np.ndarray, n: int) -> np.ndarray:
    """One hash for every n consecutive values."""
    count = len(values) - n + 1
    out = mix(values[:count] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * np.uint64(_BASE) + values[k : k + count])
    return out


@dataclass
class Slice:
    """Texts ``first`` to ``last`` of a batch. ``data`` are their bytes, ``offsets`` their bounds in it."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """A string or binary column in slices of at most ``most`` bytes or one text; null counts as empty."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, bounds, values = column.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        last = min(last, n)
        yield Slice(first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


@dataclass
class Words:
    """Words of a slice in order: hash, text they belong to, byte bounds; ``counts`` words per text."""

    hashes: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray


def words(part: Slice, table: np.ndarray) -> Words:
    """Maximal runs of the bytes in ``table``, A-Z lower-cased; a word never crosses two texts."""
    data, n = LOWER[part.data], len(part.data)
    inside = table[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = part.offsets[(part.offsets > 0) & (part.offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    hashes = mix((total[end] - total[start]) * powers(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(part.offsets, start, "right") - 1
    return Words(hashes, doc, start, end, np.bincount(doc, minlength=len(part.offsets) - 1))

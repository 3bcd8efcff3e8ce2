"""Columnar text kernels: words, lines and rolling fingerprints over Arrow string columns.

Texts stay in one byte buffer with offsets, as Arrow holds them; word and line bounds and
their 64-bit fingerprints come from whole-buffer numpy passes, never from per-row Python.
A slice is a run of whole rows of about ``SLICE`` bytes, which bounds the memory of a pass.

Fingerprints are polynomial hashes modulo 2**64 over seeded random byte codes, finished by
a 64-bit mixer.  Where equality must be beyond doubt, two independent ones are used.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

U64 = np.uint64
_MASK = (1 << 64) - 1

#: ASCII white space, [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODES = _RNG.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_GRAM_BASES = (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows by doubling and is kept."""
    key = (base, 0)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        have = np.full(size, U64(base), dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 23:  # larger ones serve one huge row only
            _POWERS[key] = have
    return have[:n]


def rolling(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Fingerprint of values[start:end] for every span, independent of where it stands."""
    n = len(values)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.multiply(values, _powers(base, n), out=total[1:])
    np.cumsum(total, out=total)
    inverse = _powers(pow(base, -1, 1 << 64), n + 1)
    out = total[end] - total[start]
    out *= inverse[start]
    out += (end - start).astype(np.uint64) * U64(0x2545F4914F6CDD1D)
    return mix(out)


def slices(column: pa.Array, limit: int = SLICE):
    """Yield (first row, last row + 1, bytes, offsets) for runs of whole rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Spans:
    """Words (or lines) of a slice: start and end bytes, and the first word of every row."""

    __slots__ = ("start", "end", "first")

    def __init__(self, start, end, first):
        self.start, self.end, self.first = start, end, first

    @property
    def rows(self) -> np.ndarray:
        """Row number of every span."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(buf: np.ndarray, off: np.ndarray) -> Spans:
    """The words [^\\x20\\x09-\\x0D]+ of every row."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Spans(z, z, np.zeros(len(off), np.int64))
    ink = ~SPACE[buf]
    left, right = ink.copy(), ink.copy()
    left[1:] &= ~ink[:-1]
    right[:-1] &= ~ink[1:]
    begin = off[:-1][off[:-1] < off[1:]]
    finish = off[1:][off[:-1] < off[1:]] - 1
    left[begin] = ink[begin]
    right[finish] = ink[finish]
    start = np.flatnonzero(left)
    return Spans(start, np.flatnonzero(right) + 1, np.searchsorted(start, off))


def lines(buf: np.ndarray, off: np.ndarray) -> Spans:
    """The parts of every row between line feeds; an empty row is one empty line."""
    feeds = np.flatnonzero(buf == 10)
    row_of = np.searchsorted(off, feeds, side="right") - 1
    counts = np.bincount(row_of, minlength=len(off) - 1) + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    start = np.empty(first[-1], np.int64)
    end = np.empty(first[-1], np.int64)
    inner = np.ones(first[-1], dtype=bool)
    inner[first[:-1]] = False
    start[first[:-1]] = off[:-1]
    start[inner] = feeds + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    end[first[1:] - 1] = off[1:]
    end[inner] = feeds
    return Spans(start, end, first)


def fingerprints(buf: np.ndarray, start, end, which: int = 0) -> np.ndarray:
    """64-bit fingerprints of byte spans; which: 0 or 1, two independent families."""
    return rolling(_CODES[which][buf], start, end, _BASES[which])


def grams(hashes: np.ndarray, first: np.ndarray, k: int, which: int = 0):
    """(first position, row, fingerprint) of every k consecutive words within one row."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(rows):
        return np.zeros(0, np.int64), rows, np.zeros(0, np.uint64)
    ahead = np.cumsum(counts) - counts
    at = np.arange(len(rows)) - np.repeat(ahead, counts) + np.repeat(first[:-1], counts)
    return at, rows, rolling(hashes, at, at + k, _GRAM_BASES[which])


def sequence(hashes: np.ndarray, start, end, which: int = 0) -> np.ndarray:
    """Fingerprints of spans of word hashes, equal to those of grams() for k words."""
    return rolling(hashes, start, end, _GRAM_BASES[which])


def long(x: np.ndarray) -> np.ndarray:
    """Unsigned fingerprints as Spark's signed longs."""
    return np.ascontiguousarray(x).view(np.int64)


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def tidy(run):
    """A worker's pass over batches that gives freed memory back when it ends.

    Workers wait for further stages and would keep what the largest arrays took.
    """

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return outer

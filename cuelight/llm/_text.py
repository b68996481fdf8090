"""Vectorised views of text columns, shared by the text operators.

Arrow hands a string column over as one byte buffer and a list of offsets.
Everything here works on such a buffer as a whole, so that a batch costs a
few numpy passes however many documents it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


@dataclass
class Texts:
    """Some documents: rows lo..hi of a batch; ``ends`` are offsets into ``data``."""

    lo: int
    hi: int
    data: np.ndarray
    ends: np.ndarray

    @property
    def count(self) -> int:
        return self.hi - self.lo


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[Texts]:
    """Cuts a string column into runs of whole texts of about ``limit`` bytes, and of at most ``rows`` texts.

    A text longer than that comes alone. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + (rows or n))
        yield Texts(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def lower_latin(data: np.ndarray, ascii_only: bool = False) -> np.ndarray:
    """Lower-cases A-Z and, unless ``ascii_only``, the capitals U+00C0 to U+00DE, in UTF-8 bytes."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if not ascii_only and len(data) > 1:
        second = data[1:]
        capital = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[1:][capital] += 32
    return out


@dataclass
class Words:
    """Runs of bytes outside 0x20 and 0x09-0x0D; none crosses a document's end."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # words of document i: bounds[i] to bounds[i + 1]


def words(texts: Texts) -> Words:
    data, ends = texts.data, texts.ends
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    padded = np.concatenate(([False], inside, [False]))
    start = np.flatnonzero(inside & (~padded[:-2] | edge[:-1]))
    end = np.flatnonzero(inside & (~padded[2:] | edge[1:])) + 1
    bounds = np.searchsorted(start, ends)
    doc = np.repeat(np.arange(texts.count), np.diff(bounds))
    return Words(start, end, doc, bounds)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if size > SLICE_BYTES * 4:
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHash:
    """64-bit hashes of arbitrary byte spans of one buffer, by differences of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self._down = powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        for lo in range(0, len(data), SLICE_BYTES):  # a long text a part at a time
            hi = min(len(data), lo + SLICE_BYTES)
            part = data[lo:hi].astype(np.uint64)
            part += np.uint64(1)
            part *= up[lo:hi]
            np.cumsum(part, out=self._sums[lo + 1 : hi + 1])
            self._sums[lo + 1 : hi + 1] += self._sums[lo]

    def __call__(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(h + np.uint64(salt))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], also of empty runs."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]

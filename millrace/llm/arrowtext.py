"""Words and shingles of whole Arrow string columns, as arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES)
        with np.errstate(over="ignore"):
            for name, base in (("_POWERS", _BASE), ("_INVERSES", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)
    return _POWERS, _INVERSES


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about a megabyte of text; a longer text is a range of its own."""
    offsets = offsets_of(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(column)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of words: anything but the six ASCII blanks, with A-Z made small.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[9, 10, 11, 12, 13, 32]] = 0
PLAIN[0] = 0
#: Bytes of words of small letters and digits, and all of non-ASCII characters.
ALNUM = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 48) & (np.arange(256) <= 57)) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 0).astype(np.uint8)
ALNUM[65:91] = np.arange(97, 123)


class Words:
    """The words of some texts: hash, byte range and, by `first`, the range of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN):
        self.data, self.offsets = table[data], offsets
        inside = self.data != 0
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[edges] = False
        if len(data):
            before[0] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        power, self._inverse = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.data.astype(np.uint64) * power[: len(data)], out=self._sums[1:])
        self.hash = self.ranges(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each range of bytes; a word's hash is that of its range."""
        with np.errstate(over="ignore"):
            return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def shingles(self, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of its first word) of every run of `size` words inside a text.

        short: a text with fewer words, but some, has one shingle of them all.
        """
        n = len(self.hash)
        factor = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        counts = np.diff(self.first)
        left = np.repeat(self.first[1:], counts) - np.arange(n)
        with np.errstate(over="ignore"):
            total = np.zeros(n, np.uint64)
            for j in range(size):
                part = np.zeros(n, np.uint64)
                part[: n - j] = self.hash[j:] * factor[j]
                total += np.where(left > j, part, np.uint64(0)) if short else part
        is_full = left >= size
        if short:
            start = np.zeros(n, bool)
            start[self.first[:-1][counts > 0]] = True
            is_full |= start & (np.repeat(counts, counts) < size)
        at = np.flatnonzero(is_full)
        return mix(total[at]), at

"""Words of Arrow text columns as numpy arrays, without a Python object for each word.

A word is a maximal run of the bytes that `word_bytes` marks, after A-Z were lower-cased.
Bytes of 0x80 and more stand for any code point outside ASCII. Each word becomes a 64-bit
value: a polynomial in its bytes modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes whose words are hashed at once; bounds the memory of a task, whatever a text's length.
PIECE = 1 << 20


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_bytes() -> np.ndarray:
    """Bytes of words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    table = np.ones(256, bool)
    table[0x00:0x30] = table[0x3A:0x61] = table[0x7B:0x80] = False
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Hasher:
    """Holds the powers that hashing needs; one for each task."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit values of the spans of raw, which must be in order and apart."""
        out = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, side="right")))
            at, to = int(starts[first]), int(ends[last - 1])
            self.grow(to - at + 1)
            sums = np.zeros(to - at + 1, np.uint64)
            np.cumsum((raw[at:to].astype(np.uint64) + np.uint64(1)) * self.powers[: to - at], out=sums[1:])
            s, e = starts[first:last] - at, ends[first:last] - at
            out[first:last] = (sums[e] - sums[s]) * self.inverse[s]
            first = last
        return mix(out)

    def words(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, 64-bit values of the words, and the row of each; raw is lower-cased already."""
        if not len(raw):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), none
        mask = (word_bytes() if inside is None else inside)[raw]
        begins = np.empty(len(raw), bool)
        begins[0], begins[1:] = True, ~mask[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(raw)]
        begins[cuts] = True
        starts = np.flatnonzero(mask & begins)
        stops = np.empty(len(raw), bool)
        stops[-1], stops[:-1] = True, ~mask[1:]
        cuts = offsets[1:] - 1
        stops[cuts[cuts >= 0]] = True
        ends = np.flatnonzero(mask & stops) + 1
        rows = np.searchsorted(offsets, starts, side="right") - 1
        return starts, ends, self.spans(raw, starts, ends), rows

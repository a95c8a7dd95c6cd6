"""Words and their hashes for a batch of texts at once, in numpy.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text; null has none. All arrays run over
the words of the whole batch; ``Words.doc`` says whose they are. Hashes are 64-bit polynomials of the
bytes, mixed; they depend on the word alone, so every task and every run agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18  # bytes of text handled at once; a longer text is one slice of its own
_MULTIPLIER = 0x9E3779B97F4A7C13  # odd, and one less than a multiple of four: powers never repeat early
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_ONE = np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bytes_table(lower: bool) -> np.ndarray:
    values = np.arange(256, dtype=np.uint64)
    if lower:
        values[65:91] += np.uint64(32)
    return mix((values + _ONE) * np.uint64(0x9E3779B97F4A7C15))


_TABLE = {False: _bytes_table(False), True: _bytes_table(True)}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE + (1 << 16)), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the n + 1 places where they begin and end; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str | int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of about SLICE bytes of text, one row at least."""
    _, ends = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop
    pa.default_memory_pool().release_unused()  # a worker may wait long for its next batch


@dataclass
class Words:
    data: np.ndarray  # all bytes
    starts: np.ndarray  # of each word, in bytes
    ends: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # n + 1 places in the arrays above: the words of row i are first[i]:first[i + 1]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """lower: A-Z count as a-z."""
        table, out, at, n = _TABLE[lower], np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SLICE, "right")))
            low, high = self.starts[at], self.ends[stop - 1]
            out[at:stop] = _ranges(table[self.data[low:high]], self.starts[at:stop] - low, self.ends[at:stop] - low)
            at = stop
        return out


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range; equal content, equal hash, wherever it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_MULTIPLIER, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def ranges(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of words."""
    return _ranges(hashes, starts, ends) if len(starts) else np.zeros(0, np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words; those that cross texts are for the caller to leave out."""
    starts = np.arange(max(0, len(hashes) - n + 1))
    return ranges(hashes, starts, starts + n)


def words(column: pa.Array) -> Words:
    data, ends = text_bytes(column)
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[1:], before[:1] = space[:-1], True
    inner = ends[ends < len(data)]
    before[inner] = True  # a text begins
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(data), bool)
    after[:-1], after[-1:] = space[1:], True
    after[ends[ends > 0] - 1] = True  # a text ends
    stops = np.flatnonzero(after & ~space) + 1
    first = np.searchsorted(starts, ends)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(data, starts, stops, doc, first)

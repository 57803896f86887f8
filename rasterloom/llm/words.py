"""Vectorised words and rolling hashes over Arrow string columns.

Texts of a batch are handled as one UTF-8 buffer; words are runs of bytes that are not separators, and get a
64-bit hash from prefix sums of a polynomial over the byte values (arithmetic modulo 2**64). Both word patterns
used by the operators have ASCII separators only, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once, unless one text alone is longer.
CHUNK = 1 << 19

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LANE = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: All ASCII but 0-9, and a-z once A-Z are lower-cased.
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[:128] = True
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x61:0x7B] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    if column.null_count:
        column = pc.fill_null(column, empty)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes, or one longer text each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of rows i..j: starts and ends within buf, the row of each (from 0), and the first word of each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, separators: np.ndarray):
        self.buf, self.offs, self.rows = buf, offs, len(offs) - 1
        word = ~separators[buf]
        starts, ends = word.copy(), word.copy()
        starts[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        filled = offs[:-1] < offs[1:]
        first, last = offs[:-1][filled], offs[1:][filled] - 1
        starts[first] = word[first]
        ends[last] = word[last]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * powers(_BASE, n), out=total[1:])
        back = powers(_INVERSE, n + 1)[self.starts]
        length = (self.ends - self.starts).astype(np.uint64)
        return mix((total[self.ends] - total[self.starts]) * back + length)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; windows that cross rows are for the caller to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _LANE[j]
    return mix(out + np.uint64(k))

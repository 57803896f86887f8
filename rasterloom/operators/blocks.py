"""Block coding of many blocks in step.

Blocks are independent, and the scan visits the same places in each, so the blocks of an Arrow batch go through the scan
together: at a place, the blocks that code a decision there code it in one step of arrays, each with its own coder state.
The bytes are those of `operators.entropy`, which codes single blocks (and has the styles). Arrays have a place in the
first axis and a block in the second; blocks are held in falling order of their planes, so that the blocks that take part
in a pass are a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rasterloom.functions.contexts import SIGN_CONTEXTS
from rasterloom.operators.entropy import CONTEXTS, INITIAL, RUN, STATES, UNIFORM, decode_block, encode_block, zero_context

#: Samples that are coded in step.
TOGETHER = 1 << 18
#: Below this number, blocks are coded one by one.
FEW = 12

# A state and its likely bit make one number, 2 * state + bit.
_ESTIMATE = np.repeat(np.array([s[0] for s in STATES], np.int64), 2)
_LIKELY = np.array([2 * s[1] + bit for s in STATES for bit in (0, 1)], np.uint8)
_UNLIKELY = np.array([2 * s[2] + (bit ^ s[3]) for s in STATES for bit in (0, 1)], np.uint8)
_SHIFTS = np.array([16 - a.bit_length() for a in range(1 << 16)], np.int64)
# Neighbours are counted in one number: beside 15, above and below 5, corners 1.
_ZERO = {band: np.array([zero_context(band, n // 15, n // 5 % 3, n % 5) for n in range(45)], np.int64) for band in ("LL", "LH", "HL", "HH")}
_SIGN = np.array([SIGN_CONTEXTS[max(-1, min(1, h)), max(-1, min(1, v))] for h in range(-2, 3) for v in range(-2, 3)], np.int64)


class _Coders:
    """Coder states of n blocks."""

    def __init__(self, n: int) -> None:
        self.state = np.tile(np.array([2 * INITIAL.get(k, 0) for k in range(CONTEXTS)], np.uint8), n)
        self.a, self.c, self.count = np.full(n, 0x8000, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)


class _Writers(_Coders):
    def __init__(self, n: int) -> None:
        super().__init__(n)
        self.count += 12
        self.out, self.last, self.size = np.zeros((n, 64), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def reserve(self, more: int) -> None:
        short = int(self.size.max()) + more - self.out.shape[1]
        if short > 0:
            self.out = np.pad(self.out, ((0, 0), (0, short + self.out.shape[1] // 2)))

    def code(self, rows: np.ndarray, context, bits: np.ndarray) -> np.ndarray:
        at = rows * CONTEXTS + context
        state = self.state[at]
        estimate = _ESTIMATE[state]
        a = self.a[rows] - estimate
        likely = bits == (state & 1)
        keep = likely ^ (a < estimate)
        moved = ~(likely & (a >= 0x8000))
        self.c[rows] += estimate * keep
        a = np.where(keep, a, estimate)
        self.a[rows] = a
        if moved.any():
            state, likely = state[moved], likely[moved]
            self.state[at[moved]] = np.where(likely, _LIKELY[state], _UNLIKELY[state])
            self._shift(rows[moved], a[moved])
        return bits

    def _shift(self, rows: np.ndarray, a: np.ndarray) -> None:
        n = _SHIFTS[a]
        self.a[rows] = a << n
        while len(rows):
            count = self.count[rows]
            step = np.minimum(n, count)
            self.c[rows] <<= step
            self.count[rows] = count - step
            full = n >= count
            if not full.any():
                return
            rows, n = rows[full], (n - step)[full]
            self._byte(rows)

    def _byte(self, rows: np.ndarray) -> None:
        c, last, size = self.c[rows], self.last[rows], self.size[rows]
        carry = (last != 0xFF) & (c & 0x8000000 != 0)
        last = last + carry
        self.out[rows, size] = last
        c = np.where(carry, c & 0x7FFFFFF, c)
        stuffed = last == 0xFF
        held = 19 + stuffed
        byte = c >> held & 0xFF
        self.size[rows] = size + 1
        self.out[rows, size + 1] = byte
        self.last[rows] = byte
        self.c[rows] = c & (1 << held) - 1
        self.count[rows] = 8 - stuffed

    def finish(self) -> list[bytes]:
        self.reserve(8)
        top = self.c + self.a
        self.c |= 0xFFFF
        self.c -= 0x8000 * (self.c >= top)
        rows = np.arange(len(self.c))
        for _ in range(2):
            self.c <<= self.count
            self._byte(rows)
        end = self.size + (self.last != 0xFF)
        return [self.out[i, 1:e].tobytes() for i, e in enumerate(end.tolist())]


class _Readers(_Coders):
    def __init__(self, data: list[bytes]) -> None:
        n = len(data)
        super().__init__(n)
        self.data = np.full((n, max(map(len, data), default=0) + 3), 0xFF, np.int64)
        for i, d in enumerate(data):
            self.data[i, : len(d)] = np.frombuffer(d, np.uint8)
        self.at = np.zeros(n, np.int64)
        self.c = self.data[:, 0] << 16
        self._byte(np.arange(n))
        self.c, self.count = self.c << 7, self.count - 7

    def reserve(self, more: int) -> None:
        pass

    def _byte(self, rows: np.ndarray) -> None:
        at = self.at[rows]
        stuffed = self.data[rows, at] == 0xFF
        ahead = self.data[rows, at + 1]
        ended = stuffed & (ahead > 0x8F)
        self.c[rows] += np.where(ended, 0xFF00, ahead << (8 + stuffed))
        self.at[rows] = at + ~ended
        self.count[rows] = 8 - (stuffed & ~ended)

    def code(self, rows: np.ndarray, context, _) -> np.ndarray:
        at = rows * CONTEXTS + context
        state = self.state[at]
        estimate = _ESTIMATE[state]
        a, c = self.a[rows] - estimate, self.c[rows]
        low = c >> 16 < estimate
        unlikely = low ^ (a < estimate)
        moved = low | (a < 0x8000)
        self.c[rows] = c - (estimate << 16) * ~low
        a = np.where(low, estimate, a)
        self.a[rows] = a
        if moved.any():
            change = state[moved]
            self.state[at[moved]] = np.where(unlikely[moved], _UNLIKELY[change], _LIKELY[change])
            self._shift(rows[moved], a[moved])
        return (state & 1) ^ (unlikely & moved)

    def _shift(self, rows: np.ndarray, a: np.ndarray) -> None:
        n = _SHIFTS[a]
        self.a[rows] = a << n
        while len(rows):
            empty = self.count[rows] == 0
            if empty.any():
                self._byte(rows[empty])
            count = self.count[rows]
            step = np.minimum(n, count)
            self.c[rows] = self.c[rows] << step & 0xFFFFFFFF
            self.count[rows] = count - step
            left = n > step
            rows, n = rows[left], (n - step)[left]


def _scan(coders, planes: np.ndarray, height: int, width: int, band: str, values: np.ndarray | None) -> np.ndarray:
    """Codes blocks whose planes fall; returns their coefficients, (height, width, blocks)."""
    n, line = len(planes), width + 2
    places = (height + 2) * line
    near, sign = np.zeros((places, n), np.uint8), np.zeros((places, n), np.int8)
    size, done, refined = np.zeros((places, n), np.int64), np.zeros((places, n), bool), np.zeros((places, n), bool)
    around = np.array([-line - 1, -line, -line + 1, -1, 1, line - 1, line, line + 1])[:, None]
    weight = np.array([1, 5, 1, 15, 15, 1, 5, 1], np.uint8)[:, None]
    zero, code = _ZERO[band], coders.code
    if values is not None:
        padded = np.pad(values, ((1, 1), (1, 1), (0, 0))).reshape(places, n)
        magnitude, negative = np.abs(padded), padded < 0
    bits = minus = np.zeros((places, n), np.uint8)
    if values is not None:
        minus = negative.astype(np.uint8)
    columns = [(top, min(top + 4, height), x) for top in range(0, height, 4) for x in range(width)]
    column = [((top + 1) * line + x + 1, end - top) for top, end, x in columns]

    def become(place, rows: np.ndarray) -> None:
        key = (sign[place - 1, rows] + sign[place + 1, rows] + 2) * 5 + sign[place - line, rows] + sign[place + line, rows] + 2
        context, flip = _SIGN[key, 0], _SIGN[key, 1]
        sign[place, rows] = 1 - 2 * (code(rows, context, minus[place, rows] ^ flip) ^ flip).astype(np.int8)
        size[place, rows] = 1 << plane
        near[place + around, rows] += weight

    def decide(place: int, rows: np.ndarray) -> None:
        on = rows[code(rows, zero[near[place, rows]], bits[place, rows]) == 1]
        if len(on):
            become(place, on)

    for plane in range(int(planes[0]) - 1, -1, -1):
        coders.reserve(height * width * 12 + 16)
        if values is not None:
            bits = (magnitude >> plane & 1).astype(np.uint8)
        begun, old = int((planes > plane).sum()), int((planes > plane + 1).sum())
        if old:
            for first, rows_in in column:
                for place in range(first, first + rows_in * line, line):
                    rows = np.flatnonzero((near[place, :old] != 0) & (sign[place, :old] == 0))
                    if len(rows):
                        done[place, rows] = True
                        decide(place, rows)
            for first, rows_in in column:
                for place in range(first, first + rows_in * line, line):
                    rows = np.flatnonzero((sign[place, :old] != 0) & ~done[place, :old])
                    if len(rows):
                        context = np.where(refined[place, rows], 16, 14 + (near[place, rows] != 0))
                        size[place, rows] += code(rows, context, bits[place, rows]).astype(np.int64) << plane
                        refined[place, rows] = True
        for first, rows_in in column:
            begin = None
            if rows_in == 4:
                stripe = slice(first, first + 4 * line, line)
                quiet = np.flatnonzero(~((near[stripe, :begun] != 0) | (sign[stripe, :begun] != 0)).any(axis=0))
                if len(quiet):
                    ahead = bits[stripe][:, quiet]
                    go = code(quiet, RUN, ahead.any(axis=0).astype(np.uint8)) == 1
                    begin = np.zeros(begun, np.int64)
                    begin[quiet] = 4
                    rows = quiet[go]
                    if len(rows):
                        k = ahead[:, go].argmax(axis=0).astype(np.uint8)
                        k = code(rows, UNIFORM, k >> 1).astype(np.int64) * 2 + code(rows, UNIFORM, k & 1)
                        begin[rows] = k + 1
                        become(first + k * line, rows)
            for y in range(rows_in):
                place = first + y * line
                todo = (sign[place, :begun] == 0) & ~done[place, :begun]
                if begin is not None:
                    todo &= begin <= y
                rows = np.flatnonzero(todo)
                if len(rows):
                    decide(place, rows)
        done[:] = False
    return (size * sign).reshape(height + 2, line, n)[1:-1, 1:-1]


def encode_many(values: np.ndarray, band: str = "LL") -> tuple[np.ndarray, list[bytes]]:
    """Planes and bytes of blocks (blocks, height, width); a block of zeros has neither."""
    n, height, width = values.shape
    top = np.abs(values).reshape(n, -1).max(axis=1) if n else np.zeros(0, np.int64)
    planes = np.array([v.bit_length() for v in top.tolist()], np.int64)
    order = np.argsort(-planes, kind="stable")[: int((planes > 0).sum())]
    data = [b""] * n
    if len(order):
        writers = _Writers(len(order))
        _scan(writers, planes[order], height, width, band, np.ascontiguousarray(values[order].transpose(1, 2, 0)))
        for i, d in zip(order.tolist(), writers.finish(), strict=True):
            data[i] = d
    return planes, data


def decode_many(width: int, height: int, planes: np.ndarray, data: list[bytes], band: str = "LL") -> np.ndarray:
    """The blocks (blocks, height, width) that encode_many was given."""
    out = np.zeros((len(planes), height, width), np.int64)
    order = np.argsort(-planes, kind="stable")[: int((planes > 0).sum())]
    if len(order):
        found = _scan(_Readers([data[i] for i in order.tolist()]), planes[order], height, width, band, None)
        out[order] = found.transpose(2, 0, 1)
    return out


def _groups(heights: np.ndarray, widths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows of equal height and width, as many as are coded in step."""
    shapes, which = np.unique(np.stack([heights, widths]), axis=1, return_inverse=True)
    for k, (h, w) in enumerate(shapes.T.tolist()):
        rows = np.flatnonzero(which.ravel() == k)
        step = max(1, TOGETHER // max(1, h * w))
        for i in range(0, len(rows), step):
            yield h, w, rows[i : i + step]


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def encode_blocks(blocks: DataFrame, key: str, block: str) -> DataFrame:
    """(key, width, height, planes, data) from rows of blocks (arrays of rows of whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(1).flatten()
            heights = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            across = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(heights) - heights
            widths = across[first]
            if (across != np.repeat(widths, heights)).any():
                raise ValueError("the rows of a block differ in length")
            samples = lines.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(heights * widths) - heights * widths
            planes, data = np.zeros(batch.num_rows, np.int32), [b""] * batch.num_rows
            for h, w, rows in _groups(heights, widths):
                values = samples[begin[rows][:, None] + np.arange(h * w)].reshape(-1, h, w)
                found = encode_many(values) if len(rows) >= FEW else zip(*(encode_block(v.tolist()) for v in values), strict=True)
                for i, p, d in zip(rows.tolist(), *found, strict=True):
                    planes[i], data[i] = p, d
            cols = [pa.array(widths, pa.int32()), pa.array(heights, pa.int32()), pa.array(planes), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [key, "width", "height", "planes", "data"])

    return blocks.select(key, block).mapInArrow(run, f"{key} {_kind(blocks, key)}, width int, height int, planes int, data binary")


def decode_blocks(coded: DataFrame, key: str) -> DataFrame:
    """(key, plane) from the columns of encode_blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, heights, planes = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
            data = batch.column(4).to_pylist()
            out: list = [None] * batch.num_rows
            for h, w, rows in _groups(heights, widths):
                held, some = planes[rows], [data[i] for i in rows.tolist()]
                if len(rows) >= FEW:
                    found = decode_many(w, h, held, some).tolist()
                else:
                    found = [decode_block(w, h, p, d) for p, d in zip(held.tolist(), some, strict=True)]
                for i, plane in zip(rows.tolist(), found, strict=True):
                    out[i] = plane
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.int64())))], [key, "plane"])

    return coded.select(key, "width", "height", "planes", "data").mapInArrow(run, f"{key} {_kind(coded, key)}, plane array<array<long>>")

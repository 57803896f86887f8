"""Plain raster files: a text header with samples, strips of compressed rows, and ranged reads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_PGX = re.compile(rb"PG (ML|LM) ([+-]?) ?(\d+) (\d+) (\d+)\n")


def parse_pgx(data: bytes) -> tuple[int, int, int, bool, np.ndarray]:
    """Width, height, bits, signed and samples of a PGX file (1 to 16 bits)."""
    m = _PGX.match(data)
    if not m:
        raise ValueError("no PGX header")
    order, sign, bits, width, height = m[1], m[2], *map(int, m.groups()[2:])
    if not 1 <= bits <= 16 or not width or not height:
        raise ValueError("unsupported PGX geometry")
    size = 1 if bits <= 8 else 2
    body = data[m.end() :]
    if len(body) != size * width * height:
        raise ValueError("PGX samples are missing or too many")
    kind = f"{'>' if order == b'ML' else '<'}{'i' if sign == b'-' else 'u'}{size}"
    return width, height, bits, sign == b"-", np.frombuffer(body, kind).astype(np.int64).reshape(height, width)


def write_pgx(plane: Column, width: int, height: int, bits: int = 8) -> Column:
    """A signed 8-bit PGX file of an array of rows, as an expression."""
    head = F.encode(F.lit(f"PG ML -{bits} {width} {height}\n"), "US-ASCII")
    samples = F.transform(F.flatten(plane), lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0"))
    return F.concat(head, F.unhex(F.array_join(samples, "")))


def read_pgx(files: DataFrame, key: str, payload: str) -> DataFrame:
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_pgx(d) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p[0] for p in parsed], pa.int32()),
                    pa.array([p[1] for p in parsed], pa.int32()),
                    pa.array([p[4].tolist() for p in parsed], pa.list_(pa.list_(pa.int64()))),
                ],
                [key, "width", "height", "plane"],
            )

    return files.select(key, payload).mapInArrow(run, f"{key} {kind}, width int, height int, plane array<array<long>>")


CLEAR, END = 256, 257


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, with clear and end codes."""
    bits, held, at, out = 9, 0, 0, bytearray()
    have = 0
    table: list[bytes] = []
    last = b""

    def reset() -> None:
        table[:] = [bytes([i]) for i in range(256)] + [b"", b""]

    reset()
    while True:
        while have < bits:
            if at >= len(data):
                raise ValueError("compressed data ends early")
            held, have, at = held << 8 | data[at], have + 8, at + 1
        code = held >> (have - bits) & ((1 << bits) - 1)
        have -= bits
        held &= (1 << have) - 1
        if code == END:
            return bytes(out)
        if code == CLEAR:
            reset()
            bits, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("a code without an entry")
        out += entry
        if last:
            if len(table) >= 4096:
                raise ValueError("the table is full")
            table.append(last + entry[:1])
        last = entry
        bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def lzw_encode(data: bytes) -> bytes:
    bits, out, held, have = 9, bytearray(), 0, 0
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, have
        held, have = held << bits | code, have + bits
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
            held &= (1 << have) - 1

    def reset() -> None:
        table.clear()
        table.update({bytes([i]): i for i in range(256)})

    reset()
    put(CLEAR)
    size, prefix = 258, b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if prefix + c in table:
            prefix += c
            continue
        put(table[prefix])
        table[prefix + c] = size
        size += 1
        bits = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(CLEAR)
            reset()
            size, bits = 258, 9
        prefix = c
    if prefix:
        put(table[prefix])
        size += 1
        bits = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(END)
    if have:
        out.append(held << (8 - have) & 255)
    return bytes(out)


def undo_predictor(rows: bytes, width: int, channels: int) -> bytes:
    """Differences to the pixel before, along each row, summed up modulo 256."""
    a = np.frombuffer(rows, np.uint8).reshape(-1, width, channels)
    return np.cumsum(a, axis=1, dtype=np.uint8).tobytes()


def parse_tiff_rgb(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and (height, width, 3) samples of a single-image RGB file of 8 bits.

    Strips are either plain and without a predictor, or LZW with horizontal differences; all else is refused.
    """
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF header")
    num = lambda at, n: int.from_bytes(data[at : at + n], order)
    if num(2, 2) != 42:
        raise ValueError("no TIFF header")
    at, tags = num(4, 4), {}
    for i in range(num(at, 2)):
        entry = at + 2 + 12 * i
        tag, kind, count = num(entry, 2), num(entry + 2, 2), num(entry + 4, 4)
        size = {1: 1, 3: 2, 4: 4}.get(kind)
        if size is None:
            continue
        where = entry + 8 if size * count <= 4 else num(entry + 8, 4)
        tags[tag] = [num(where + size * k, size) for k in range(count)]
    width, height = tags[256][0], tags[257][0]
    packing, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
    if tags.get(258) != [8, 8, 8] or tags.get(277) != [3] or tags.get(262) != [2] or (packing, predictor) not in ((1, 1), (5, 2)):
        raise ValueError("unsupported TIFF profile")
    body = b"".join(
        lzw_decode(data[o : o + n]) if packing == 5 else data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)
    )
    if len(body) != width * height * 3:
        raise ValueError("TIFF strips do not fit the image")
    if predictor == 2:
        body = undo_predictor(body, width, 3)
    return width, height, np.frombuffer(body, np.uint8).reshape(height, width, 3)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__(start)
        self.start, self.stop = start, stop


class ByteRanges(DataSource):
    """format("byteranges"): exact positioned reads of a file that all executors can open, one partition per range.

    Options: path, length (of the file), size (of a range). Reading beyond the end is an error, never a short result.
    """

    @classmethod
    def name(cls) -> str:
        return "byteranges"

    def schema(self) -> str:
        return "start long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.length, self.size = options["path"], int(options["length"]), int(options.get("size", 1 << 20))

    def partitions(self):
        return [_Range(s, min(s + self.size, self.length)) for s in range(0, self.length, self.size)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.stop - partition.start)
        if len(data) != partition.stop - partition.start:
            raise EOFError(f"{self.path} ends before {partition.stop}")
        yield partition.start, data

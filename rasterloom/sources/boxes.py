"""Boxes of image containers: written as binary expressions, read by an Arrow batch function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Box types and magic bytes of the container format.
SIGNATURE, FILE_TYPE, HEADER, CODESTREAM = "jP  ", "ftyp", "jp2h", "jp2c"
MAGIC = "0D0A870A"
SUPERBOXES = {b"jp2h"}


def u32(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v.cast("long")), 8, "0"))


def u16(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v.cast("long")), 4, "0"))


def u8(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v.cast("long")), 2, "0"))


def write_box(kind: str, contents: Column) -> Column:
    return F.concat(u32(F.octet_length(contents) + 8), F.encode(F.lit(kind), "US-ASCII"), contents)


def signature() -> Column:
    return write_box(SIGNATURE, F.unhex(F.lit(MAGIC)))


def file_type(brand: str = "jp2 ") -> Column:
    name = F.encode(F.lit(brand), "US-ASCII")
    return write_box(FILE_TYPE, F.concat(name, u32(F.lit(0)), name))


def image_header(height: Column, width: Column, components: Column, bits: Column, signed: bool = False) -> Column:
    depth = bits - 1 + (128 if signed else 0)
    return write_box("ihdr", F.concat(u32(height), u32(width), u16(components), u8(depth), u8(F.lit(7)), u8(F.lit(0)), u8(F.lit(0))))


def bits_per_component(bits: Column, signed: Column) -> Column:
    """From arrays of depths (1 to 38) and signs."""
    ok = F.forall(bits, lambda b: b.between(1, 38))
    data = F.transform(F.arrays_zip(bits.alias("b"), signed.alias("s")), lambda z: F.lpad(F.hex((z["b"] - 1 + F.when(z["s"], 128).otherwise(0)).cast("long")), 2, "0"))
    return write_box("bpcc", F.unhex(F.when(ok, F.array_join(data, "")).otherwise(F.raise_error(F.lit("bits per component beyond 1..38")))))


def colour_specification(space: int) -> Column:
    return write_box("colr", F.concat(u8(F.lit(1)), u8(F.lit(0)), u8(F.lit(0)), u32(F.lit(space))))


def header_superbox(children: Column) -> Column:
    return write_box(HEADER, children)


def codestream(data: Column) -> Column:
    return write_box(CODESTREAM, data)


def order_status(types: Column) -> Column:
    """What is wrong with the order of top-level boxes, or ok."""
    count = F.size(F.filter(types, lambda t: t == HEADER))
    return (
        F.when(F.get(types, F.lit(0)) != SIGNATURE, "signature first")
        .when(F.get(types, F.lit(1)) != FILE_TYPE, "file type second")
        .when(count != 1, "one header")
        .when(~F.array_contains(types, CODESTREAM), "no codestream")
        .otherwise("ok")
    )


def split_boxes(data: bytes, start: int, end: int, top: bool = True) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, offset, first byte of the contents, end) of the boxes in a range, then of those in a superbox."""
    at = start
    while at < end:
        if end - at < 8:
            raise ValueError(f"a box header at {at} is cut off")
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8]), 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"a box header at {at} is cut off")
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            if not top:
                raise ValueError(f"a box without an end at {at} inside of another")
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"the box at {at} has the impossible length {size}")
        yield kind, at, at + head, at + size
        if kind in SUPERBOXES:
            yield from split_boxes(data, at + head, at + size, top=False)
        at += size


def parse_boxes(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, ordinal, type, at, size): one row per box, at being its offset and size that of its contents."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (name, at, body, end) in enumerate(split_boxes(data, 0, len(data))):
                    keys.append(k)
                    rows.append((i, name.decode("latin-1"), at, end - body))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], [key, "ordinal", "type", "at", "size"]
            )

    return df.select(key, payload).mapInArrow(run, f"{key} {kind}, ordinal int, type string, at long, size long")


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their boxes."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("payload"))
    return parse_boxes(files, "path", "payload")

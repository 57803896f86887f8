"""Containers as one row each: their boxes as an array, the fields of known boxes, and what speaks against them.

Boxes are found by the parser; everything after that is Column expressions over the row, so nothing moves. A status is
"ok" or the first rule that does not hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.boxes import CODESTREAM, FILE_TYPE, HEADER, MAGIC, SIGNATURE, split_boxes

#: Brands, enumerated colour spaces, and bounds of header fields.
BRANDS = ("jp2 ", "jph ")
SRGB, GREY, SYCC = 16, 17, 18
MOST_COMPONENTS, MOST_DEPTH, MOST_ENTRIES = 16_384, 37, 1024
COLOUR, OPACITY, PREMULTIPLIED, UNSPECIFIED, NO_COLOUR = 0, 1, 2, 65_535, 65_535

_BOX = "struct<ordinal:int,parent:int,type:string,at:long,size:long,data:binary>"


def number(data: Column, at: Column | int, width: int) -> Column:
    """An unsigned big-endian number of the bytes from `at` on; null beyond the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    piece = F.substring(data, (at + 1).cast("int"), F.lit(width))
    return F.when(F.octet_length(piece) == width, F.conv(F.hex(piece), 16, 10).cast("long"))


def boxes_of(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, boxes, broken): top-level boxes first, in order, then the children of each; codestreams without their bytes.

    `broken` says where a box header or length is impossible; there are no boxes then.
    """
    kind = df.schema[key].dataType.simpleString()
    fields = [("ordinal", pa.int32()), ("parent", pa.int32()), ("type", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("data", pa.binary())]

    def boxes(data: bytes) -> list[dict]:
        found = list(split_boxes(data, 0, len(data)))
        out, parent, until = [], -1, 0
        for i, (name, at, body, end) in enumerate(found):
            inside = at < until
            if not inside:
                parent, until = (i, end) if name == HEADER.encode() else (-1, 0)
            bare = name == CODESTREAM.encode() or name == HEADER.encode()
            out.append(
                {"ordinal": i, "parent": parent if inside else -1, "type": name.decode("latin-1"), "at": body, "size": end - body, "data": None if bare else bytes(data[body:end])}
            )
        return sorted(out, key=lambda b: (b["parent"] >= 0, b["ordinal"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, broken = [], []
            for data in batch.column(1).to_pylist():
                try:
                    found.append(boxes(data or b""))
                    broken.append(None)
                except ValueError as e:
                    found.append([])
                    broken.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct(fields))), pa.array(broken, pa.string())], [key, "boxes", "broken"])

    return df.select(key, payload).mapInArrow(run, f"{key} {kind}, boxes array<{_BOX}>, broken string")


def first_box(boxes: Column, kind: str) -> Column:
    return F.get(F.filter(boxes, lambda b: b["type"] == kind), F.lit(0))


def _four(data: Column, at: Column | int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.decode(F.substring(data, (at + 1).cast("int"), F.lit(4)), "ISO-8859-1")


def _depth(byte: Column) -> Column:
    return F.struct((byte % 128 + 1).alias("bits"), (byte > 127).alias("signed"))


def file_type_fields(data: Column) -> Column:
    count = F.floor((F.octet_length(data) - 8) / 4).cast("int")
    brands = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: _four(data, 8 + 4 * k))).otherwise(F.array().cast("array<string>"))
    status = F.when((F.octet_length(data) < 8) | (F.octet_length(data) % 4 != 0), "file type length").otherwise("ok")
    return F.struct(_four(data, 0).alias("brand"), number(data, 4, 4).alias("minor"), brands.alias("compatible"), status.alias("status"))


def image_header_fields(data: Column) -> Column:
    h, w, n = number(data, 0, 4), number(data, 4, 4), number(data, 8, 2)
    depth, kind, unknown, rights = (number(data, k, 1) for k in range(10, 14))
    status = (
        F.when(F.octet_length(data) != 14, "header length")
        .when((h == 0) | (w == 0) | (n == 0), "empty image")
        .when(n > MOST_COMPONENTS, "too many components")
        .when((depth != 255) & (depth % 128 > MOST_DEPTH), "reserved depth")
        .when(kind != 7, "compression type")
        .when(unknown > 1, "reserved colour flag")
        .when(rights > 1, "reserved rights flag")
        .otherwise("ok")
    )
    varying = depth == 255
    return F.struct(
        h.alias("height"), w.alias("width"), n.alias("components"), F.when(~varying, depth % 128 + 1).alias("bits"), F.when(~varying, depth > 127).alias("signed"),
        (unknown == 1).alias("unknown_colour"), (rights == 1).alias("rights"), status.alias("status"),
    )


def bits_fields(data: Column) -> Column:
    """Depth and sign of each component."""
    bytes_of = F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    status = F.when(F.exists(bytes_of, lambda b: b % 128 > MOST_DEPTH), "reserved depth").otherwise("ok")
    return F.struct(F.transform(bytes_of, _depth).alias("depths"), status.alias("status"))


def colour_fields(data: Column) -> Column:
    method = number(data, 0, 1)
    name = F.when(method == 1, "enumerated").when(method == 2, "restricted profile").when(method == 3, "any profile").otherwise("vendor")
    space = F.when(method == 1, number(data, 3, 4))
    status = F.when(F.octet_length(data) < 3, "colour length").when((method == 1) & (F.octet_length(data) != 7), "colour length").otherwise("ok")
    return F.struct(name.alias("method"), number(data, 1, 1).alias("precedence"), number(data, 2, 1).alias("approximation"), space.alias("space"), status.alias("status"))


def palette_fields(data: Column) -> Column:
    """Entries, and depth and sign of each column; the table must be just as long as they say, with clear padding bits."""
    entries, columns = number(data, 0, 2), number(data, 2, 1)
    depths = bits_fields(F.substring(data, F.lit(4), columns.cast("int")))
    width = F.transform(depths["depths"], lambda d: F.ceil(d["bits"] / 8).cast("int"))
    row = F.aggregate(width, F.lit(0), lambda a, n: a + n)
    before = F.transform(width, lambda _, k: F.aggregate(F.slice(width, F.lit(1), k), F.lit(0), lambda a, n: a + n))
    top = F.transform(depths["depths"], lambda d: F.pow(F.lit(2), 8 - F.when(d["bits"] % 8 == 0, 0).otherwise(8 - d["bits"] % 8)).cast("long"))
    high = lambda e, k: number(data, 3 + columns + e * row + F.get(before, k), 1) >= F.get(top, k)
    padded = F.exists(F.sequence(F.lit(0), (entries - 1).cast("int")), lambda e: F.exists(F.sequence(F.lit(0), F.size(width) - 1), lambda k: high(e, k)))
    status = (
        F.when(F.octet_length(data) < 3, "palette length")
        .when(~entries.between(1, MOST_ENTRIES), "palette entries")
        .when(columns < 1, "palette columns")
        .when(F.octet_length(data) < 3 + columns, "palette length")
        .when(depths["status"] != "ok", "reserved depth")
        .when(F.octet_length(data) != 3 + columns + entries * row, "palette length")
        .when(padded, "palette padding")
        .otherwise("ok")
    )
    return F.struct(entries.alias("entries"), depths["depths"].alias("depths"), status.alias("status"))


def _records(data: Column, first: int, size: int, read) -> Column:
    count = F.floor((F.octet_length(data) - first) / size).cast("int")
    none = F.slice(F.transform(F.sequence(F.lit(0), F.lit(0)), lambda k: read(first + k * size)), F.lit(1), F.lit(0))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: read(first + k * size))).otherwise(none)


def mapping_fields(data: Column, components: Column, columns: Column) -> Column:
    """Channels, each of a component, directly or through a column of the palette."""
    read = lambda at: F.struct(number(data, at, 2).alias("component"), number(data, at + 2, 1).alias("kind"), number(data, at + 3, 1).alias("column"))
    channels = _records(data, 0, 4, read)
    wrong = lambda test: F.exists(channels, test)
    status = (
        F.when((F.octet_length(data) == 0) | (F.octet_length(data) % 4 != 0), "mapping length")
        .when(F.size(channels) > 65_536, "mapping channels")
        .when(wrong(lambda c: c["component"] >= components), "mapped component")
        .when(wrong(lambda c: c["kind"] > 1), "mapping type")
        .when(wrong(lambda c: (c["kind"] == 0) & (c["column"] != 0)), "direct mapping with a column")
        .when(wrong(lambda c: (c["kind"] == 1) & (c["column"] >= columns)), "palette column")
        .otherwise("ok")
    )
    return F.struct(channels.alias("channels"), status.alias("status"))


def channel_fields(data: Column, signed: Column, colours: Column, jph: Column) -> Column:
    """Meaning of each channel. signed: one flag a channel; colours: how many the colour space has, null if it is unknown."""
    read = lambda at: F.struct(number(data, at, 2).alias("channel"), number(data, at + 2, 2).alias("kind"), number(data, at + 4, 2).alias("association"))
    entries = _records(data, 2, 6, read)
    count = F.size(signed)
    wrong = lambda test: F.exists(entries, test)
    among = lambda test: F.filter(entries, test)
    alpha = lambda e: e["kind"].isin(OPACITY, PREMULTIPLIED)
    twice = lambda parts: F.size(F.array_distinct(parts)) != F.size(parts)
    stated = among(lambda e: e["association"] != NO_COLOUR)
    named = F.transform(among(lambda e: e["kind"] == COLOUR), lambda e: e["association"])
    alphas = among(alpha)
    kinds_of = lambda a: F.size(F.array_distinct(F.transform(F.filter(alphas, lambda e: e["association"] == a), lambda e: e["kind"])))
    status = (
        F.when(F.octet_length(data) < 2, "definition length")
        .when(number(data, 0, 2) == 0, "no definitions")
        .when(F.octet_length(data) != 2 + 6 * number(data, 0, 2), "definition length")
        .when(wrong(lambda e: e["channel"] >= count), "unknown channel")
        .when(wrong(lambda e: ~e["kind"].isin(COLOUR, OPACITY, PREMULTIPLIED, UNSPECIFIED)), "channel type")
        .when(wrong(lambda e: (e["kind"] == COLOUR) & e["association"].isin(0, NO_COLOUR)), "colour without association")
        .when(wrong(lambda e: (e["kind"] != UNSPECIFIED) & e["association"].between(1, NO_COLOUR - 1) & (e["association"] > colours)), "association beyond the colours")
        .when(wrong(lambda e: alpha(e) & F.get(signed, e["channel"].cast("int"))), "signed opacity")
        .when(jph & (F.size(alphas) > 1), "several opacities")
        .when(jph & F.exists(alphas, lambda e: e["association"] != 0), "opacity of a part")
        .when(twice(F.transform(stated, lambda e: F.struct(e["kind"], e["association"]))), "repeated meaning")
        .when(F.exists(alphas, lambda e: kinds_of(e["association"]) > 1), "mixed opacity")
        .when(F.exists(alphas, lambda e: e["association"] == 0) & F.exists(alphas, lambda e: e["association"].between(1, NO_COLOUR - 1)), "opacity of whole and part")
        .when(F.size(F.array_distinct(F.transform(entries, lambda e: e["channel"]))) < count, "undescribed channel")
        .when(F.exists(F.sequence(F.lit(1), F.coalesce(colours, F.lit(1))), lambda k: colours.isNotNull() & ~F.array_contains(named, k.cast("long"))), "undescribed colour")
        .otherwise("ok")
    )
    return F.struct(entries.alias("entries"), status.alias("status"))


def structure_status(boxes: Column, jph: Column) -> Column:
    """Order and number of the boxes on top and within the header."""
    top = F.filter(boxes, lambda b: b["parent"] < 0)
    inner = F.filter(boxes, lambda b: b["parent"] >= 0)
    types, within = F.transform(top, lambda b: b["type"]), F.transform(inner, lambda b: b["type"])
    place = lambda kind: F.array_position(types, kind)
    many = lambda kind, where=types: F.size(F.filter(where, lambda t: t == kind))
    both = (many("pclr", within) == 0) != (many("cmap", within) == 0)
    last = F.size(within) - F.array_position(F.reverse(within), "colr") + 1
    return (
        F.when(F.coalesce(F.get(types, F.lit(0)) != SIGNATURE, F.lit(True)), "signature first")
        .when(F.hex(F.get(top, F.lit(0))["data"]) != MAGIC, "signature value")
        .when(many(FILE_TYPE) == 0, "no file type")
        .when(jph & ((many(FILE_TYPE) != 1) | (place(FILE_TYPE) != 2) | (many(SIGNATURE) != 1)), "file type second")
        .when(many(CODESTREAM) == 0, "no codestream")
        .when(many(HEADER) != 1, "one header")
        .when((place(HEADER) > place(CODESTREAM)) | (place(HEADER) < place(FILE_TYPE)), "place of the header")
        .when(F.coalesce(F.get(within, F.lit(0)) != "ihdr", F.lit(True)), "image header first")
        .when(F.exists(F.array(*[F.lit(k) for k in ("ihdr", "bpcc", "pclr", "cmap", "cdef", "res ")]), lambda k: F.size(F.filter(within, lambda t: t == k)) > 1), "repeated box")
        .when((many("colr", within) > 0) & (last - F.array_position(within, "colr") + 1 != many("colr", within)), "colour boxes apart")
        .when(both, "palette and mapping together")
        .otherwise("ok")
    )


def parse_containers(df: DataFrame, key: str, payload: str) -> DataFrame:
    """One row a container: kind, file_type, header, depths, colour (the first), codestreams, metadata, boxes, status."""
    rows = boxes_of(df, key, payload)
    data = lambda kind: first_box(F.col("boxes"), kind)["data"]
    rows = rows.withColumn("file_type", file_type_fields(data(FILE_TYPE))).withColumn("header", image_header_fields(data("ihdr")))
    rows = rows.withColumn("depths", bits_fields(data("bpcc"))).withColumn("colour", colour_fields(data("colr")))
    brands = F.concat(F.array(F.col("file_type.brand")), F.coalesce("file_type.compatible", F.array().cast("array<string>")))
    kind = F.when(F.col("file_type.brand").isin(*BRANDS), F.col("file_type.brand")).when(F.array_contains(brands, BRANDS[1]), BRANDS[1])
    kind = kind.when(F.array_contains(brands, BRANDS[0]), BRANDS[0])
    rows = rows.withColumn("kind", F.trim(kind))
    jph = F.coalesce(F.col("kind") == "jph", F.lit(False))
    count, has = F.col("header.components"), lambda kind: data(kind).isNotNull()
    varying = F.col("header.bits").isNull()
    # Channels are the components or, with a palette, what the mapping makes of them.
    flat = F.when(varying, F.transform("depths.depths", lambda d: d["signed"])).otherwise(F.array_repeat(F.col("header.signed"), count.cast("int")))
    rows = rows.withColumn("_palette", palette_fields(data("pclr")))
    rows = rows.withColumn("_mapping", mapping_fields(data("cmap"), count, F.size("_palette.depths")))
    column_signed = lambda c: F.get(F.col("_palette.depths"), c["column"].cast("int"))["signed"]
    mapped = F.transform("_mapping.channels", lambda c: F.when(c["kind"] == 1, column_signed(c)).otherwise(F.get(flat, c["component"].cast("int"))))
    signed = F.when(has("cmap"), mapped).otherwise(flat)
    space = F.col("colour.space")
    colours = F.when(space.isin(SRGB, SYCC), 3).when(space == GREY, 1)
    rows = rows.withColumn("_channels", channel_fields(data("cdef"), signed, colours, jph))
    ok = lambda kind, field: F.when(has(kind), F.col(f"{field}.status")).otherwise("ok")
    jph_brand = (F.col("file_type.brand") != "jph ") | (F.col("file_type.minor") != 0) | ~F.array_contains(F.col("file_type.compatible"), "jph ")
    steps = [
        F.coalesce("broken", F.lit("ok")),
        F.when(has(FILE_TYPE), F.col("file_type.status")).otherwise("ok"),
        F.when(has(FILE_TYPE) & F.col("kind").isNull(), "brand").when(jph & jph_brand, "brand").otherwise("ok"),
        structure_status(F.col("boxes"), jph),
        ok("ihdr", "header"),
        ok("bpcc", "depths"),
        ok("colr", "colour"),
        F.when(varying != has("bpcc"), "depths by component").when(has("bpcc") & (F.size("depths.depths") != count), "depths by component").otherwise("ok"),
        F.when(~has("colr") & ~(jph & F.col("header.unknown_colour")), "no colour").otherwise("ok"),
        ok("pclr", "_palette"),
        ok("cmap", "_mapping"),
        ok("cdef", "_channels"),
        F.when(~has("cdef") & colours.isNotNull() & (F.size(signed) != colours), "channels without definition").otherwise("ok"),
    ]
    status = F.coalesce(*[F.when(s != "ok", s) for s in steps], F.lit("ok"))
    known = [SIGNATURE, FILE_TYPE, HEADER, CODESTREAM, "ihdr", "bpcc", "colr"]
    metadata = F.transform(F.filter("boxes", lambda b: ~b["type"].isin(*known)), lambda b: F.struct(b["type"].alias("type"), b["at"].alias("at"), b["data"].alias("data")))
    streams = F.transform(F.filter("boxes", lambda b: b["type"] == CODESTREAM), lambda b: F.struct(b["at"].alias("at"), b["size"].alias("size")))
    rows = rows.withColumn("status", status).withColumn("metadata", metadata).withColumn("codestreams", streams)
    return rows.select(key, "kind", "file_type", "header", "depths", "colour", "codestreams", "metadata", "boxes", "status")

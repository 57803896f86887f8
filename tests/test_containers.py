"""Containers: fields of boxes and the rules that they break."""

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import limits
from rasterloom.operators import codestream
from rasterloom.sources import containers


def box(kind, data):
    return (len(data) + 8).to_bytes(4, "big") + kind + data


def u(*pairs):
    return b"".join(v.to_bytes(n, "big") for v, n in pairs)


SIGNATURE = box(b"jP  ", bytes.fromhex("0D0A870A"))
JP2 = box(b"ftyp", b"jp2 " + bytes(4) + b"jp2 ")
STREAM = box(b"jp2c", b"\xff\x4f")
RGB = box(b"colr", u((1, 1), (0, 2), (16, 4)))


def ihdr(n=3, depth=7, kind=7):
    return box(b"ihdr", u((4, 4), (5, 4), (n, 2), (depth, 1), (kind, 1), (0, 2)))


def header(*children):
    return box(b"jp2h", b"".join(children))


def cdef(*rows):
    return box(b"cdef", u((len(rows), 2), *[(v, 2) for r in rows for v in r]))


COLOURS = [(0, 0, 1), (1, 0, 2), (2, 0, 3)]
CASES = {
    "ok": SIGNATURE + JP2 + header(ihdr(), RGB) + STREAM,
    "signature first": JP2 + SIGNATURE + header(ihdr(), RGB) + STREAM,
    "signature value": box(b"jP  ", b"abcd") + JP2 + header(ihdr(), RGB) + STREAM,
    "no file type": SIGNATURE + header(ihdr(), RGB) + STREAM,
    "file type length": SIGNATURE + box(b"ftyp", b"jp2 " + bytes(5)) + header(ihdr(), RGB) + STREAM,
    "brand": SIGNATURE + box(b"ftyp", b"abcd" + bytes(4)) + header(ihdr(), RGB) + STREAM,
    "no codestream": SIGNATURE + JP2 + header(ihdr(), RGB),
    "one header": SIGNATURE + JP2 + header(ihdr(), RGB) * 2 + STREAM,
    "place of the header": SIGNATURE + JP2 + STREAM + header(ihdr(), RGB),
    "image header first": SIGNATURE + JP2 + header(RGB, ihdr()) + STREAM,
    "repeated box": SIGNATURE + JP2 + header(ihdr(), ihdr(), RGB) + STREAM,
    "colour boxes apart": SIGNATURE + JP2 + header(ihdr(), RGB, cdef(*COLOURS), RGB) + STREAM,
    "palette and mapping together": SIGNATURE + JP2 + header(ihdr(), RGB, box(b"cmap", bytes(4))) + STREAM,
    "empty image": SIGNATURE + JP2 + header(ihdr(0), RGB) + STREAM,
    "reserved depth": SIGNATURE + JP2 + header(ihdr(3, 40), RGB) + STREAM,
    "compression type": SIGNATURE + JP2 + header(ihdr(3, 7, 0), RGB) + STREAM,
    "depths by component": SIGNATURE + JP2 + header(ihdr(3, 255), RGB) + STREAM,
    "no colour": SIGNATURE + JP2 + header(ihdr()) + STREAM,
    "colour length": SIGNATURE + JP2 + header(ihdr(), box(b"colr", u((1, 1), (0, 2)))) + STREAM,
    "channels without definition": SIGNATURE + JP2 + header(ihdr(4), RGB) + STREAM,
    "repeated meaning": SIGNATURE + JP2 + header(ihdr(), RGB, cdef((0, 0, 1), (1, 0, 1), (2, 0, 3))) + STREAM,
    "undescribed colour": SIGNATURE + JP2 + header(ihdr(4), RGB, cdef((0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 65535, 65535))) + STREAM,
}


def test_rules_of_containers(spark):
    rows = [(name, bytearray(data)) for name, data in CASES.items()] + [("cut", bytearray(CASES["ok"][:-1])), ("none", None), ("empty", bytearray())]
    found = containers.parse_containers(spark.createDataFrame(rows, "name string, payload binary"), "name", "payload")
    got = {r["name"]: r["status"] for r in found.select("name", "status").collect()}
    assert "impossible length" in got.pop("cut") and got.pop("none") == got.pop("empty") == "signature first"
    assert got == {name: name for name in CASES}


def test_fields_and_metadata_of_a_palette_image(spark):
    palette = u((2, 2), (3, 1), (7, 1), (6, 1), (11, 1)) + u((1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (6, 2))
    mapping = u((0, 2), (1, 1), (0, 1), (0, 2), (1, 1), (1, 1), (0, 2), (1, 1), (2, 1))
    inner = header(ihdr(1), RGB, box(b"colr", u((9, 1), (0, 2))), box(b"pclr", palette), box(b"cmap", mapping), box(b"abcd", b"??"))
    data = SIGNATURE + JP2 + box(b"uuid", b"0123") + inner + STREAM + box(b"xml ", b"<a/>")
    r = containers.parse_containers(spark.createDataFrame([(1, bytearray(data))], "k int, payload binary"), "k", "payload").first()
    assert r["status"] == "ok" and r["kind"] == "jp2" and r["file_type"]["compatible"] == ["jp2 "]
    assert (r["header"]["width"], r["header"]["height"], r["header"]["components"], r["header"]["bits"], r["header"]["signed"]) == (5, 4, 1, 8, False)
    assert (r["colour"]["method"], r["colour"]["space"]) == ("enumerated", 16)
    assert [(m["type"], bytes(m["data"])) for m in r["metadata"]] == [("uuid", b"0123"), ("xml ", b"<a/>"), ("pclr", palette), ("cmap", mapping), ("abcd", b"??")]
    at = r["codestreams"][0]
    assert data[at["at"] : at["at"] + at["size"]] == b"\xff\x4f"


def test_requests_beyond_a_limit_are_refused_before_work():
    import numpy as np

    data = codestream.encode([np.arange(99).reshape(9, 11) % 7] * 3, 8)
    assert len(codestream.decode(data, max_samples=297)) == 3
    with pytest.raises(codestream.Refused, match="297 samples"):
        codestream.decode(data, max_samples=296)
    assert codestream.decode(data, discard=2, components=[1], max_samples=9)[0].shape == (3, 3)
    with pytest.raises(codestream.Refused):
        codestream.decode(data, max_samples=0)


def test_workers_by_budget(spark):
    rows = spark.createDataFrame([(64, 64, 1)], "w long, h long, c long")
    blocks = limits.encode_blocks(F.col("w"), F.col("h"), F.col("c"))
    shared = limits.shared_bytes(F.col("w"), F.col("h"), F.col("c"), blocks, output=128)
    least = 4 * 64 * 64 + 4096 * 7 + 12 * 64 + 256
    budgets = [least - 1, least + (4 << 20) - 1, least + (4 << 20), least + (9 << 20), 1 << 40]
    got = rows.select(blocks, shared, *[limits.workers(shared, blocks, 8, b) for b in budgets]).first()
    assert list(got) == [7, least, 0, 0, 1, 2, 7]

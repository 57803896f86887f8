"""Lossless single-tile codestreams after the public standard: headers, packets, block data, and back.

Supported: one tile or a grid of tiles, one quality layer, reversible 5/3 with up to 8 levels, 64 x 64 blocks, the whole
resolution as one precinct, LRCP order, 1 to 4 components of equal size, the reversible colour transform for three.
Everything else is refused, never approximated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.functions.limits import DECODE_SAMPLES
from rasterloom.operators.entropy import decode_block, encode_block

#: Marker codes.
SOC, SIZ, COD, QCD, SOT, SOD, EOC = 0xFF4F, 0xFF51, 0xFF52, 0xFF5C, 0xFF90, 0xFF93, 0xFFD9
NAMES = {
    0xFF4F: "SOC", 0xFF50: "CAP", 0xFF51: "SIZ", 0xFF52: "COD", 0xFF53: "COC", 0xFF55: "TLM", 0xFF57: "PLM", 0xFF58: "PLT", 0xFF5C: "QCD", 0xFF5D: "QCC",
    0xFF5E: "RGN", 0xFF5F: "POC", 0xFF60: "PPM", 0xFF61: "PPT", 0xFF63: "CRG", 0xFF64: "COM", 0xFF90: "SOT", 0xFF93: "SOD", 0xFFD9: "EOC",
}
GUARD, BLOCK = 2, 64


class Refused(ValueError):
    """A codestream or image outside of the supported profile."""


# Reversible transform of whole planes


def _lift(x: np.ndarray, sign: int) -> np.ndarray:
    """One 5/3 level along the last axis, at interleaved positions; sign 1 analyses, -1 synthesises."""
    n = x.shape[-1]
    if n == 1:
        return x
    x = x.copy()
    pad = lambda: np.concatenate([x[..., 1:2], x, x[..., -2:-1]], axis=-1)

    def high() -> None:
        p = pad()
        x[..., 1::2] -= sign * ((p[..., 1:-1][..., 0::2][..., : n // 2] + p[..., 2:][..., 1::2]) >> 1)

    def low() -> None:
        p = pad()
        x[..., 0::2] += sign * ((p[..., :-2][..., 0::2] + p[..., 2:][..., 0::2] + 2) >> 2)

    for step in (high, low)[::sign]:
        step()
    return x


def analyse(plane: np.ndarray, levels: int) -> dict[tuple[int, str], np.ndarray]:
    """Bands by (resolution, name)."""
    bands = {}
    for r in range(levels, 0, -1):
        y = _lift(_lift(plane.T, 1).T, 1)
        bands |= {(r, "HL"): y[0::2, 1::2], (r, "LH"): y[1::2, 0::2], (r, "HH"): y[1::2, 1::2]}
        plane = y[0::2, 0::2]
    return bands | {(0, "LL"): plane}


def synthesise(bands: dict[tuple[int, str], np.ndarray], upto: int) -> np.ndarray:
    plane = bands[0, "LL"]
    for r in range(1, upto + 1):
        hl, lh, hh = (bands[r, b] for b in ("HL", "LH", "HH"))
        y = np.zeros((plane.shape[0] + lh.shape[0], plane.shape[1] + hl.shape[1]), np.int64)
        y[0::2, 0::2], y[0::2, 1::2], y[1::2, 0::2], y[1::2, 1::2] = plane, hl, lh, hh
        plane = _lift(_lift(y, -1).T, -1).T
    return plane


# Packet headers


class Bits:
    """Bits of a packet header: after a byte of ones, one bit is left out."""

    def __init__(self, data: bytes = b"", at: int = 0):
        self.data, self.at, self.out = data, at, bytearray()
        self.held, self.left = 0, 8

    def put(self, value: int, n: int = 1) -> None:
        for k in range(n - 1, -1, -1):
            self.left -= 1
            self.held |= (value >> k & 1) << self.left
            if not self.left:
                self._flush()

    def _flush(self) -> None:
        self.out.append(self.held)
        self.held, self.left = 0, 7 if self.held == 0xFF else 8

    def done(self) -> bytes:
        full = 7 if self.out and self.out[-1] == 0xFF else 8
        if self.left < full or full == 7:
            self._flush()
        return bytes(self.out)

    def get(self, n: int = 1) -> int:
        value = 0
        for _ in range(n):
            if self.left == 8 or not self.left:
                stuffed = self.at > 0 and self.left == 0 and self.held == 0xFF
                if self.at >= len(self.data):
                    raise Refused("a packet header is cut off")
                self.held, self.at = self.data[self.at], self.at + 1
                self.left = 7 if stuffed else 8
                if self.left == 8:
                    self.left = 0
                    value = value << 1 | self.held >> 7
                    self.left = 7
                    continue
            self.left -= 1
            value = value << 1 | self.held >> self.left & 1
        return value

    def stop(self) -> int:
        """Where the body begins."""
        if self.held == 0xFF:
            self.at += 1
        return self.at


class TagTree:
    def __init__(self, width: int, height: int, values: np.ndarray | None = None):
        self.shapes = [(height, width)]
        while self.shapes[-1] != (1, 1):
            h, w = self.shapes[-1]
            self.shapes.append((-(-h // 2), -(-w // 2)))
        self.low = [[[0] * w for _ in range(h)] for h, w in self.shapes]
        self.known = [[[False] * w for _ in range(h)] for h, w in self.shapes]
        self.value = [[[1 << 30] * w for _ in range(h)] for h, w in self.shapes]
        if values is not None:
            self.value[0] = values.tolist()
            for k in range(1, len(self.shapes)):
                for y, row in enumerate(self.value[k - 1]):
                    for x, v in enumerate(row):
                        at = self.value[k][y // 2]
                        at[x // 2] = min(at[x // 2], v)

    def _path(self, y: int, x: int) -> Iterator[tuple[int, int, int]]:
        for k in range(len(self.shapes) - 1, -1, -1):
            yield k, y >> k, x >> k

    def code(self, y: int, x: int, threshold: int, bit) -> bool:
        """Whether the leaf's value is below the threshold. `bit(value or None)` writes or reads a decision."""
        low = 0
        for k, ny, nx in self._path(y, x):
            lows, known, values = self.low[k][ny], self.known[k][ny], self.value[k][ny]
            low = max(low, lows[nx])
            while low < threshold and not known[nx]:
                if bit(int(values[nx] <= low)):
                    values[nx], known[nx] = low, True
                else:
                    low += 1
            lows[nx] = low
            if known[nx]:
                low = max(low, values[nx])
        return self.known[0][y][x] and self.value[0][y][x] < threshold


def _put_passes(bits: Bits, n: int) -> None:
    if n == 1:
        bits.put(0)
    elif n == 2:
        bits.put(0b10, 2)
    elif n <= 5:
        bits.put(0b1100 | n - 3, 4)
    elif n <= 36:
        bits.put(0b1111 << 5 | n - 6, 9)
    else:
        bits.put(0b111111111 << 7 | n - 37, 16)


def _get_passes(bits: Bits) -> int:
    if not bits.get():
        return 1
    if not bits.get():
        return 2
    if (n := bits.get(2)) < 3:
        return 3 + n
    if (n := bits.get(5)) < 31:
        return 6 + n
    return 37 + bits.get(7)


def _names(resolution: int) -> tuple[str, ...]:
    return ("HL", "LH", "HH") if resolution else ("LL",)


def _grid(band: np.ndarray | tuple[int, int]) -> tuple[int, int]:
    h, w = band.shape if isinstance(band, np.ndarray) else band
    return -(-h // BLOCK), -(-w // BLOCK)


def _write_packet(bands: list[tuple[str, np.ndarray, int]]) -> bytes:
    """bands: name, coefficients, magnitude bits that the header promises."""
    bits, body = Bits(), bytearray()
    bits.put(1)
    for name, band, most in bands:
        if not band.size:
            continue
        rows, cols = _grid(band)
        coded = {
            (y, x): encode_block(band[y * BLOCK : (y + 1) * BLOCK, x * BLOCK : (x + 1) * BLOCK].tolist(), name) for y in range(rows) for x in range(cols)
        }
        shape = np.array([[coded[y, x][0] for x in range(cols)] for y in range(rows)])
        inclusion, zeros = TagTree(cols, rows, (shape == 0).astype(np.int64)), TagTree(cols, rows, np.where(shape > 0, most - shape, 1 << 20))
        put = lambda v: bits.put(v) or v
        for (y, x), (planes, data) in coded.items():
            if not inclusion.code(y, x, 1, put):
                continue
            if planes > most:
                raise Refused("a coefficient is beyond the promised range")
            threshold = 1
            while not zeros.code(y, x, threshold, put):
                threshold += 1
            passes = 3 * planes - 2
            _put_passes(bits, passes)
            base = passes.bit_length() - 1
            more = max(0, len(data).bit_length() - 3 - base)
            bits.put((1 << more + 1) - 2, more + 1)
            bits.put(len(data), 3 + more + base)
            body += data
    return bits.done() + bytes(body)


def _read_packet(data: bytes, at: int, bands: list[tuple[str, tuple[int, int], int]]) -> tuple[list[np.ndarray], int]:
    bits = Bits(data, at)
    out = [np.zeros(shape, np.int64) for _, shape, _ in bands]
    found = []
    if bits.get():
        for k, (_, shape, most) in enumerate(bands):
            if not shape[0] or not shape[1]:
                continue
            rows, cols = _grid(shape)
            inclusion, zeros = TagTree(cols, rows), TagTree(cols, rows)
            read = lambda _: bits.get()
            for y in range(rows):
                for x in range(cols):
                    if not inclusion.code(y, x, 1, read):
                        continue
                    threshold = 1
                    while not zeros.code(y, x, threshold, read):
                        threshold += 1
                        if threshold > 80:
                            raise Refused("too many missing bit planes")
                    passes = _get_passes(bits)
                    more = 0
                    while bits.get():
                        more += 1
                    size = bits.get(3 + more + passes.bit_length() - 1)
                    planes = most - (threshold - 1)
                    if passes != 3 * planes - 2:
                        raise Refused("a block without all of its passes")
                    found.append((k, y, x, planes, size))
    at = bits.stop()
    for k, y, x, planes, size in found:
        if at + size > len(data):
            raise Refused("block data is cut off")
        ys, xs = y * BLOCK, x * BLOCK
        h, w = min(BLOCK, out[k].shape[0] - ys), min(BLOCK, out[k].shape[1] - xs)
        out[k][ys : ys + h, xs : xs + w] = decode_block(w, h, planes, data[at : at + size], bands[k][0])
        at += size
    return out, at


# Codestreams


def _segment(code: int, body: bytes) -> bytes:
    return code.to_bytes(2, "big") + (len(body) + 2).to_bytes(2, "big") + body


def _most(bits: int, name: str, coloured: bool) -> int:
    """Magnitude bits of a band that the quantisation segment promises."""
    gain = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}[name]
    return GUARD - 1 + bits + gain + coloured


def encode(planes: list[np.ndarray], bits: int, levels: int = 2, tile: int | None = None) -> bytes:
    """A codestream of unsigned components."""
    h, w = planes[0].shape
    if not 1 <= bits <= 16 or not 0 <= levels <= 8 or not 1 <= len(planes) <= 4 or any(p.shape != (h, w) for p in planes):
        raise Refused("unsupported image")
    if any(p.min() < 0 or p.max() >= 1 << bits for p in planes):
        raise Refused("a sample is out of range")
    u = lambda v, n: int(v).to_bytes(n, "big")
    edge_x, edge_y = tile or w, tile or h
    coloured = len(planes) == 3
    out = SOC.to_bytes(2, "big")
    size = u(0, 2) + u(w, 4) + u(h, 4) + u(0, 8) + u(edge_x, 4) + u(edge_y, 4) + u(0, 8) + u(len(planes), 2)
    out += _segment(SIZ, size + bytes([bits - 1, 1, 1]) * len(planes))
    out += _segment(COD, bytes([0, 0, 0, 1, coloured, levels, 4, 4, 0, 1]))
    steps = [name for r in range(levels + 1) for name in _names(r)]
    out += _segment(QCD, bytes([GUARD << 5] + [_most(bits, n, coloured) - GUARD + 1 << 3 for n in steps]))
    number = 0
    for y in range(0, h, edge_y):
        for x in range(0, w, edge_x):
            parts = [p[y : y + edge_y, x : x + edge_x].astype(np.int64) - (1 << bits - 1) for p in planes]
            if coloured:
                r, g, b = parts
                parts = [r + 2 * g + b >> 2, b - g, r - g]
            coded = [analyse(p, levels) for p in parts]
            body = b"".join(
                _write_packet([(n, bands[r, n], _most(bits, n, coloured)) for n in _names(r)]) for r in range(levels + 1) for bands in coded
            )
            out += _segment(SOT, u(number, 2) + u(len(body) + 14, 4) + bytes([0, 1])) + SOD.to_bytes(2, "big") + body
            number += 1
    return out + EOC.to_bytes(2, "big")


def markers(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(name, offset, contents) of the marker segments; tile bodies are passed over by their stated lengths."""
    at, tile = 0, None
    while at + 2 <= len(data):
        code = int.from_bytes(data[at : at + 2], "big")
        name = NAMES.get(code)
        if name is None:
            raise Refused(f"no marker at {at}")
        if code in (SOC, EOC):
            yield name, at, b""
            at += 2
        elif code == SOD:
            if tile is None:
                raise Refused("data without a tile")
            yield name, at, data[at + 2 : tile]
            at, tile = tile, None
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > len(data):
                raise Refused(f"the segment at {at} is cut off")
            body = data[at + 4 : at + 2 + size]
            yield name, at, body
            if code == SOT:
                length = int.from_bytes(body[2:6], "big")
                tile = at + length if length else len(data) - 2
                if tile > len(data):
                    raise Refused("a tile is cut off")
            at += 2 + size


def inspect(data: bytes) -> dict:
    """Geometry and coding of a codestream from its headers alone; `supported` says whether decode takes it."""
    info: dict = {"supported": True}
    for name, _, body in markers(data):
        n = lambda a, k, body=body: int.from_bytes(body[a : a + k], "big")
        if name == "SIZ":
            count = n(34, 2)
            depth = [body[36 + 3 * c] for c in range(count)]
            info |= {"width": n(2, 4) - n(10, 4), "height": n(6, 4) - n(14, 4), "tile_width": n(18, 4), "tile_height": n(22, 4), "components": count}
            info |= {"bits": (depth[0] & 127) + 1, "signed": depth[0] > 127}
            even = len(set(depth)) == 1 and all(body[37 + 3 * c : 39 + 3 * c] == b"\1\1" for c in range(count)) and not n(10, 8) and not n(26, 8)
            info["supported"] &= even and not info["signed"] and n(0, 2) == 0
        elif name == "COD":
            info |= {"progression": body[1], "layers": n(2, 2), "colour": bool(body[4]), "levels": body[5], "reversible": body[9] == 1}
            info["supported"] &= body[0] == 0 and body[1] == 0 and n(2, 2) == 1 and body[6:9] == b"\4\4\0" and body[9] == 1
        elif name == "QCD":
            info |= {"guard": body[0] >> 5, "exponents": [b >> 3 for b in body[1:]]}
            info["supported"] &= body[0] & 31 == 0
        elif name in ("COC", "QCC", "RGN", "POC", "PPM", "PPT", "CAP"):
            info["supported"] = False
    if not {"width", "levels", "guard"} <= set(info):
        raise Refused("a header segment is missing")
    return info


def tile_index(data: bytes) -> list[tuple[int, int, int]]:
    """(tile, first byte, byte after) of the tile bodies: one pass over the headers, no bodies are read."""
    out, tile = [], None
    for name, at, body in markers(data):
        if name == "SOT":
            tile = int.from_bytes(body[:2], "big")
            if any(t == tile for t, _, _ in out):
                raise Refused("a tile in several parts")
        elif name == "SOD":
            out.append((tile, at + 2, at + 2 + len(body)))
    return out


def decode(
    data: bytes, region: tuple[int, int, int, int] | None = None, discard: int = 0, components: list[int] | None = None, max_samples: int = DECODE_SAMPLES
) -> list[np.ndarray]:
    """Components of a region (x, y, w, h) at full size, or of the whole image with some levels discarded.

    Only the tiles that a region touches are decoded. A request for more samples than max_samples is refused from the
    headers alone.
    """
    info = inspect(data)
    if not info["supported"]:
        raise Refused("unsupported codestream")
    w, h, levels, bits = info["width"], info["height"], info["levels"], info["bits"]
    if not 0 <= discard <= levels or (region and discard):
        raise Refused("unsupported resolution")
    x0, y0, rw, rh = region or (0, 0, w, h)
    if rw <= 0 or rh <= 0 or x0 < 0 or y0 < 0 or x0 + rw > w or y0 + rh > h:
        raise Refused("the region is empty or not within the image")
    keep = levels - discard
    two = 1 << discard
    wanted = list(range(info["components"])) if components is None else components
    if len(set(wanted)) != len(wanted) or any(not 0 <= c < info["components"] for c in wanted):
        raise Refused("unknown or repeated components")
    requested = -(-rh // two) * -(-rw // two) * len(wanted)
    if max_samples <= 0 or requested > max_samples:
        raise Refused(f"the request has {requested} samples, of {max_samples} at most")
    steps = [(r, n) for r in range(levels + 1) for n in _names(r)]
    most = {s: info["guard"] + e - 1 for s, e in zip(steps, info["exponents"], strict=True)}
    across = -(-w // info["tile_width"])
    out = [np.zeros((-(-rh // two), -(-rw // two)), np.int64) for _ in wanted]
    for tile, start, stop in tile_index(data):
        tx, ty = tile % across * info["tile_width"], tile // across * info["tile_height"]
        tw, th = min(info["tile_width"], w - tx), min(info["tile_height"], h - ty)
        if tx >= x0 + rw or tx + tw <= x0 or ty >= y0 + rh or ty + th <= y0:
            continue
        shapes: dict[tuple[int, str], tuple[int, int]] = {}
        a, b = th, tw
        for r in range(levels, 0, -1):
            shapes |= {(r, "HL"): (-(-a // 2), b // 2), (r, "LH"): (a // 2, -(-b // 2)), (r, "HH"): (a // 2, b // 2)}
            a, b = -(-a // 2), -(-b // 2)
        shapes[0, "LL"] = (a, b)
        body, at = data[start:stop], 0
        found: list[dict] = [{} for _ in range(info["components"])]
        for r in range(keep + 1):
            for bands in found:
                got, at = _read_packet(body, at, [(n, shapes[r, n], most[r, n]) for n in _names(r)])
                bands |= {(r, n): g for n, g in zip(_names(r), got, strict=True)}
        planes = [synthesise(bands, keep) for bands in found]
        if info["colour"]:
            y, db, dr = planes[:3]
            g = y - (db + dr >> 2)
            planes[:3] = [dr + g, g, db + g]
        for target, c in zip(out, wanted, strict=True):
            p = np.clip(planes[c] + (1 << bits - 1), 0, (1 << bits) - 1)
            if discard:
                target[-(-ty // two) : -(-ty // two) + p.shape[0], -(-tx // two) : -(-tx // two) + p.shape[1]] = p
                continue
            left, top, right, low = max(tx, x0), max(ty, y0), min(tx + tw, x0 + rw), min(ty + th, y0 + rh)
            target[top - y0 : low - y0, left - x0 : right - x0] = p[top - ty : low - ty, left - tx : right - tx]
    return out


# DataFrames

_PLANES = pa.list_(pa.list_(pa.list_(pa.int64())))


def encode_images(images: DataFrame, key: str, planes: str, bits: int = 8, levels: int = 2, tile: int | None = None) -> DataFrame:
    """(key, payload) from arrays of components of rows of samples."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [encode([np.array(p, np.int64) for p in image], bits, levels, tile) for image in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [key, "payload"])

    return images.select(key, planes).mapInArrow(run, f"{key} {kind}, payload binary")


def decode_images(streams: DataFrame, key: str, payload: str = "payload", **options) -> DataFrame:
    """(key, planes) of the codestreams; options as for decode."""
    kind = streams.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [[p.tolist() for p in decode(d, **options)] for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(planes, _PLANES)], [key, "planes"])

    return streams.select(key, payload).mapInArrow(run, f"{key} {kind}, planes array<array<array<long>>>")


def index_tiles(streams: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, tile, start, stop): where tile bodies lie, to be kept as a table and joined with requests."""
    kind = streams.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *t) for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in tile_index(d)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "tile", "start", "stop"])

    return streams.select(key, payload).mapInArrow(run, f"{key} {kind}, tile int, start long, stop long")


def inspect_images(streams: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, width, height, components, bits, levels, colour, supported) from headers alone."""
    kind = streams.schema[key].dataType.simpleString()
    fields = [("width", pa.int32()), ("height", pa.int32()), ("components", pa.int32()), ("bits", pa.int32()), ("levels", pa.int32()), ("colour", pa.bool_()), ("supported", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inspect(d) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([i[n] for i in found], t) for n, t in fields]], [key, *[n for n, _ in fields]])

    return streams.select(key, payload).mapInArrow(
        run, f"{key} {kind}, width int, height int, components int, bits int, levels int, colour boolean, supported boolean"
    )

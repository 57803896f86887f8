"""Bit-plane block coding with the adaptive binary arithmetic coder of the public standard.

The coder is sequential within a block. This module codes one block at a time, with all styles; `operators.blocks` takes
many blocks of a batch through the same decisions at once.
"""

from __future__ import annotations

from collections.abc import Iterator

from rasterloom.functions.contexts import SIGN_CONTEXTS

#: Probability states of the coder (estimate, next if more probable, next if less probable, switch).
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]
#: Contexts, and the states that some of them begin in.
RUN, UNIFORM, CONTEXTS = 17, 18, 19
INITIAL = {0: 4, RUN: 3, UNIFORM: 46}


class _Contexts:
    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.state = [INITIAL.get(k, 0) for k in range(CONTEXTS)]
        self.likely = [0] * CONTEXTS

    def after_likely(self, cx: int) -> None:
        self.state[cx] = STATES[self.state[cx]][1]

    def after_unlikely(self, cx: int) -> None:
        _, _, to, switch = STATES[self.state[cx]]
        self.likely[cx] ^= switch
        self.state[cx] = to


class Encoder(_Contexts):
    def __init__(self) -> None:
        super().__init__()
        self.start()

    def start(self) -> None:
        """Begin a codeword; contexts stay as they are."""
        self.a, self.c, self.count, self.out = 0x8000, 0, 12, bytearray([0])

    def encode(self, cx: int, bit: int) -> None:
        estimate = STATES[self.state[cx]][0]
        self.a -= estimate
        if bit == self.likely[cx]:
            if self.a & 0x8000:
                self.c += estimate
                return
            if self.a < estimate:
                self.a = estimate
            else:
                self.c += estimate
            self.after_likely(cx)
        else:
            if self.a < estimate:
                self.c += estimate
            else:
                self.a = estimate
            self.after_unlikely(cx)
        while True:
            self.a, self.c, self.count = self.a << 1, self.c << 1, self.count - 1
            if not self.count:
                self._byte()
            if self.a & 0x8000:
                break

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c & 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c, self.count = self.c & 0xFFFFF, 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c, self.count = self.c & 0x7FFFF, 8

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.count
            self._byte()
        return bytes(self.out[1:] if self.out[-1] != 0xFF else self.out[1:-1])


class Decoder(_Contexts):
    def __init__(self, data: bytes) -> None:
        super().__init__()
        self.start(data)

    def start(self, data: bytes) -> None:
        self.data, self.at, self.a = data, 0, 0x8000
        self.c, self.count = self._peek(0) << 16, 0
        self._byte()
        self.c, self.count = self.c << 7, self.count - 7

    def _peek(self, at: int) -> int:
        return self.data[at] if at < len(self.data) else 0xFF

    def _byte(self) -> None:
        if self._peek(self.at) == 0xFF:
            if self._peek(self.at + 1) > 0x8F:
                self.c, self.count = self.c + 0xFF00, 8
            else:
                self.at += 1
                self.c, self.count = self.c + (self._peek(self.at) << 9), 7
        else:
            self.at += 1
            self.c, self.count = self.c + (self._peek(self.at) << 8), 8

    def decode(self, cx: int) -> int:
        estimate = STATES[self.state[cx]][0]
        bit = self.likely[cx]
        self.a -= estimate
        if self.c >> 16 < estimate:
            small = self.a < estimate
            self.a = estimate
            if small:
                self.after_likely(cx)
            else:
                bit ^= 1
                self.after_unlikely(cx)
        else:
            self.c -= estimate << 16
            if self.a & 0x8000:
                return bit
            if self.a < estimate:
                bit ^= 1
                self.after_unlikely(cx)
            else:
                self.after_likely(cx)
        while True:
            if not self.count:
                self._byte()
            self.a, self.c, self.count = self.a << 1, (self.c << 1) & 0xFFFFFFFF, self.count - 1
            if self.a & 0x8000:
                return bit


class RawWriter:
    """Bits as they are; after a byte of ones, one bit is left out."""

    def __init__(self) -> None:
        self.out, self.held, self.left = bytearray(), 0, 8

    def put(self, bit: int) -> None:
        self.left -= 1
        self.held |= bit << self.left
        if not self.left:
            self.out.append(self.held)
            self.held, self.left = 0, 7 if self.held == 0xFF else 8

    def finish(self) -> bytes:
        fill = 0
        while self.left < (7 if self.out and self.out[-1] == 0xFF else 8):
            self.put(fill)
            fill ^= 1
        return bytes(self.out[:-1] if self.out and self.out[-1] == 0xFF else self.out)


class RawReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.left = data, 0, 0, 0

    def get(self) -> int:
        if not self.left:
            full = self.held == 0xFF and self.at > 0
            self.held = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at, self.left = self.at + 1, 7 if full else 8
        self.left -= 1
        return self.held >> self.left & 1


#: Block styles and their flags.
STYLES = {"bypass": 0x01, "reset": 0x02, "terminate": 0x04, "causal": 0x08, "segmentation": 0x20}


def segment_lengths(passes: int, style: frozenset[str]) -> list[int]:
    """Passes of each codeword segment of a block."""
    if "terminate" in style:
        return [1] * passes
    if "bypass" not in style:
        return [passes]
    out, at = [], 0
    while at < passes:
        n = 10 - at if at < 10 else 2 if (at - 10) % 3 == 0 else 1
        out.append(min(n, passes - at))
        at += n
    return out


def zero_context(band: str, h: int, v: int, d: int) -> int:
    """Context of a coefficient with so many significant neighbours beside, above or below, and across corners."""
    if band == "HH":
        s = h + v
        return 8 if d >= 3 else (7 if s else 6) if d == 2 else 3 + min(s, 2) if d == 1 else min(s, 2)
    if band == "HL":
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    return 2 + v if v else min(d, 2)


class BlockCoder:
    """The three passes over a block of signed coefficients, for encoding and for decoding.

    `port.bit(context, value)` codes a decision and returns it: an encoder is given the value, a decoder finds it.
    `port.begin(pass)` says whether the pass is raw, `port.end(pass)` closes it.
    """

    def __init__(self, width: int, height: int, band: str, port, style: frozenset[str] = frozenset()):
        self.w, self.h, self.band, self.port, self.style = width, height, band, port, style
        self.causal = "causal" in style
        self.raw = False
        self.sign: dict[tuple[int, int], int] = {}
        self.size: dict[tuple[int, int], int] = {}
        self.refined: set[tuple[int, int]] = set()

    def _near(self, y: int, x: int) -> tuple[int, int, int]:
        if not self.sign:
            return 0, 0, 0
        on = self.sign.__contains__
        h = on((y, x - 1)) + on((y, x + 1))
        v = on((y - 1, x))
        d = on((y - 1, x - 1)) + on((y - 1, x + 1))
        if not (self.causal and y % 4 == 3):
            v += on((y + 1, x))
            d += on((y + 1, x - 1)) + on((y + 1, x + 1))
        return h, v, d

    def _zero_context(self, y: int, x: int) -> int:
        return zero_context(self.band, *self._near(y, x))

    def _become(self, y: int, x: int, plane: int, value: int) -> None:
        """Code the sign of a coefficient that turns significant."""
        if self.raw:
            self.sign[y, x] = self.port.bit(0, int(value < 0))
        else:
            s = lambda p: 0 if p not in self.sign else -1 if self.sign[p] else 1
            below = 0 if self.causal and y % 4 == 3 else s((y + 1, x))
            h = max(-1, min(1, s((y, x - 1)) + s((y, x + 1))))
            v = max(-1, min(1, s((y - 1, x)) + below))
            context, flip = SIGN_CONTEXTS[h, v]
            self.sign[y, x] = self.port.bit(context, int(value < 0) ^ flip) ^ flip
        self.size[y, x] = 1 << plane

    def _stripes(self) -> Iterator[tuple[int, int, int]]:
        for top in range(0, self.h, 4):
            for x in range(self.w):
                yield top, min(top + 4, self.h), x

    def _significance(self, plane: int, value, done: set) -> None:
        for top, end, x in self._stripes():
            for y in range(top, end):
                if (y, x) not in self.sign and any(self._near(y, x)):
                    done.add((y, x))
                    if self.port.bit(self._zero_context(y, x), abs(value(y, x)) >> plane & 1):
                        self._become(y, x, plane, value(y, x))

    def _refinement(self, plane: int, value, done: set) -> None:
        for top, end, x in self._stripes():
            for y in range(top, end):
                if (y, x) in self.sign and (y, x) not in done:
                    context = 16 if (y, x) in self.refined else 15 if any(self._near(y, x)) else 14
                    if self.port.bit(context, abs(value(y, x)) >> plane & 1):
                        self.size[y, x] += 1 << plane
                    self.refined.add((y, x))

    def _cleanup(self, plane: int, value, done: set) -> None:
        bit = self.port.bit
        for top, end, x in self._stripes():
            y = top
            quiet = end - top == 4 and all((k, x) not in self.sign and (k, x) not in done and not any(self._near(k, x)) for k in range(top, end))
            if quiet:
                first = next((k for k in range(4) if abs(value(top + k, x)) >> plane & 1), None)
                if not bit(RUN, int(first is not None)):
                    continue
                k = bit(UNIFORM, (first or 0) >> 1) << 1
                k |= bit(UNIFORM, (first or 0) & 1)
                self._become(top + k, x, plane, value(top + k, x))
                y = top + k + 1
            for y in range(y, end):
                if (y, x) not in self.sign and (y, x) not in done and bit(self._zero_context(y, x), abs(value(y, x)) >> plane & 1):
                    self._become(y, x, plane, value(y, x))
        if "segmentation" in self.style and [bit(UNIFORM, b) for b in (1, 0, 1, 0)] != [1, 0, 1, 0]:
            raise ValueError("a segmentation symbol is damaged")

    def run(self, planes: int, values=None) -> dict[tuple[int, int], int]:
        """Codes all planes, the highest with a cleanup pass only; returns the coefficients that are not 0."""
        value = (lambda y, x: 0) if values is None else (lambda y, x: values[y][x])
        number = 0
        for plane in range(planes - 1, -1, -1):
            done: set[tuple[int, int]] = set()
            steps = [self._significance, self._refinement, self._cleanup]
            for step in steps if plane < planes - 1 else steps[2:]:
                self.raw = self.port.begin(number)
                step(plane, value, done)
                self.port.end(number)
                number += 1
        return {p: -s if self.sign[p] else s for p, s in self.size.items()}


class _Port:
    """Changes between codeword segments at the passes where a style ends them."""

    def __init__(self, passes: int, style: frozenset[str]):
        self.style, self.lengths = style, segment_lengths(passes, style)
        self.starts = {sum(self.lengths[:k]): k for k in range(len(self.lengths))}
        self.ends = {sum(self.lengths[: k + 1]) - 1 for k in range(len(self.lengths))}

    def is_raw(self, number: int) -> bool:
        return "bypass" in self.style and number >= 10 and number % 3 != 0


class _WritePort(_Port):
    def __init__(self, passes: int, style: frozenset[str]):
        super().__init__(passes, style)
        self.coder, self.writer, self.segments = Encoder(), None, []

    def begin(self, number: int) -> bool:
        raw = self.is_raw(number)
        if number in self.starts:
            self.writer = RawWriter() if raw else None
            if not raw:
                self.coder.start()
        return raw

    def bit(self, context: int, value: int) -> int:
        if self.writer is not None:
            self.writer.put(value)
        else:
            self.coder.encode(context, value)
        return value

    def end(self, number: int) -> None:
        if number in self.ends:
            self.segments.append(self.coder.finish() if self.writer is None else self.writer.finish())
        if "reset" in self.style:
            self.coder.reset()


class _ReadPort(_Port):
    def __init__(self, passes: int, style: frozenset[str], segments: list[bytes]):
        super().__init__(passes, style)
        if len(segments) != len(self.lengths):
            raise ValueError("segments are missing or too many")
        self.segments, self.coder, self.reader = segments, Decoder(b""), None

    def begin(self, number: int) -> bool:
        raw = self.is_raw(number)
        if number in self.starts:
            data = self.segments[self.starts[number]]
            self.reader = RawReader(data) if raw else None
            if not raw:
                self.coder.start(data)
        return raw

    def bit(self, context: int, _: int) -> int:
        return self.coder.decode(context) if self.reader is None else self.reader.get()

    def end(self, number: int) -> None:
        if "reset" in self.style:
            self.coder.reset()


def _checked(style) -> frozenset[str]:
    if unknown := set(style) - set(STYLES):
        raise ValueError(f"unsupported styles {sorted(unknown)}")
    return frozenset(style)


def encode_segments(values: list[list[int]], band: str = "LL", style=()) -> tuple[int, list[bytes]]:
    """Planes and codeword segments of a block; a block of zeros has none."""
    planes = max(abs(v) for row in values for v in row).bit_length()
    if not planes:
        return 0, []
    style = _checked(style)
    port = _WritePort(3 * planes - 2, style)
    BlockCoder(len(values[0]), len(values), band, port, style).run(planes, values)
    return planes, port.segments


def decode_segments(width: int, height: int, planes: int, segments: list[bytes], band: str = "LL", style=()) -> list[list[int]]:
    found = {}
    if planes:
        style = _checked(style)
        found = BlockCoder(width, height, band, _ReadPort(3 * planes - 2, style, segments), style).run(planes)
    return [[found.get((y, x), 0) for x in range(width)] for y in range(height)]


def encode_block(values: list[list[int]], band: str = "LL") -> tuple[int, bytes]:
    """Planes and bytes of a block without styles."""
    planes, segments = encode_segments(values, band)
    return planes, segments[0] if segments else b""


def decode_block(width: int, height: int, planes: int, data: bytes, band: str = "LL") -> list[list[int]]:
    return decode_segments(width, height, planes, [data], band)

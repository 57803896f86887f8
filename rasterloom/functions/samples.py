"""Scalar arithmetic on samples and coefficients, as Column expressions.

Divisions that must round down are shifts or floor(); nothing relies on how an engine truncates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the irreversible colour transform and of its inverse.
ICT_FORWARD = ((0.299, 0.587, 0.114), (-0.16875, -0.33126, 0.5), (0.5, -0.41869, -0.08131))
ICT_INVERSE = (1.402, 0.34413, 0.71414, 1.772)


def clamp(v: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def level_shift(v: Column, bits: int) -> Column:
    return v - F.lit(1 << (bits - 1))


def unshift_clamped(c: Column, bits: int = 8) -> Column:
    return clamp(c + F.lit(1 << (bits - 1)), 0, (1 << bits) - 1)


def rct(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Reversible colour transform: luma and two differences."""
    return F.shiftright(r + 2 * g + b, 2), b - g, r - g


def inverse_rct(y: Column, db: Column, dr: Column) -> tuple[Column, Column, Column]:
    g = y - F.shiftright(db + dr, 2)
    return dr + g, g, db + g


def ict(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return tuple(F.lit(a) * r + F.lit(c) * g + F.lit(e) * b for a, c, e in ICT_FORWARD)


def inverse_ict(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    a, c, d, e = ICT_INVERSE
    return y + F.lit(a) * cr, y - F.lit(c) * cb - F.lit(d) * cr, y + F.lit(e) * cb


def ycc_to_rgb8(y: Column, cb: Column, cr: Column) -> tuple[Column, ...]:
    """Luma and chroma around 128 to 8-bit channels; halves round away from zero."""
    parts = inverse_ict(y.cast("double"), cb.cast("double") - 128, cr.cast("double") - 128)
    return tuple(clamp(F.round(p).cast("long"), 0, 255) for p in parts)


def step_size(mantissa: Column, exponent: Column, precision: Column, gain: Column) -> Column:
    return (F.lit(1.0) + mantissa / F.lit(2048.0)) * F.pow(F.lit(2.0), (precision + gain - exponent).cast("double"))


def quantise(v: Column, delta: Column) -> Column:
    """Dead zone quantiser: sign and floor of the magnitude in steps."""
    return (F.signum(v) * F.floor(F.abs(v) / delta)).cast("long")


def dequantise(c: Column, planes: Column, delta: Column) -> Column:
    return c / F.pow(F.lit(2.0), (30 - planes).cast("double")) * (F.lit(0.5) * delta)


def toward_zero_shift(c: Column, shift: Column | int) -> Column:
    """The magnitude shifted right, with the sign kept."""
    n = shift if isinstance(shift, int) else None
    size = F.shiftright(F.abs(c), n) if n is not None else F.floor(F.abs(c) / F.pow(F.lit(2.0), shift.cast("double"))).cast("long")
    return F.when(c < 0, -size).otherwise(size)


def sign_magnitude_shift(c: Column, shift: int) -> Column:
    """A 32-bit sign and magnitude word (as an unsigned long) to a shifted signed value."""
    size = F.shiftright(c.bitwiseAND(F.lit(0x7FFFFFFF)), shift)
    return F.when(c.bitwiseAND(F.lit(0x80000000)) != 0, -size).otherwise(size)


def maxshift_restore(c: Column, available: int, shift: int) -> tuple[Column, Column]:
    """Whether a coefficient belongs to the region of interest, and its doubled restored value if so."""
    alignment = 30 - available
    inside = F.abs(c) >= F.lit(1 << (alignment + shift + 1))
    return inside, F.when(inside, toward_zero_shift(c, alignment + shift))


def rebuild_cleanup(magsgn: Column, bits: Column, known_one: Column, missing: int) -> Column:
    """A coefficient from its sign and magnitude bits: the lowest bit is the sign."""
    n = bits.cast("int")
    low = magsgn.bitwiseAND(F.expr("1L") * F.pow(F.lit(2), n).cast("long") - 1)
    size = (low.bitwiseOR(known_one * F.pow(F.lit(2), n).cast("long")).bitwiseOR(F.lit(1)) + 2) * F.lit(1 << (30 - missing - 1))
    return F.when(magsgn.bitwiseAND(F.lit(1)) == 1, -size).otherwise(size)


def reduce_precision(v: Column, from_bits: int, to_bits: int) -> Column:
    if to_bits > from_bits:
        raise ValueError("precision can only be reduced")
    return F.shiftright(v, from_bits - to_bits)


def decode_sample(data: Column, at: int, width: int, little: bool = False, signed: bool = False) -> Column:
    """One or two bytes at a byte offset, as a number."""
    def byte(k: int) -> Column:
        return F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("long")

    order = range(width - 1, -1, -1) if little else range(width)
    v = F.lit(0).cast("long")
    for k in order:
        v = v * 256 + byte(k)
    return F.when(v >= (1 << (8 * width - 1)), v - (1 << (8 * width))).otherwise(v) if signed else v


def ceil_div(v: Column, s: Column | int) -> Column:
    """Ceiling of the quotient of whole numbers, s > 0."""
    s = s if isinstance(s, Column) else F.lit(s)
    return -F.floor(-v / s).cast("long")


def low_count(n: Column, origin: Column) -> Column:
    """Samples of the low band of a line of n that begins at an even or odd origin."""
    return F.when(origin % 2 == 0, F.floor((n + 1) / 2)).otherwise(F.floor(n / 2)).cast("long")


def even_start(x: Column) -> Column:
    return x - x % 2


def magnitude_planes(v: Column) -> Column:
    """Bit planes of a magnitude; 0 for 0."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(F.abs(v).cast("long"))))

"""Coding contexts of bit-plane passes from static neighbour counts, after the tables of the public standard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (horizontal sign, vertical sign) to (context label, flip).
SIGN_CONTEXTS = {
    (1, 1): (13, 0), (1, 0): (12, 0), (1, -1): (11, 0),
    (0, 1): (10, 0), (0, 0): (9, 0), (0, -1): (10, 1),
    (-1, 1): (11, 1), (-1, 0): (12, 1), (-1, -1): (13, 1),
}


def coding_pass(i: Column) -> Column:
    return F.element_at(F.array(F.lit("cleanup"), F.lit("significance"), F.lit("refinement")), (i % 3 + 1).cast("int"))


def _low(h: Column, v: Column, d: Column) -> Column:
    return (
        F.when(h == 2, 8)
        .when(h == 1, F.when(v >= 1, 7).when(d >= 1, 6).otherwise(5))
        .otherwise(F.when(v == 2, 4).when(v == 1, 3).otherwise(F.least(d, F.lit(2))))
    )


def _diagonal(h: Column, v: Column, d: Column) -> Column:
    s = h + v
    return F.when(d >= 3, 8).when(d == 2, F.when(s >= 1, 7).otherwise(6)).when(d == 1, 3 + F.least(s, F.lit(2))).otherwise(F.least(s, F.lit(2)))


def zero_context(band: Column, h: Column, v: Column, d: Column) -> Column:
    """Label 0 to 8 from the numbers of significant horizontal, vertical and diagonal neighbours."""
    return F.when(band == "HH", _diagonal(h, v, d)).when(band == "HL", _low(v, h, d)).otherwise(_low(h, v, d)).cast("int")


def sign_context(h: Column, v: Column) -> tuple[Column, Column]:
    """Label and flip from sums of neighbour signs."""
    h, v = (F.greatest(F.lit(-1), F.least(F.lit(1), x)) for x in (h, v))
    key = (h + 1) * 3 + v + 1
    order = sorted(SIGN_CONTEXTS)
    pick = lambda k: F.element_at(F.array(*[F.lit(SIGN_CONTEXTS[o][k]) for o in order]), (key + 1).cast("int"))
    return pick(0), pick(1)


def refinement_context(refined: Column, neighbours: Column) -> Column:
    return F.when(refined, 16).otherwise(14 + F.least(neighbours, F.lit(1)))


def is_raw_pass(i: Column, bypass: Column) -> Column:
    return bypass & (i >= 10) & (i % 3 != 0)


def pass_capacity(i: Column) -> Column:
    """Passes that a segment holds which begins at pass i, in bypass style."""
    return F.when(i < 10, 10 - i).when((i - 10) % 3 == 0, 2).otherwise(1).cast("int")


def dense_backend(width: Column, coefficients: Column, size: Column, reversible: Column) -> Column:
    fits = F.when(reversible, coefficients <= size * 32).otherwise(coefficients * 2 <= size * 5)
    return F.when((width <= 64) & fits, "dense").otherwise("checked")


def style_names(style: Column) -> Column:
    """Names of the flags of a block style; null for bits that no style has."""
    names = ["bypass", "reset", "terminate", "causal", "predictable", "segmentation"]
    flags = [F.when(style.bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(names)]
    return F.when(style.bitwiseAND(F.lit(~0x3F)) == 0, F.concat_ws(",", *flags))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)

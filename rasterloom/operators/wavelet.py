"""Wavelet lifting: window functions for long lines, array expressions for planes that travel as one row.

A lifting stage changes the samples of one parity from their two neighbours; beyond an end the inner neighbour counts
twice, and a line of one sample stays as it is. Positions stay interleaved: even ones hold the low band.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the 9/7 transform: lifting weights and band scales.
ALPHA, BETA, GAMMA, DELTA = -1.5861343, -0.052980118, 0.8829111, 0.44350687
LOW_SCALE, HIGH_SCALE = 0.8128931, 1.2301741

Stage = tuple[int, Callable[[Column, Column], Column]]

FORWARD_53: list[Stage] = [(1, lambda v, s: v - F.shiftright(s, 1)), (0, lambda v, s: v + F.shiftright(s + 2, 2))]
INVERSE_53: list[Stage] = [(0, lambda v, s: v - F.shiftright(s + 2, 2)), (1, lambda v, s: v + F.shiftright(s, 1))]
FORWARD_97: list[Stage] = [(p, lambda v, s, w=w: v + F.lit(w) * s) for p, w in ((1, ALPHA), (0, BETA), (1, GAMMA), (0, DELTA))]
INVERSE_97: list[Stage] = [(p, lambda v, s, w=w: v - F.lit(w) * s) for p, w in ((0, DELTA), (1, GAMMA), (0, BETA), (1, ALPHA))]


def lift_lines(lines: DataFrame, line: list[str], at: str, stages: list[Stage], v: str = "v") -> DataFrame:
    """Lift a table of samples (line..., at, v). All stages share one shuffle and one sort by line and position."""
    w = Window.partitionBy(*line).orderBy(at)
    for parity, change in stages:
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        lines = lines.withColumn("_s", F.coalesce(before, after) + F.coalesce(after, before))
        lines = lines.withColumn(v, F.when((F.col(at) % 2 == parity) & F.col("_s").isNotNull(), change(F.col(v), F.col("_s"))).otherwise(F.col(v)))
    return lines.drop("_s")


def scale_bands(v: Column, i: Column, inverse: bool = False) -> Column:
    low, high = F.lit(LOW_SCALE), F.lit(HIGH_SCALE)
    if inverse:
        return F.when(i % 2 == 0, v / low).otherwise(v / high)
    return F.when(i % 2 == 0, v * low).otherwise(v * high)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stage(row: Column, parity: int, change: Callable[[Column, Column], Column]) -> Column:
    def step(v: Column, i: Column) -> Column:
        before, after = F.get(row, i - 1), F.get(row, i + 1)
        s = F.coalesce(before, after) + F.coalesce(after, before)
        return F.when((i % 2 == parity) & s.isNotNull(), change(v, s)).otherwise(v)

    return F.transform(row, step)


def _bound_stage(value: Column, stage: Callable, parity: int, change: Callable[[Column, Column], Column]) -> Column:
    return bound(value, lambda v: stage(v, parity, change))


def lift_row(row: Column, stages: list[Stage]) -> Column:
    """Lift an array."""
    for parity, change in stages:
        row = _bound_stage(row, _stage, parity, change)
    return row


def lift_rows(plane: Column, stages: list[Stage]) -> Column:
    return F.transform(plane, lambda row: lift_row(row, stages))


def _column_stage(plane: Column, parity: int, change: Callable[[Column, Column], Column]) -> Column:
    def step(row: Column, y: Column) -> Column:
        above, below = F.get(plane, y - 1), F.get(plane, y + 1)
        s = F.zip_with(F.coalesce(above, below), F.coalesce(below, above), lambda a, b: a + b)
        return F.when((y % 2 == parity) & s.isNotNull(), F.zip_with(row, s, lambda v, t: change(v, t))).otherwise(row)

    return F.transform(plane, step)


def lift_columns(plane: Column, stages: list[Stage]) -> Column:
    """Lift down the columns: whole rows are added to their neighbours."""
    for parity, change in stages:
        plane = _bound_stage(plane, _column_stage, parity, change)
    return plane


def analyse_planes(planes: DataFrame, stages: list[Stage] = FORWARD_53) -> DataFrame:
    """Columns first, then rows."""
    return planes.withColumn("plane", lift_rows(lift_columns(F.col("plane"), stages), stages))


def synthesise_planes(planes: DataFrame, stages: list[Stage] = INVERSE_53) -> DataFrame:
    """Rows first, then columns."""
    return planes.withColumn("plane", lift_columns(lift_rows(F.col("plane"), stages), stages))


def low_low(plane: Column) -> Column:
    """The quarter of even rows and columns."""
    rows = F.filter(plane, lambda _, y: y % 2 == 0)
    return F.transform(rows, lambda row: F.filter(row, lambda _, x: x % 2 == 0))


def band_name(y: Column, x: Column) -> Column:
    return F.concat(F.when(x % 2 == 0, "L").otherwise("H"), F.when(y % 2 == 0, "L").otherwise("H"))

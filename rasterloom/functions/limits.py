"""Admission of work before any of it is done, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.samples import ceil_div

#: Samples that a decoder gives by default, the default budgets of an encoder, and its terms by block,
#: by unit of the larger axis and by worker.
DECODE_SAMPLES = 256 << 20
WORKING_BYTES, OUTPUT_BYTES = 4 << 30, 1 << 30
BLOCK_BYTES, AXIS_BYTES, WORKER_BYTES = 4096, 12, 4 << 20


def output_samples(width: Column, height: Column, sampling: Column, discard: Column) -> Column:
    """Samples that a request gives: the sum over the selected components, given as an array of their (dx, dy)."""
    two = F.pow(F.lit(2), discard).cast("long")
    size = lambda s: ceil_div(width, s["dx"] * two) * ceil_div(height, s["dy"] * two)
    return F.aggregate(F.transform(sampling, size), F.lit(0).cast("long"), lambda a, n: a + n)


def decode_status(samples: Column, most: Column | int = DECODE_SAMPLES) -> Column:
    most = most if isinstance(most, Column) else F.lit(most)
    return F.when(most <= 0, "invalid limit").when(samples > most, "limit exceeded").otherwise("ok")


def encode_blocks(width: Column, height: Column, components: Column, levels: int = 2, edge: int = 64) -> Column:
    """Code blocks of all bands of all components."""
    total, w, h = F.lit(0).cast("long"), width, height
    grid: Callable[[Column, Column], Column] = lambda a, b: ceil_div(a, edge) * ceil_div(b, edge)
    for _ in range(levels):
        low_w, low_h = ceil_div(w, 2), ceil_div(h, 2)
        total = total + grid(w - low_w, low_h) + grid(low_w, h - low_h) + grid(w - low_w, h - low_h)
        w, h = low_w, low_h
    return (total + grid(w, h)) * components


def shared_bytes(width: Column, height: Column, components: Column, blocks: Column, output: int = OUTPUT_BYTES) -> Column:
    """What an encoder holds besides its workers."""
    return 4 * width * height * components + BLOCK_BYTES * blocks + AXIS_BYTES * F.greatest(width, height) + 2 * output


def workers(shared: Column, blocks: Column, pool: int, budget: int = WORKING_BYTES) -> Column:
    """Workers that the budget admits; 0 if not even one."""
    fit = F.floor((F.lit(budget) - shared) / WORKER_BYTES).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(pool).cast("long"), blocks, fit))

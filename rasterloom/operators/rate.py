"""Rate control: the finest quantisation of a transformed plane whose coded size fits a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.operators.blocks import TOGETHER, encode_many

#: Range of the coarseness, looks at candidates, bound of a quantised magnitude.
FINEST, COARSEST, VISITS, LARGEST = 4096, 65535, 17, 1 << 17


def step_of(coarseness: int, precision: int) -> float:
    """Steps double every 2048; in between they grow linearly. A band's gain cancels out of its step."""
    octave, mantissa = divmod(coarseness, 2048)
    return (1 + mantissa / 2048) * 2.0 ** (precision - 31 + octave)


def coded_sizes(planes: np.ndarray, coarseness: np.ndarray, precision: int) -> np.ndarray:
    """Bytes of each plane's block at its coarseness; -1 where a magnitude is beyond the coder's range."""
    steps = np.array([step_of(c, precision) for c in coarseness.tolist()])
    size = np.floor(np.abs(planes) / steps[:, None, None])
    fits = size.reshape(len(planes), -1).max(axis=1, initial=0) < LARGEST
    out = np.full(len(planes), -1, np.int64)
    _, data = encode_many((np.sign(planes[fits]) * size[fits]).astype(np.int64))
    out[fits] = [len(d) for d in data]
    return out


def search(sizes_of: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coarseness, size and number of looks of n searches that go on in step; sizes_of(rows, coarseness) tells sizes, or -1.

    Of the candidates within the budget the largest is kept, the first of equals. The coarsest comes first; if even that is
    too large it is the answer, and the caller sees so from its size.
    """
    pick, looks = np.full(n, COARSEST), np.ones(n, np.int64)
    most = sizes_of(np.arange(n), pick) if n else np.zeros(0, np.int64)
    bounds = np.tile(np.array([FINEST, COARSEST]), (n, 1))
    open_rows = np.flatnonzero((most >= 0) & (most <= budget))
    for _ in range(VISITS - 1):
        open_rows = open_rows[bounds[open_rows, 0] <= bounds[open_rows, 1]]
        if not len(open_rows):
            break
        candidate = bounds[open_rows].sum(axis=1) // 2
        size = sizes_of(open_rows, candidate)
        looks[open_rows] += 1
        within = (size >= 0) & (size <= budget)
        bounds[open_rows, within.astype(int)] = np.where(within, candidate - 1, candidate + 1)
        better = within & (size > most[open_rows])
        pick[open_rows[better]], most[open_rows[better]] = candidate[better], size[better]
    return pick, np.maximum(most, 0), looks


def undershoot_allowed(budget: int) -> int:
    return max(32, -(-budget // 500))


def search_planes(planes: DataFrame, key: str, plane: str, budget: int, precision: int = 8) -> DataFrame:
    """(key, coarseness, size, looks, success) of transformed planes, one search a row; those of a batch go on in step."""
    kind = planes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            picked = np.zeros((batch.num_rows, 3), np.int64)
            shapes: dict[tuple[int, int], list[int]] = {}
            for i, v in enumerate(values):
                shapes.setdefault((len(v), len(v[0])), []).append(i)
            for (h, w), rows in shapes.items():
                for at in range(0, len(rows), step := max(1, TOGETHER // (h * w))):
                    some = rows[at : at + step]
                    held = np.array([values[i] for i in some], float)
                    picked[some] = np.stack(search(lambda r, c, held=held: coded_sizes(held[r], c, precision), len(some), budget), axis=1)
            ok = (picked[:, 1] <= budget) & (budget - picked[:, 1] <= undershoot_allowed(budget))
            cols = [pa.array(picked[:, i], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(ok)], [key, "coarseness", "size", "looks", "success"])

    return planes.select(key, plane).mapInArrow(run, f"{key} {kind}, coarseness int, size int, looks int, success boolean")

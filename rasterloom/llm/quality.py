"""Quality classifier over document statistics.

Each whole text is reduced to a few dozen statistics (lengths, character classes, repeated words and lines). Random
Fourier features of the standardised statistics approximate a Gaussian kernel; their normal equations are summed
by partition and solved for ridge scores, which isotonic regression turns into probabilities of label 1.

Statistics are computed once for every document and written as a narrow table; labels meet that table, never the texts.
The normal equations are summed as integers (fixed point), so their sum does not depend on the order of partitions. What
reaches the driver is one matrix of FEATURES + 1 rows and one histogram of BINS scores, whatever the input's size.

Null texts count as empty; empty texts get the statistics 0 and a score. Labels that are null, or neither 0 nor 1, are
not learned; where a document has several labels the largest counts. Without labels of both kinds all scores are the
share of label 1 (0.5 if there are none). Repeated rows get equal rows. Empty tables give an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.storage import crc_mod, stage, text_batches
from rasterloom.llm.words import SPACES, Words, buffers, chunks

FEATURES, RIDGE, BINS, SEED = 192, 1e-3, 1000, 11
#: Width of the Gaussian kernel, in standard deviations of a statistic times the root of their number.
WIDTH = 1.0
FIXED = float(1 << 30)
THRESHOLD = 0.3

_CLASSES = ["lower", "upper", "digit", "space", "newline", "period", "bar", "bang", "symbol", "bracket", "other", "wide"]
STATISTICS = ["log_bytes", "log_words", "log_lines", *_CLASSES, "word_bytes", "line_bytes", "short_words", "long_words", "new_words", "top_word", "new_lines", "new_pairs"]

_CLASS_OF = np.full(256, 10, np.uint8)
_CLASS_OF[97:123], _CLASS_OF[65:91], _CLASS_OF[48:58] = 0, 1, 2
for _i, _chars in ((3, b" \t\r\v\f"), (4, b"\n"), (5, b".,;:?'\""), (6, b"|"), (7, b"!"), (8, b"*#$%&@=+~^_\\/<>"), (9, b"()[]{}")):
    _CLASS_OF[list(_chars)] = _i
_CLASS_OF[128:] = 11
_LINES = np.zeros(256, bool)
_LINES[10] = True


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row the number of distinct hashes and the most frequent one's count."""
    n = len(first) - 1
    kinds, most = np.zeros(n), np.zeros(n)
    for r in range(n):
        a, b = first[r], first[r + 1]
        if a < b:
            s = np.sort(hashes[a:b])
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            kinds[r], most[r] = len(edge) - 1, np.diff(edge).max()
    return kinds, most


def statistics_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    rows, size = len(offs) - 1, np.diff(offs)
    row = np.repeat(np.arange(rows), size)
    classes = np.bincount(row * 12 + _CLASS_OF[buf], minlength=rows * 12).reshape(rows, 12)
    w, lines = Words(buf, offs, SPACES), Words(buf, offs, _LINES)
    words, n_lines = np.diff(w.first), np.diff(lines.first)
    per = lambda x, n: x / np.maximum(1, n)
    h = w.hashes()
    kinds, most = _distinct(h, w.first)
    pairs = h[:-1] * np.uint64(3) + h[1:] if len(h) > 1 else h[:0]
    # The pair that begins with a row's last word would cross rows.
    fresh_pairs = np.zeros(rows)
    for r in range(rows):
        a, b = int(w.first[r]), int(w.first[r + 1]) - 1
        fresh_pairs[r] = len(np.unique(pairs[a:b])) / (b - a) if b > a else 1.0
    line_kinds, _ = _distinct(lines.hashes(), lines.first)
    length = w.ends - w.starts
    some = lambda flag: np.bincount(w.row[flag], minlength=rows)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            np.log1p(n_lines),
            per(classes, size[:, None]),
            per(np.bincount(w.row, length, minlength=rows), words),
            np.log1p(per(size, n_lines)),
            per(some(length <= 3), words),
            per(some(length >= 12), words),
            per(kinds, words),
            per(most, words),
            per(line_kinds, n_lines),
            fresh_pairs,
        ]
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = buffers(batch.column(1))
        for i, j in chunks(offs):
            x = statistics_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel(), pa.float64()))], ["doc_id", "x"]
            )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of STATISTICS of the whole text."""
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stats, "doc_id long, x array<double>")


def _table(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


class Fourier:
    """sqrt(2 / D) * cos(W x + b) of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.deviation = mean, deviation
        self.w = rng.standard_normal((len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def _normal_equations(fourier: Fourier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                z = fourier(_table(part.column(0), len(STATISTICS)))
                total += z.T @ np.column_stack([z, part.column(1).to_numpy(zero_copy_only=False)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(np.rint(total.ravel()[at] * FIXED).astype(np.int64))], ["at", "value"]
        )

    return run


def isotonic(scores: np.ndarray, weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing values closest to means, which are in order of score."""
    blocks: list[list[float]] = []
    for w, m in zip(weights.tolist(), means.tolist(), strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, n2 = blocks.pop()
            m1, w1, n1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


class Model:
    def __init__(self, share: float, fourier: Fourier | None = None, beta=None, knots=None, values=None):
        self.share, self.fourier, self.beta, self.knots, self.values = share, fourier, beta, knots, values

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.beta, 0.0, 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.share)
        raw = self.ridge(x)
        # A trace of the ridge score keeps the order within a calibrated step.
        return np.clip(np.round(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * raw, 9), 0, 1)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats (doc_id, x) and labels (doc_id, y): four fifths of the labelled rows fit the ridge, the rest calibrate it."""
    rows = stats.join(labels, "doc_id").select("x", F.col("y").cast("double").alias("y"), (crc_mod("doc_id", 25) >= 20).alias("calibrate"))
    rows = stage(rows, "labelled")
    width = len(STATISTICS)
    moments = [F.round(f(F.col("x")[i]), 9).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"), *moments).first()
    if not top["n"] or top["share"] in (0.0, 1.0):
        return Model(0.5 if top["share"] is None else float(top["share"]))
    mean = np.array([top[f"m{i}"] for i in range(width)])
    deviation = np.maximum(np.array([top[f"d{i}"] for i in range(width)]), 1e-6)
    fourier = Fourier(mean, deviation)
    parts = rows.where(~F.col("calibrate")).select("x", "y").mapInArrow(_normal_equations(fourier), "at long, value long")
    sums = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    flat = np.zeros((FEATURES + 1) * (FEATURES + 2))
    for at, value in sums:
        flat[at] = float(value) / FIXED
    flat = flat.reshape(FEATURES + 1, FEATURES + 2)
    gram, right = flat[:, :-1], flat[:, -1]
    beta = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) / FEATURES * np.eye(FEATURES + 1), right)
    model = Model(float(top["share"]), fourier, beta)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((BINS + 1, 2), np.int64)
        for batch in batches:
            at = np.rint(model.ridge(_table(batch.column(0), width)) * BINS).astype(np.int64)
            np.add.at(seen, (at, 0), 1)
            np.add.at(seen, (at, 1), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        some = np.flatnonzero(seen[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some, 0]), pa.array(seen[some, 1])], ["bin", "n", "ones"])

    held = rows.where("calibrate").select("x", "y").mapInArrow(binned, "bin long, n long, ones long")
    hist = sorted(tuple(r) for r in held.groupBy("bin").agg(F.sum("n"), F.sum("ones")).collect())
    if hist:
        at, n, ones = (np.array(c, float) for c in zip(*hist, strict=True))
        model.knots, model.values = at / BINS, isotonic(at, n, ones / n)
    else:
        model.knots = model.values = np.array([0.0, 1.0])
    return model


def clean_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    ok = labels.where(f"doc_id IS NOT NULL AND {column} IN (0, 1)")
    return ok.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).alias("y"))


def score(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                s = model.score(_table(part.column(1), len(STATISTICS)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")

"""Benchmark decontamination by broadcast hash sets of normalised test n-grams.

Benchmark texts are cut into windows of n words (a shorter item is one window of all its words); the windows' hashes are
sent to every task, which scans the windows of each whole training text, looks them up, and verifies every hit against
the window's words before it counts. A benchmark of up to BLOCK_WINDOWS windows is sent with its words, and hits are
verified on the spot. Of a larger one only a bitmap of the hashes is sent, whose size is fixed; what it lets through is
joined with the table of benchmark windows on hash and words, and so verified there. Either way documents are scanned
once, the driver holds at most BLOCK_WINDOWS windows, and the rows are the same.

Words are runs of bytes that are digits, a-z (after lower-casing A-Z) or not ASCII. Null and empty texts have no words
and no hits; very long texts are scanned whole. Items with equal texts, or with equal ids, are all reported, an id once.
Null item ids are ignored. Every row of the documents gets its row, whether ids repeat or are null. Empty tables give no
rows, or rows without hits. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.storage import drop_ids, id_bitmap, stage, text_batches
from rasterloom.llm.words import LOWER, NON_ALNUM, Words, buffers, chunks, windows

N = 8
#: Windows that are sent with their words: up to 600 bytes each in a Python worker, 60 MB in all.
BLOCK_WINDOWS = 100_000
#: Size of the bitmap of the hashes of more windows, as a power of two of bits.
FILTER_BITS = 27

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"


class NgramSet:
    """Sorted window hashes by window length, with the items and the bytes of each window."""

    def __init__(self, items: list[tuple[str, str]], n: int = N):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item, text in items:
            buf, offs = buffers(pa.array([text or ""], pa.string()))
            buf = LOWER[buf]
            w = Words(buf, offs, NON_ALNUM)
            k = min(n, len(w.starts))
            if not k:
                continue
            hashes = windows(w.hashes(), k)
            for i, h in enumerate(hashes.tolist()):
                key = b" ".join(buf[w.starts[i + j] : w.ends[i + j]].tobytes() for j in range(k))
                found[k][h][key].add(item)
        self.by_length = {
            k: (np.array(sorted(t), np.uint64), {h: {key: sorted(v) for key, v in at.items()} for h, at in t.items()})
            for k, t in found.items()
        }

    def hits(self, w: Words, buf: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of each verified window; words are numbered over all rows of w."""
        for k, (sorted_hashes, table) in self.by_length.items():
            own = windows(hashes, k)
            if not len(own):
                continue
            at = np.searchsorted(sorted_hashes, own)
            at[at == len(sorted_hashes)] = 0
            same_row = w.row[: len(own)] == w.row[k - 1 :]
            for i in np.flatnonzero((sorted_hashes[at] == own) & same_row).tolist():
                key = b" ".join(buf[w.starts[i + j] : w.ends[i + j]].tobytes() for j in range(k))
                items = table[int(own[i])].get(key)
                if items:
                    yield i, k, items


def _scan(sent, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams: NgramSet = sent.value
        for batch in batches:
            ids = batch.column(0)
            buf_all, offs_all = buffers(batch.column(1))
            for i, j in chunks(offs_all):
                offs = offs_all[i : j + 1] - offs_all[i]
                buf = LOWER[buf_all[offs_all[i] : offs_all[j]]]
                w = Words(buf, offs, NON_ALNUM)
                delta = np.zeros(len(w.starts) + 1, np.int64)
                items: dict[int, set[str]] = defaultdict(set)
                for first, k, found in ngrams.hits(w, buf, w.hashes()):
                    delta[first] += 1
                    delta[first + k] -= 1
                    items[int(w.row[first])].update(found)
                covered = np.cumsum(delta[:-1]) > 0
                edges = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                per_row = np.add.reduceat(np.append(covered, False), w.first[:-1]) if len(covered) else np.zeros(j - i, int)
                per_row = np.where(np.diff(w.first) > 0, per_row, 0)
                spans: dict[int, list[dict]] = defaultdict(list)
                for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
                    while s < e:  # covered words of neighbouring rows may touch
                        row = int(w.row[s])
                        stop = min(e, int(w.first[row + 1]))
                        spans[row].append({"start": s - int(w.first[row]), "end": stop - int(w.first[row])})
                        s = stop
                rows = range(j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array(per_row, pa.int64()),
                        pa.array([len(items[r]) if r in items else 0 for r in rows], pa.int64()),
                        pa.array([sorted(items[r]) if r in items else [] for r in rows], pa.list_(pa.string())),
                        pa.array([spans.get(r, []) for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"],
                )

    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted), spans (of words, end exclusive)."""
    spark = docs.sparkSession
    text_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    # No text has more windows than half its bytes, or more than one if it is shorter.
    most = items.agg(F.sum(F.greatest(F.lit(1), F.floor(F.octet_length("text") / 2)))).first()[0] or 0
    if most <= BLOCK_WINDOWS:
        sent = spark.sparkContext.broadcast(NgramSet([tuple(r) for r in items.collect()], n))
        return source.mapInArrow(_scan(sent, n), SCHEMA)
    return _by_join(source, items, n)


_WINDOW = "k int, h long, key binary"


def _benchmark_windows(n: int):
    """(item, k, h, key): length, hash and words of each window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, table in NgramSet([(item, text)], n).by_length.items():
                    rows = [(h, key) for h, keys in table[1].items() for key in keys]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item] * len(rows), pa.string()),
                            pa.array([k] * len(rows), pa.int32()),
                            pa.array(np.array([h for h, _ in rows], np.uint64).view(np.int64)),
                            pa.array([key for _, key in rows], pa.binary()),
                        ],
                        ["item", "k", "h", "key"],
                    )

    return run


def _candidates(sent, lengths: list[int]):
    """doc_id, n_words, and the windows (first, k, h, key) of each row whose hashes the bitmap may hold."""
    kinds = pa.struct([("first", pa.int32()), ("k", pa.int32()), ("h", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            buf_all, offs_all = buffers(batch.column(1))
            for i, j in chunks(offs_all):
                offs = offs_all[i : j + 1] - offs_all[i]
                buf = LOWER[buf_all[offs_all[i] : offs_all[j]]]
                w = Words(buf, offs, NON_ALNUM)
                hashes, found = w.hashes(), [[] for _ in range(j - i)]
                for k in lengths:
                    own = windows(hashes, k)
                    at = (own & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    same_row = w.row[: len(own)] == w.row[k - 1 :] if len(own) else np.zeros(0, bool)
                    for x in np.flatnonzero(((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & same_row).tolist():
                        key = b" ".join(buf[w.starts[x + y] : w.ends[x + y]].tobytes() for y in range(k))
                        row = int(w.row[x])
                        found[row].append({"first": x - int(w.first[row]), "k": k, "h": int(own[x : x + 1].view(np.int64)[0]), "key": key})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(w.first), pa.int64()), pa.array(found, pa.list_(kinds))], ["doc_id", "n_words", "found"]
                )

    return run


def _by_join(source: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """find_hits for a benchmark of any size: candidates and benchmark windows meet by hash and words."""
    spark = source.sparkSession
    table = stage(items.mapInArrow(_benchmark_windows(n), f"item string, {_WINDOW}").distinct(), "benchmark-windows")
    lengths = sorted(r[0] for r in table.select("k").distinct().collect())  # at most n
    sent = spark.sparkContext.broadcast(id_bitmap(table.select("h").distinct(), "h", FILTER_BITS, hashed=True))
    # The number of a row is fixed once the table is written.
    found = source.mapInArrow(_candidates(sent, lengths), "doc_id long, n_words long, found array<struct<first:int,k:int,h:long,key:binary>>")
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    hits = found.select("row", F.inline("found")).join(table, ["k", "h", "key"]).select("row", "item", F.col("first").alias("s"), (F.col("first") + F.col("k")).alias("e"))
    hits = stage(hits, "hits")
    by_place = Window.partitionBy("row").orderBy("s", "e")
    seen = F.max("e").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("row", "s", "e").distinct().withColumn("opens", F.when(F.col("s") <= seen, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    spans = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    names = hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.select("row", "doc_id", "n_words").join(spans.join(names, "row"), "row", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), none).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def contaminated(min_items: int = 2):
    return F.col("n_items") >= min_items


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = 2) -> DataFrame:
    """docs without the rows that hold windows of min_items items or more; columns as they came."""
    return drop_ids(docs, find_hits(docs, benchmark, n).where(contaminated(min_items)).select("doc_id"), "doc_id")


def digest_items(items):
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(texts: dict, items: dict, n: int = N) -> dict:
    """For tests: by document (words, hit words, items), from plain Python."""
    import re

    def words(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    grams = {}
    for item, text in items.items():
        w = words(text)
        k = min(n, len(w))
        grams[item] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    out = {}
    for doc, text in texts.items():
        w, hit, found = words(text), set(), set()
        for item, at in grams.items():
            for g in at:
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit.update(range(i, i + len(g)))
                        found.add(str(item))
        ids = sorted(found)
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
    return out

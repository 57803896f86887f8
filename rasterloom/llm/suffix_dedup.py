"""Removal of repeated 200-byte strings by a distributed difference-cover suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts somewhere else, in any document. The sort is never run
over the whole corpus at once; it is distributed by a sample of positions of which every string of LENGTH bytes owns
exactly one:

1. Cover. A string's sample is the leftmost minimum of the hashes of its 50-byte pieces. Equal strings own samples at
   equal offsets, so the samples form a difference cover, and strings can only be equal if their samples' pieces are.
   The starts that own a sample form a range; it gets the name of its sample and the name of the bytes that its strings
   span (all names are 64-bit hashes).
2. Names. Samples that occur once end here. Where the spanned bytes occur twice, all of the range's strings are repeated.
3. Merge. What is left are ranges whose sample repeats while their surroundings differ: the edges of repeated passages.
   Their bytes meet by sample name, and are suffix-sorted in memory by the difference cover algorithm modulo 3 (sort the
   triples at two thirds of the positions, recurse on their names, merge the rest).
4. Strings that are neighbours in suffix order and agree in LENGTH bytes, compared byte by byte, are repeated.

Equal texts are found by digest first: all their bytes go, and one text stands for them against the others. A sample that
more than GROUP ranges own (the edge of a passage that countless documents share) is not sorted in one task: its ranges
are cut into runs of RUN neighbouring offsets from the sample, and a run meets only those that agree in all the bytes that
its strings have in common. Of equal runs one is kept, and what is still crowded is counted string by string, by name, in
a partially combined aggregation.

Texts are UTF-8 bytes; null counts as empty. Texts of fewer than LENGTH bytes lose nothing. Repeated rows are copies of
each other. Empty tables give an empty result. Other columns are not looked at. Very long texts are handled in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.storage import id_bitmap, stage, text_batches
from rasterloom.llm.words import _BASE, _BYTE, _INVERSE, buffers, chunks, mix, powers

LENGTH, PIECE = 200, 50
#: Piece positions within a string.
SPAN = LENGTH - PIECE + 1
#: Bytes of a long text that are handled at once.
STRETCH = 1 << 22
#: Ranges of one sample that are sorted in one task, and bytes of one suffix sort.
GROUP, BLOCK = 512, 1 << 18
#: Offsets of a run, and the different runs with equal common bytes that are sorted in one task.
RUN, RUNS = 38, 4096
FILTER_BITS = 24


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by the difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    _, names = np.unique(s, return_inverse=True)
    names = names.astype(np.int64) + 1  # 0 stands for the end
    t = np.concatenate([names, np.zeros(3 + (n % 3 == 1), np.int64)])
    top = np.int64(names.max() + 1)
    at = np.arange(n + (n % 3 == 1))  # one more sample at the end keeps both residues apart
    sample = np.concatenate([at[at % 3 == 1], at[at % 3 == 2]])
    pair = t[:-1] * top + t[1:]
    if top > 1 << 20:
        _, pair = np.unique(pair, return_inverse=True)
    wide = np.int64(pair.max() + 1)
    triple = pair[sample] * top + t[sample + 2] if wide * top < 1 << 62 else None
    order = np.argsort(triple, kind="stable")
    sorted_triples = triple[order]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(np.concatenate([[1], sorted_triples[1:] != sorted_triples[:-1]]))
    if name.max() < len(sample):
        inner = suffix_array(name)
        name[inner] = np.arange(1, len(sample) + 1)
    rank = np.zeros(len(t) + 1, np.int64)
    rank[sample] = name
    zero = at[(at % 3 == 0) & (at < n)]
    big = np.int64(len(sample) + 2)
    zero = zero[np.argsort(t[zero] * big + rank[zero + 1], kind="stable")]
    one = sample[np.argsort(name)]
    two = one[one % 3 == 2]
    one = one[one % 3 == 1]
    # The merge: a suffix's place is the number of suffixes of each kind before it.
    key1 = lambda i: t[i] * big + rank[i + 1]
    key2 = lambda i: pair[i] * big + rank[i + 2]
    place_zero = np.arange(len(zero)) + np.searchsorted(key1(one), key1(zero)) + np.searchsorted(key2(two), key2(zero))
    sa = np.full(len(zero) + len(sample), -1, np.int64)
    sa[place_zero] = zero
    rest = np.concatenate([one, two])
    sa[np.flatnonzero(sa < 0)] = rest[np.argsort(rank[rest])]
    return sa[sa < n]


def repeated_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the starts (positions with LENGTH bytes after them) begin equal strings of LENGTH bytes."""
    order = suffix_array(data)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = np.zeros(len(order), bool)
    for i in range(0, len(order) - 1, 1 << 15):
        a, b = order[i : i + (1 << 15)], order[i + 1 : i + 1 + (1 << 15)]
        equal = (view[a[: len(b)]] == view[b]).all(axis=1)
        same[i : i + len(b)] |= equal
        same[i + 1 : i + 1 + len(b)] |= equal
    found = np.zeros(len(data), bool)
    found[order[same]] = True
    return found[starts]


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=total[1:])
    return total, powers(_INVERSE, len(buf) + 1)


def ranges(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first start, last start, gap to the sample, its name and that of the spanned bytes of each range of starts.

    The strings of row r start at first[r] .. last[r] of buf.
    """
    total, back = _sums(buf)
    m = len(buf) - PIECE + 1
    h = mix((total[PIECE:] - total[:m]) * back[:m])
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // SPAN)
    padded = np.full(blocks * SPAN, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = packed
    grid = padded.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    w = m - SPAN + 1
    owner = (np.minimum(behind[:w], ahead[SPAN - 1 : SPAN - 1 + w]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(w + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= (owner[1:] != owner[:-1]) | ~inside[:-1]
    opens[first] = True
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes)
    at = owner[lo]
    size = (hi - lo + LENGTH).astype(np.uint64)
    spanned = (total[hi + LENGTH] - total[lo]) * back[lo]
    spanned = mix(mix(spanned + size) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = np.searchsorted(first, lo, "right") - 1
    return row, lo, hi, at - lo, mix(h[at]), spanned


def text_name(text: bytes | memoryview) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, name, bytes, and the ranges of the first row of the partition with that text."""
    seen: set[int] = set()
    empty = np.zeros(0, np.int64)
    for batch in batches:
        buf_all, offs_all = buffers(batch.column(1))
        for i, j in chunks(offs_all):
            buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
            view = memoryview(np.ascontiguousarray(buf))
            names = [text_name(view[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            fresh = []
            for r, name in enumerate(names):
                if offs[r + 1] - offs[r] >= LENGTH and name not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    fresh.append(r)
            parts = []
            if j - i == 1 and len(buf) > STRETCH and fresh:
                for x in range(0, len(buf) - LENGTH + 1, STRETCH):
                    piece = buf[x : x + STRETCH + LENGTH - 1]
                    _, lo, hi, gap, name, spanned = ranges(piece, np.array([0]), np.array([len(piece) - LENGTH]))
                    parts.append((np.zeros(len(lo), np.int64), lo + x, hi + x, gap, name, spanned))
            elif fresh:
                rows = np.array(fresh)
                row, lo, hi, gap, name, spanned = ranges(buf, offs[rows], offs[rows + 1] - LENGTH)
                row = rows[row]
                parts.append((row, lo - offs[row], hi - offs[row], gap, name, spanned))
            row, lo, hi, gap, name, spanned = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (empty,) * 6
            ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
            item = pa.StructArray.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(spanned.view(np.int64)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(gap, pa.int32())],
                ["sample", "spanned", "lo", "hi", "gap"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(names, pa.int64()),
                    pa.array(np.diff(offs), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), item),
                ],
                ["doc_id", "name", "n_bytes", "ranges"],
            )


def _listed(bitmap: np.ndarray, name: int) -> bool:
    at = name & ((1 << FILTER_BITS) - 1)
    return bool(bitmap[at >> 3] >> (at & 7) & 1)


def _texts_in(sent):
    """name and data of texts whose name is in the bitmap, each once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            rows, names = [], []
            for i, x in enumerate(batch.column(1)):
                name = text_name(x.as_buffer())
                if _listed(bitmap, name) and name not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    rows.append(i)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(1).take(pa.array(rows, pa.int64()))], ["name", "data"])

    return run


def _texts_with(sent):
    """doc_id, name, digest, and the data where the name is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            texts = [x.as_buffer() for x in batch.column(1)]
            names = [text_name(x) for x in texts]
            kept = [x.to_pybytes() if _listed(bitmap, n) else None for x, n in zip(texts, names, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(kept, pa.binary())],
                ["doc_id", "name", "digest", "data"],
            )

    return run


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, name, lo, data, run) of each wanted range: its bytes by sample or, if that is crowded, the bytes of each
    of its runs by the bytes that all strings of the run have in common, with the run's own name."""
    for batch in batches:
        out: list[tuple] = []
        for name, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            buf = np.frombuffer(data.as_buffer(), np.uint8)
            for w in wanted:
                lo, hi = w["lo"], w["hi"]
                part = buf[lo : hi + LENGTH]
                if not w["crowded"]:
                    out.append((w["sample"], name, lo, part.tobytes(), None))
                    continue
                total, back = _sums(part)
                offset = w["gap"] - np.arange(hi - lo + 1)
                run = offset // RUN
                first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                last = np.append(first[1:], len(run)) - 1
                run = run[first]
                core = w["gap"] - run * RUN
                shared = (total[core - RUN + 1 + LENGTH] - total[core]) * back[core]
                keys = mix(mix(shared + run.astype(np.uint64)) ^ np.uint64(w["sample"] & (1 << 64) - 1))
                own = mix(mix((total[last + LENGTH] - total[first]) * back[first] + (last - first).astype(np.uint64)) + offset[first].astype(np.uint64))
                for k, o, a, b in zip(keys.view(np.int64).tolist(), own.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
                    out.append((k, name, lo + a, part[a : b + LENGTH].tobytes(), o))
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["key", "name", "lo", "data", "run"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(string, name, lo) for every string of the rows (name, lo, data)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            out: list[tuple] = []
            for name, lo, data in zip(*(batch.column(k).slice(i, 1000) for k in range(3)), strict=True):
                part = np.frombuffer(data.as_buffer(), np.uint8)
                total, back = _sums(part)
                n = len(part) - LENGTH + 1
                own = mix((total[LENGTH:] - total[:n]) * back[:n]).view(np.int64).tolist()
                out.extend((h, name.as_py(), lo.as_py() + k) for k, h in enumerate(own))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["string", "name", "lo"])


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by sample; whole groups are put together into blocks, each sorted on its own."""
    names, los, datas, held, key = [], [], [], 0, None

    def close() -> pa.RecordBatch:
        # Every range ends in a symbol of its own, so that no string runs into the next range.
        sizes = np.array([len(d) for d in datas])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        data = np.full(int((sizes + 1).sum()), 0, np.int32)
        data[np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join(datas), np.uint8)
        data[begin + sizes] = 256 + np.arange(len(datas))
        count = sizes - LENGTH + 1
        starts = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated_starts(data, starts)
        which = np.repeat(np.arange(len(datas)), count)
        offset = starts - begin[which]
        edge = np.concatenate([[True], (which[1:] != which[:-1]), [True]])
        opens = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
        closes = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
        row = which[opens]
        low = np.array(los)[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(names, np.int64)[row]), pa.array(low + offset[opens], pa.int32()), pa.array(low + offset[closes], pa.int32())],
            ["name", "lo", "hi"],
        )

    for batch in batches:
        keys, own, low = (batch.column(k).to_pylist() for k in range(3))
        for i, data in enumerate(batch.column(3)):
            if held > BLOCK and keys[i] != key:
                yield close()
                names, los, datas, held = [], [], [], 0
            key = keys[i]
            names.append(own[i])
            los.append(low[i])
            datas.append(data.as_py())
            held += len(datas[-1])
    if datas:
        yield close()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, copies, digest, data, runs -> the operator's result."""
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        out: list[tuple] = []
        for doc, n, copies, digest, data, runs in zip(*(c if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns), strict=True):
            if copies > 1 and n >= LENGTH:
                out.append((doc, n, n, 1, nothing, [{"start": 0, "end": n}]))
            elif not runs:
                out.append((doc, n, 0, 0, digest, []))
            else:
                spans: list[list[int]] = []
                for r in sorted((r["lo"], r["hi"] + LENGTH) for r in runs):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append([*r])
                body, kept, at = memoryview(data.as_buffer()), hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(body[at:a])
                    at = b
                kept.update(body[at:])
                out.append((doc, n, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        )


def _repeated_ranges(source: DataFrame, named: DataFrame) -> DataFrame:
    """(name, lo, hi): ranges of starts of repeated strings, by text name."""
    spark = source.sparkSession
    rows = named.where("size(ranges) > 0").select("name", F.explode("ranges").alias("r")).select("name", "r.*")
    rows = rows.withColumn("own", F.xxhash64("name", "lo"))
    again = rows.groupBy("sample").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("sample")
    again = stage(again, "samples")
    rows = stage(rows.join(again, "sample"), "ranges")
    spans = rows.groupBy("sample", "spanned").agg(F.min("own").alias("a"), F.max("own").alias("b"))
    spans = stage(spans, "spans")
    rows = rows.join(spans, ["sample", "spanned"])
    whole = rows.where("a <> b").select("name", "lo", "hi")
    # Samples with a range that occurs once: one range of each kind is compared with the others.
    open_samples = spans.groupBy("sample").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("a") == F.col("b")).alias("single"))
    open_samples = stage(open_samples.where("kinds > 1 AND single > 0").select("sample", (F.col("kinds") > GROUP).alias("crowded")), "open")
    edges = rows.where("own = a").join(open_samples, "sample").select("name", "sample", "lo", "hi", "gap", "crowded")
    wanted = stage(edges.groupBy("name").agg(F.collect_set(F.struct("sample", "lo", "hi", "gap", "crowded")).alias("wanted")), "wanted")
    if wanted.isEmpty():
        return stage(whole.distinct(), "repeats")
    bitmap = spark.sparkContext.broadcast(id_bitmap(wanted, "name", FILTER_BITS, hashed=True))
    met = source.mapInArrow(_texts_in(bitmap), "name long, data binary").join(wanted, "name").select("name", "data", "wanted")
    around = met.mapInArrow(_surroundings, "key long, name long, lo int, data binary, run long")
    around = stage(around.dropDuplicates(["key", "name", "lo"]), "surroundings")
    cols = ["key", "name", "lo", "data"]
    whole = whole.distinct()
    if open_samples.where("crowded").isEmpty():
        return stage(whole.unionByName(_sorted(around.select(cols))), "repeats")
    runs = around.where("run IS NOT NULL").withColumn("own", F.xxhash64("name", "lo"))
    names = stage(runs.groupBy("key", "run").agg(F.min("own").alias("a"), F.max("own").alias("b")), "runs")
    met_runs = names.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("a") == F.col("b")).alias("single"))
    met_runs = stage(met_runs.where("kinds > 1 AND single > 0").select("key", (F.col("kinds") > RUNS).alias("many")), "run-keys")
    runs = stage(runs.join(names, ["key", "run"]).where("a <> b OR own = a"), "runs")
    last = F.col("lo") + F.octet_length("data") - LENGTH
    together = runs.where("a <> b").select("name", "lo", last.alias("hi"))
    left = stage(runs.where("own = a").join(met_runs, "key").select(*cols, "many"), "run-edges")
    edges = around.where("run IS NULL").select(cols).unionByName(left.where("NOT many").select(cols))
    found = whole.unionByName(together).unionByName(_sorted(edges))
    strings = left.where("many").select("name", "lo", "data").mapInArrow(_strings, "string long, name long, lo int")
    strings = stage(strings.withColumn("own", F.xxhash64("name", "lo")), "strings")
    again = strings.groupBy("string").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("string")
    counted = strings.join(stage(again, "strings"), "string").select("name", "lo", F.col("lo").alias("hi"))
    return stage(found.unionByName(counted), "repeats")


def _sorted(rows: DataFrame) -> DataFrame:
    """Repeated strings of rows (key, name, lo, data), within each key."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_blocks, "name long, lo int, hi int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges)."""
    spark = docs.sparkSession
    text_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("data"))
    schema = "doc_id long, name long, n_bytes long, ranges array<struct<sample:long,spanned:long,lo:int,hi:int,gap:int>>"
    named = stage(source.mapInArrow(_names, schema), "names")
    runs = _repeated_ranges(source, named)
    copies = stage(named.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes")), "copies")
    runs = runs.join(copies.where("copies = 1").select("name"), "name")
    runs = runs.groupBy("name").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    per_text = stage(copies.join(runs, "name", "left"), "runs")
    bitmap = spark.sparkContext.broadcast(id_bitmap(per_text.where("runs IS NOT NULL"), "name", FILTER_BITS, hashed=True))
    texts = source.mapInArrow(_texts_with(bitmap), "doc_id long, name long, digest string, data binary")
    met = texts.join(per_text, "name").select("doc_id", "n_bytes", "copies", "digest", "data", "runs")
    return met.mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    )


def brute_force(texts: dict) -> dict:
    """For tests: by document (bytes, removed, runs, digest of the rest)."""
    seen: dict[bytes, int] = {}
    raw = {k: (t or "").encode() for k, t in texts.items()}
    for t in raw.values():
        for p in range(len(t) - LENGTH + 1):
            s = t[p : p + LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = {}
    for k, t in raw.items():
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - LENGTH + 1):
            if seen[t[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out[k] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest())
    return out

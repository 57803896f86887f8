"""N-gram Jaccard join by signature trees.

A document is its set of distinct word 5-grams (64-bit hashes). Two documents link when their sets' Jaccard similarity
is 0.8 or more. Documents with equal sets are one node. The join has four steps.

1. Routing. The hash range is cut into segments and the n-grams of a segment form one key. Sets that link differ in few
   n-grams (a quarter of the smaller set at most), so they share a key among their first few in an order that both know
   (full segments first): the pigeonhole principle, without loss. Nodes that share no key with others are done. The
   n-grams of the rest are counted, and of each set those that are rarest among these nodes (a fifth and one) are kept,
   by the same principle. Nodes that share a rare n-gram, directly or over others, form a neighbourhood.
2. Signature trees. The nodes of a neighbourhood, ordered by size and smallest hash, are the leaves of a tree whose inner
   nodes hold the OR of the bitmaps below them and the range of sizes. A dual traversal from (root, root) drops pairs of
   tree nodes whose sizes are too far apart or whose bitmaps allow too small an overlap.
3. Exact check of the pairs of leaves that are left, unless links found so far connect them already.
4. Components of the links, over all neighbourhoods.

A large neighbourhood is cut into blocks of at most BLOCK_NGRAMS n-grams and some BLOCK_SETS sets. Each block is joined
together with one shared pivot; the nodes that this does not connect to the pivot are then sent, ASKING at a time, to
every block of a fitting size range. So no task holds a whole neighbourhood, and no pair of nodes of different components
is left unexamined.

Null, empty and word-less texts have size 0, link with nothing and are their own component. With fewer than five words
the whole sequence is the one n-gram. Repeated rows have equal sets and share a component. Empty tables give an empty
result. Other columns are not looked at. Null ids get component null unless they share one with other ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.graph import components
from rasterloom.llm.storage import id_bitmap, stage, text_batches
from rasterloom.llm.words import LOWER, SPACES, Words, buffers, chunks, mix, windows

N = 5
#: Similarity as a ratio of integers: 100 * intersection >= 80 * union.
PERCENT = 80
#: n-grams (8 bytes each) and sets of a block of a neighbourhood, and sets that ask a block at once.
BLOCK_NGRAMS, BLOCK_SETS, ASKING = 1_000_000, 512, 256
#: Size of the bitmaps that thin documents, keys and n-grams before exact joins, as powers of two of bits.
FILTER_BITS, GRAM_BITS = 24, 26
#: Children of a node of a signature tree.
FANOUT = 8

_ONE, _MUL = np.uint64(1), np.uint64(0xD6E8FEB86659FD93)


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def ngram_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row."""
    w = Words(LOWER[buf], offs, SPACES)
    h = w.hashes()
    grams = windows(h, N)
    first = w.first
    out = []
    for r in range(w.rows):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= N:
            out.append(np.unique(grams[a : b - N + 1]))
        elif b > a:
            out.append(windows(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _tokens(grams: np.ndarray, scheme: int, partner: int) -> np.ndarray:
    """Routing keys of a set under a scheme (sizes from 2**scheme), for partners of up to `partner` n-grams."""
    n = len(grams)
    if scheme < 4:  # few n-grams: each is a segment of its own
        need = n - -(-PERCENT * n // 100) + 1
        keys = mix(grams * _MUL + np.uint64(scheme))
        return np.sort(keys)[:need]
    need = (n + partner) * (100 - PERCENT) // (100 + PERCENT) + 1
    m = (2 << scheme) // 3
    segment = ((grams >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.append(start, n))
    keys = mix(np.add.reduceat(mix(grams), start) * _MUL + segment[start] * np.uint64(64) + np.uint64(scheme))
    if len(keys) <= need:
        missing = np.setdiff1d(np.arange(m, dtype=np.uint64), segment[start])
        blank = np.sort(mix(missing * np.uint64(64) + np.uint64(scheme)))[: need - len(keys)]
        return np.concatenate([keys, blank])
    return keys[np.lexsort((keys, -size))[:need]]


def routing_keys(grams: np.ndarray) -> np.ndarray:
    n = len(grams)
    if not n:
        return grams
    scheme = n.bit_length() - 1
    largest = n * 100 // PERCENT
    keys = _tokens(grams, scheme, min(largest, (2 << scheme) - 1))
    if largest >= 2 << scheme:
        keys = np.concatenate([keys, _tokens(grams, scheme + 1, largest)])
    return keys


def node_id(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set; -1 for the empty one."""
    if not len(grams):
        return -1
    x = mix(np.add.reduce(mix(grams ^ _MUL))[None] + np.uint64(len(grams)))[0] & np.uint64((1 << 63) - 1)
    return int(x)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, node, keys; keys only for the first row of the partition with that set."""
    seen: set[int] = set()
    for batch in batches:
        buf, offs = buffers(batch.column(1))
        for i, j in chunks(offs):
            nodes, sizes, keys = [], [], []
            for grams in ngram_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                node = node_id(grams)
                new = node >= 0 and node not in seen
                if new:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                nodes.append(node)
                sizes.append(len(grams))
                keys.append(routing_keys(grams).view(np.int64) if new else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys), pa.int64())),
                ],
                ["doc_id", "n", "node", "keys"],
            )


def _sets_of(sent, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if not len(keep):
                continue
            rows = batch.take(pa.array(keep))
            buf, offs = buffers(rows.column(2))
            for i, j in chunks(offs):
                sets = ngram_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(i, j - i), pa.array([node_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "node", "grams"],
                )

    return run


class SignatureTree:
    """Levels of nodes over leaves that are ordered by size: OR-combined bitmaps, size ranges, largest collisions."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        width = 1 << int(np.clip(int(4 * n.max()).bit_length(), 9, 15))
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for r, s in enumerate(sets):
            at = (s & np.uint64(width - 1)).astype(np.int64)
            np.bitwise_or.at(bits[r], at >> 6, _ONE << (at & 63).astype(np.uint64))
        extra = n - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, n, n, extra)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra = self.levels[-1]
            start = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(bits, start), np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), np.maximum.reduceat(extra, start))
            )

    def possible(self, level: int, a: int, others: np.ndarray) -> np.ndarray:
        """Which of the nodes may hold a set that links with one below node a, of the same level."""
        bits, low, high, extra = self.levels[level]
        fits = (100 * low[others] <= 125 * high[a]) & (100 * low[a] <= 125 * high[others])
        others = others[fits]
        overlap = np.bitwise_count(bits[others] & bits[a]).sum(axis=1) + np.minimum(extra[others], extra[a])
        overlap = np.minimum(overlap, np.minimum(high[others], high[a]))
        return others[(100 + PERCENT) * overlap >= PERCENT * (low[others] + low[a])]

    def pairs(self, apart) -> Iterator[tuple[int, int]]:
        """Pairs of leaves that the traversal cannot exclude. apart(level, a, others) drops pairs of no interest."""
        todo = [(len(self.levels) - 1, 0, np.array([0]))]
        while todo:
            level, a, others = todo.pop()
            if level == 0:
                for b in others.tolist():
                    if b != a:
                        yield a, b
                continue
            size = len(self.levels[level - 1][1])
            below = (others[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = below[below < size]
            for child in range(a * FANOUT, min(size, (a + 1) * FANOUT)):
                rest = apart(level - 1, child, below[below >= child])
                if len(rest):
                    rest = self.possible(level - 1, child, rest)
                if len(rest):
                    todo.append((level - 1, child, rest))


def _join_block(nodes: list[int], sets: list[np.ndarray], probe: list[bool] | None = None) -> list[tuple[int, int]]:
    """(node, smallest node that links reach). With probe, only pairs with a probing set are looked at."""
    count = len(nodes)
    order = sorted(range(count), key=lambda i: (len(sets[i]), int(sets[i][0]), nodes[i]))
    nodes, sets = [nodes[i] for i in order], [sets[i] for i in order]
    asks = None if probe is None else np.array([probe[i] for i in order])
    parent = np.arange(count)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    links: list[tuple[int, int]] = []

    def check(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b and linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
            parent[max(a, b)] = min(a, b)
            links.append((nodes[i], nodes[j]))

    def stars() -> list[tuple[int, int]]:
        least: dict[int, int] = {}
        for i in range(count):
            r = find(i)
            least[r] = min(least.get(r, nodes[i]), nodes[i])
        return [(nodes[i], least[find(i)]) for i in range(count) if nodes[i] != least[find(i)]]

    if count == 2:
        check(0, 1)
        return stars()
    tree = SignatureTree(sets)
    state = {"links": -1}

    def apart(level: int, a: int, others: np.ndarray) -> np.ndarray:
        """Without pairs of tree nodes whose leaves are all of one component, or that hold nobody who asks."""
        if state["links"] < 0 or len(links) - state["links"] > count // 16:
            state["links"] = len(links)
            roots = np.array([find(i) for i in range(count)])
            low = high = roots
            ask = asks
            state["levels"] = []
            for k in range(len(tree.levels)):
                if k:
                    start = np.arange(0, len(low), FANOUT)
                    low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
                    ask = None if ask is None else np.logical_or.reduceat(ask, start)
                state["levels"].append((low, high, ask))
        low, high, ask = state["levels"][level]
        same = (low[others] == high[others]) & (low[a] == high[a]) & (low[others] == low[a])
        if level == 0:
            same |= others == a
        elif low[a] != high[a]:
            same &= others != a
        if ask is not None and not ask[a]:
            same |= ~ask[others]
        return others[~same]

    for i in range(1, count):  # neighbours in the order are the likeliest links
        if asks is None or asks[i] or asks[i - 1]:
            check(i - 1, i)
    for i, j in tree.pairs(apart):
        if asks is None or asks[i] or asks[j]:
            check(i, j)
    return stars()


def _join_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, node, probe, grams) arrive sorted by (part, block); each block is joined on its own."""
    key, nodes, sets, probes = None, [], [], []
    out: list[tuple[int, int]] = []

    def close() -> None:
        if len(nodes) > 1:
            out.extend(_join_block(nodes, sets, probes if any(p is not None for p in probes) else None))

    for batch in batches:
        part, block, node, probe = (batch.column(k).to_pylist() for k in range(4))
        for i, grams in enumerate(batch.column(4)):
            if (part[i], block[i]) != key:
                close()
                key, nodes, sets, probes = (part[i], block[i]), [], [], []
            nodes.append(node[i])
            probes.append(probe[i])
            sets.append(np.frombuffer(grams.as_py(), np.uint64))
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    close()
    yield _edges(out)


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def _block_links(rows: DataFrame) -> DataFrame:
    """Links of rows (part, block, node, probe, grams), block by block."""
    dealt = rows.select("part", "block", "node", "probe", "grams").repartition("part", "block").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(_join_sorted, "a long, b long")


def _rows_of(sent):
    """(gram, node, n) for every n-gram of the documents in the bitmap."""
    sets = _sets_of(sent, FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sets(batches):
            buf, offs = buffers(batch.column(2))
            size = np.diff(offs) // 8
            for i in range(0, batch.num_rows, 256):
                j = min(i + 256, batch.num_rows)
                grams = np.frombuffer(buf[offs[i] : offs[j]].tobytes(), np.int64)
                node = np.repeat(batch.column(1).to_numpy()[i:j], size[i:j])
                n = np.repeat(size[i:j], size[i:j]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(node), pa.array(n)], ["gram", "node", "n"])

    return run


def _listed(sent, bits: int, column: int) -> object:
    """Rows whose value in a column (a hash) has its bit in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = batch.column(column).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
            yield batch.filter(pa.array(((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))

    return run


def _listed_keys(sent):
    """(node, key) for the keys of each node whose bits are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)
            key = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            at = key & ((1 << FILTER_BITS) - 1)
            keep = ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(key[keep])], ["node", "key"])

    return run


def _placed(docs: DataFrame) -> DataFrame:
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long").alias("doc_id")), F.lit(1 << FILTER_BITS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("at"), "text").where("doc_id IS NOT NULL")


def _neighbourhoods(docs: DataFrame, profile: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, part) of the nodes that may link with others.

    Keys and n-grams that several nodes have are found by aggregates that combine before they move, and met again by joins
    whose hot keys Spark can split. Bitmaps of fixed size keep most rows out of these joins; they lose none, and where
    they fill up, the joins alone decide.
    """
    spark = docs.sparkSession
    several = [F.min("node").alias("low"), F.max("node").alias("high")]
    keyed = profile.where("size(keys) > 0").select("node", "keys")
    met = keyed.select("node", F.explode("keys").alias("key")).groupBy("key").agg(*several).where("low <> high").select("key")
    met = stage(met, "keys")
    sent = spark.sparkContext.broadcast(id_bitmap(met, "key", FILTER_BITS, hashed=True))
    shared = keyed.mapInArrow(_listed_keys(sent), "node long, key long").join(met, "key", "left_semi")
    candidates = stage(shared.select("node").distinct().join(firsts, "node"), "candidates")
    bitmap = spark.sparkContext.broadcast(id_bitmap(candidates, "doc_id", FILTER_BITS))
    grams = stage(_placed(docs).mapInArrow(_rows_of(bitmap), "gram long, node long, n int"), "grams")
    # n-grams of one node come first in the order; they take up places of the prefix but route nowhere.
    counts = stage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    sent = spark.sparkContext.broadcast(id_bitmap(counts, "gram", GRAM_BITS, hashed=True))
    grams = grams.mapInArrow(_listed(sent, GRAM_BITS, 0), "gram long, node long, n int").join(counts, "gram")
    by_node = Window.partitionBy("node").orderBy("df", "gram")
    grams = grams.withColumn("rank", F.dense_rank().over(by_node))
    kinds = F.max("rank").over(Window.partitionBy("node"))
    need = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    prefix = grams.withColumn("kinds", kinds).where(F.col("rank") + F.col("n") - F.col("kinds") <= need)
    prefix = stage(prefix.select("gram", "node"), "prefix")
    lows = stage(prefix.groupBy("gram").agg(*several).where("low <> high").select("gram", "low"), "lows")
    edges = prefix.join(lows, "gram").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    return components(edges).select("node", F.col("label").alias("part"))


def _labels(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(node, label) of the nodes that link with others: label is the smallest node that links reach."""
    spark = docs.sparkSession
    firsts = profile.where("node >= 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    parts = _neighbourhoods(docs, profile, firsts)
    wanted = stage(parts.join(firsts, "node"), "wanted")
    bitmap = spark.sparkContext.broadcast(id_bitmap(wanted, "doc_id", FILTER_BITS))
    found = _placed(docs).mapInArrow(_sets_of(bitmap, FILTER_BITS), "doc_id long, node long, grams binary")
    sized = wanted.groupBy("part").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets"))
    blocks = (F.floor(F.greatest(F.col("total") / BLOCK_NGRAMS, F.col("sets") / BLOCK_SETS)) + 1).cast("int")
    wanted = wanted.join(sized.select("part", blocks.alias("blocks")), "part")
    members = found.join(wanted, ["doc_id", "node"])
    members = stage(members.dropDuplicates(["node"]).select("part", "node", "n", "blocks", "grams"), "members")
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    plain = members.withColumn("block", block).withColumn("probe", F.lit(None).cast("boolean"))
    large = members.where("blocks > 1")
    if large.isEmpty():
        return stage(_block_links(plain).select(F.col("a").alias("node"), F.col("b").alias("label")), "labels")
    pivot_of = large.groupBy("part").agg(F.min("node").alias("pivot"))
    pivots = large.join(pivot_of, "part").where("node = pivot")
    pivots = pivots.withColumn("own", block).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).where("block <> own")
    pivots = pivots.withColumn("probe", F.lit(None).cast("boolean"))
    cols = ["part", "block", "node", "probe", "grams"]
    links = stage(_block_links(plain.select(cols).unionByName(pivots.select(cols))), "links")
    labels = components(links)
    labelled = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = labelled.join(pivot_of, "part").where("node = pivot").select("part", F.col("label").alias("main"))
    rest = stage(labelled.join(main, "part").where("label <> main").select("part", "node", "n", "grams"), "rest")
    if rest.isEmpty():
        return labels
    # What the pivots did not connect goes to every block whose sizes fit, and is compared with all that is there.
    ranges = plain.where("blocks > 1").groupBy("part", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sent = rest.alias("r").join(ranges.alias("g"), "part").where("100 * g.low <= 125 * r.n AND 100 * r.n <= 125 * g.high")
    asking = stage(sent.select("part", "block", "node", F.lit(True).alias("probe"), "grams"), "asking")
    # As many copies of a block as there are lots of sets that ask it.
    lots = asking.groupBy("part", "block").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("lots"))
    asking = asking.join(lots, ["part", "block"]).withColumn("lot", F.pmod(F.xxhash64("node", F.lit("lot")), F.col("lots").cast("long")).cast("int"))
    there = plain.where("blocks > 1").withColumn("probe", F.lit(False)).join(lots, ["part", "block"])
    there = there.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    both = asking.select(*cols, "lot").unionByName(there.select(*cols, "lot"))
    name = F.xxhash64("block", "lot").alias("block")
    both = both.select("part", name, "node", "probe", "grams")
    return components(stage(links.unionByName(_block_links(both)), "links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    text_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = stage(source.mapInArrow(_profile, "doc_id long, n long, node long, keys array<long>"), "profile")
    nodes = profile.where("node >= 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = nodes.join(_labels(docs, profile), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stage(labelled, "labelled")
    lowest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stage(labelled.join(lowest, "label").select("node", "component_id"), "named")
    out = profile.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node") < 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))

"""Exact deduplication against historical digests held in minimal perfect hash tables.

Each digest shard of the history becomes a minimal perfect hash: a displacement per bucket and one slot per distinct
digest, holding the full 32-byte digest and the locator of its winner. A lookup lands on exactly one slot and compares
the whole digest, so a digest that is not in the history is never taken for a member. Members join their historical
group; the others are grouped among themselves. All that moves is a digest and an id a row, and rows are reduced to one
per digest before they move, so a group that holds a third of all rows is no larger than any other.

Null texts count as empty, and empty texts are equal to each other; very long texts are read whole. The row with the
largest id wins; null ids never win over others. Repeated rows each count in group_size, and of several rows with the
winner's id one stays. Rows are told apart by a number that they get when their digests are written, so every group
keeps exactly one row, whatever its ids. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.storage import drop_ids, shuffle_partitions, stage
from rasterloom.llm.words import mix

#: Mean digests of a bucket of the perfect hash, and the digests a shard may hold on average.
BUCKET, SHARD = 4, 16_384
#: Displacements tried at once.
TRIES = 16


class PerfectHash:
    """A minimal perfect hash of distinct digests (n x 32 bytes), built by hash and displace."""

    def __init__(self, digests: np.ndarray):
        self.n = n = len(digests)
        self.buckets = max(1, n // BUCKET)
        self.slots = np.full(n, -1, np.int64)
        self.displace = np.zeros(self.buckets, np.int64)
        if not n:
            return
        bucket_of, key = self._parts(digests)
        order = np.argsort(bucket_of, kind="stable")
        first = np.searchsorted(bucket_of[order], np.arange(self.buckets + 1))
        sizes = np.diff(first)
        taken = np.zeros(n, bool)
        tries = np.arange(TRIES, dtype=np.uint64)
        single: list[int] = []
        for bucket in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)].tolist():
            rows = order[first[bucket] : first[bucket + 1]]
            if len(rows) == 1:
                single.append(bucket)
                continue
            start = 0
            while True:
                at = self._place(key[rows][None, :], tries[:, None] + np.uint64(start))
                spread = np.sort(at, axis=1)
                good = np.flatnonzero((spread[:, 1:] != spread[:, :-1]).all(axis=1) & ~taken[at].any(axis=1))
                if len(good):
                    break
                start += TRIES
                if start > 1 << 26:
                    raise ValueError("two equal digests in one table")
            self.displace[bucket] = start + int(good[0])
            taken[at[good[0]]] = True
            self.slots[at[good[0]]] = rows
        free = np.flatnonzero(~taken)  # a bucket of one names its slot
        self.displace[single] = -1 - free
        self.slots[free] = order[first[single]]

    def _parts(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.ascontiguousarray(digests).view(">u8").astype(np.uint64)
        return (w[:, 1] % np.uint64(self.buckets)).astype(np.int64), w[:, 2]

    def _place(self, key: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return (mix(key + seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def locate(self, digests: np.ndarray) -> np.ndarray:
        """For each digest the row of the slot that it falls on; whether it is a member is for the bytes to say."""
        if not self.n or not len(digests):
            return np.full(len(digests), -1, np.int64)
        bucket, key = self._parts(digests)
        d = self.displace[bucket]
        at = np.where(d < 0, -1 - d, self._place(key, np.maximum(d, 0).astype(np.uint64)))
        return self.slots[np.minimum(at, self.n - 1)]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _merge_shard(history: pa.Table, incoming: pa.Table) -> pa.Table:
    """Look incoming digests up in the shard's perfect hash; members are merged, the others are added."""
    ours, theirs = _matrix(history["digest"]), _matrix(incoming["digest"])
    table = PerfectHash(ours)
    winner = history["winner"].to_pylist()
    size = history["size"].to_pylist()
    at = table.locate(theirs)
    member = at >= 0
    if member.any():
        member[member] = (ours[at[member]] == theirs[member]).all(axis=1)
    locator = history["locator"].to_pylist()
    more_winner, more_size, more_locator = (incoming[c].to_pylist() for c in ("winner", "size", "locator"))
    rank = lambda w, where: (w is not None, w or 0, where)
    for i in np.flatnonzero(member).tolist():
        r = int(at[i])
        size[r] += more_size[i]
        if rank(more_winner[i], more_locator[i]) > rank(winner[r], locator[r]):
            winner[r], locator[r] = more_winner[i], more_locator[i]
    rest = np.flatnonzero(~member).tolist()
    digests = history["digest"].to_pylist() + [incoming["digest"][i].as_py() for i in rest]
    return pa.table(
        {
            "digest": pa.array(digests, pa.binary()),
            "winner": pa.array(winner + [more_winner[i] for i in rest], pa.int64()),
            "locator": pa.array(locator + [more_locator[i] for i in rest], pa.int64()),
            "size": pa.array(size + [more_size[i] for i in rest], pa.int64()),
            "historical": pa.array([True] * len(ours) + [False] * len(rest), pa.bool_()),
        }
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte digest of the unchanged text."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def groups(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """digest, winner, locator (its row), size, historical for both inputs of (doc_id, digest, row)."""
    spark = history.sparkSession
    best = F.max(F.struct("doc_id", "row")).alias("best")
    old, new = (x.groupBy("digest").agg(best, F.count(F.lit(1)).alias("size")) for x in (history, incoming))
    old = stage(old, "digest-history")
    shards = max(4 * shuffle_partitions(spark), old.count() // SHARD + 1)
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    cols = [shard, "digest", F.col("best.doc_id").alias("winner"), F.col("best.row").alias("locator"), "size"]
    return (
        old.select(*cols).groupBy("shard")
        .cogroup(new.select(*cols).groupBy("shard"))
        .applyInArrow(_merge_shard, "digest binary, winner long, locator long, size long, historical boolean")
    )


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept.

    With a history (doc_id, text), repeats of it are judged together with it, and a row that ties with one of it goes.
    Without one, the rows of docs with an even checksum of their id serve as the history of the others, so both paths are
    in use.
    """
    new = stage(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    if history is None:
        early = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
        merged = groups(new.where(early), new.where(~early))
    else:
        merged = groups(digests(history).withColumn("row", F.lit((1 << 63) - 1)), new)
    return new.join(merged, "digest").select(
        "doc_id",
        "digest",
        F.col("winner").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("locator")).alias("kept"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, the one with the largest id; columns as they came.

    Rows go by their id, most of them without moving. Where several rows have one id, or none, they are compared with the
    kept texts of that id, and one of each stays.
    """
    found = stage(exact_dedup(docs.select("doc_id", "text")).select("doc_id", "digest", "kept"), "judged")
    by_id = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    by_id = stage(by_id.where("doc_id IS NULL OR NOT kept OR rows > 1"), "judged-ids")
    odd = by_id.where("doc_id IS NULL OR (kept AND rows > 1)")
    plain = drop_ids(docs.where("doc_id IS NOT NULL"), by_id.select("doc_id"), "doc_id")
    if odd.isEmpty():
        return plain
    pairs = found.where("kept").join(odd.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    pairs = pairs.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    again = docs.withColumn("_own", F.unhex(F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest"))
    again = again.join(pairs, same).dropDuplicates(["_id", "_digest"])
    return plain.unionByName(again.select(docs.columns))

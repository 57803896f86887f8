"""Packet sequences: progression orders, volumes, offsets, ordered assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sort columns of each progression order.
PROGRESSIONS = {
    "LRCP": ["layer", "resolution", "component", "y", "x"],
    "RLCP": ["resolution", "layer", "component", "y", "x"],
    "RPCL": ["resolution", "y", "x", "component", "layer"],
    "PCRL": ["y", "x", "component", "resolution", "layer"],
    "CPRL": ["component", "y", "x", "resolution", "layer"],
}


def sequence_packets(packets: DataFrame, image: list[str], progression: str) -> DataFrame:
    """packets with `seq`, their number within the image in a progression order."""
    w = Window.partitionBy(*image).orderBy(*PROGRESSIONS[progression])
    return packets.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def first_volume(packets: DataFrame, volumes: list[tuple[int, int, int, int, int]], keys: list[str]) -> DataFrame:
    """Packets of successive volumes; one that an earlier volume gave is skipped.

    volumes (volume, res_end, layer_end, comp_start, comp_end) are header fields: they become one expression, so packets
    are not joined with anything.
    """
    first = F.lit(None).cast("int")
    for volume, res_end, layer_end, comp_start, comp_end in sorted(volumes, reverse=True):
        inside = (F.col("resolution") < res_end) & (F.col("layer") < layer_end) & F.col("component").between(comp_start, comp_end - 1)
        first = F.when(inside, volume).otherwise(first)
    return packets.withColumn("volume", first).where("volume IS NOT NULL").groupBy(*keys).agg(F.min("volume").alias("volume"))


def running_offset(size: Column, keys: list[str], order: list[str]) -> Column:
    """Where a piece begins: the sum of the sizes before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long")


def assemble(pieces: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """One value per key: its pieces in order. The order is explicit; nothing rests on how rows arrive."""
    items = F.array_sort(F.collect_list(F.struct(order, data)))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(items, lambda p: p[data]), "").alias(data))


def mq_or_raw(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """By block, bytes of arithmetic and of raw segments, told apart by the pass each begins at.

    Segments of equal `order` go by passes, then size, so that rows alone decide the sums; nulls come last, as in the SQL.
    """
    by = [F.col(c).asc_nulls_last() for c in (order, "passes", "size")]
    w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    first = segments.withColumn("first", F.coalesce(F.sum("passes").over(w), F.lit(0)))
    raw = (F.col("first") >= 10) & (F.col("first") % 3 != 0)
    return first.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~raw, F.col("size"))), F.lit(0)).alias("mq_bytes"), F.coalesce(F.sum(F.when(raw, F.col("size"))), F.lit(0)).alias("raw_bytes")
    )


def within_limit(pieces: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Pieces in order, as long as all so far fit into the limit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("sent", F.sum(size).over(w)).where(F.col("sent") <= limit)

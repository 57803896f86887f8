"""Byte ranges: merging, prefixes, cache models, demands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Disjoint ranges by key; ranges that overlap or touch become one. One shuffle and one sort."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(seen.isNull() | (F.col(start) > seen), 1).otherwise(0)
    rows = ranges.select(*keys, start, end, opens.alias("_o"))
    rows = rows.withColumn("_g", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def covered_reads(reads: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """reads [a, b) with the (s, e) of the one range that covers them; others go.

    Merged ranges are disjoint, so it can only be the last one that begins at or before the read: one shuffle and one
    sort, and no comparison of every read of a key with every range of it.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    held = merged.where(known).select(*keys, F.struct("s", "e").alias("_range"), F.col("s").alias("_at"), F.lit(0).alias("_read"))
    asked = reads.where(known & F.col("a").isNotNull()).select("*", F.col("a").alias("_at"), F.lit(1).alias("_read"))
    w = Window.partitionBy(*keys).orderBy("_at", "_read").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(held, allowMissingColumns=True)
    rows = rows.withColumn("_range", F.last("_range", ignorenulls=True).over(w)).where("_read = 1")
    return rows.where("_range.s <= a AND _range.e >= b").select(*reads.columns, "_range.*")


def known_prefix(merged: DataFrame, keys: list[str]) -> DataFrame:
    """By key the bytes known from offset 0 on: the first range, if it begins there."""
    return merged.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("s") == 0, F.col("e"))), F.lit(0)).alias("prefix"))


def model_state(prefix: Column, final: Column) -> Column:
    return F.when(final == prefix, "complete").when(prefix > 0, F.concat(F.lit("prefix:"), prefix)).otherwise("none")


def plan_demands(demands: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """demands (wanted, length) joined with a cache model (known, complete): where each delivery starts, or no row."""
    both = demands.join(model, keys, "left")
    start = F.least(F.coalesce("known", F.lit(0)), F.col("length"))
    wanted = F.least(F.col("wanted"), F.col("length"))
    out = both.withColumn("start", start).withColumn("stop", wanted)
    finished = F.coalesce(F.col("complete"), F.lit(False)) | ((F.col("start") >= F.col("stop")) & (F.col("stop") < F.col("length")))
    return out.where(~finished)


def generations(events: DataFrame, keys: list[str], order: str, identity: str) -> DataFrame:
    """events with `generation`, raised whenever the identity changes or is "0"; a new generation empties the cache."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(identity).over(w)
    change = F.when(before.isNull() | (F.col(identity) != before) | (F.col(identity) == "0"), 1).otherwise(0)
    marked = events.withColumn("_c", change)
    return marked.withColumn("generation", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")

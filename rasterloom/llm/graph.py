"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.storage import stage


#: Edges of a task of the small tables that pass between rounds.
TASK_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b) of longs: label is the smallest node that is reachable. Loops are ignored.

    Every round shuffles the edges once per star and writes them to the shared folder; minima are combined before they
    move. The number of rounds grows with the logarithm of the largest component.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stage(e, "edges")
    state = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = tuple(e.agg(*state).first())
    while before[0]:
        tasks = before[0] // TASK_EDGES + 4
        # Minima are written first: a join of two plain shuffles is one whose hot nodes Spark can split.
        low = stage(e.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "low")
        at = low.select(F.col("u").alias("c"), F.col("m").alias("cm"))
        large = e.join(at, F.col("v") == F.col("c"), "left").select("u", F.coalesce("cm", "v").alias("v"))
        large = stage(large.distinct().coalesce(tasks), "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        now = tuple(e.agg(*state).first())
        if now == before:
            break
        before = now
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

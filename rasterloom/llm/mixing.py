"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies. Within a source, documents in order of size have a
prefix sum of expected copies; one random offset is added, and a document is emitted once per integer boundary that its
part of the sum crosses. The order by size spreads the picks over short and long documents, so the words taken come near
the target. Targets stop at `cap` times their source's size and the excess is shared again by weight.

The prefix sum needs no task that sees a whole source: rows are range-partitioned by (source, size, id), numbered within
their partition, and shifted by the counts of the partitions before (one row per partition and source).

Null and empty texts have size 0; they take part and count 0 words. Very long texts are counted whole. A null source is a source of its own, last in order.
Rows with equal (source, size, id) are ordered arbitrarily among themselves: the counts of the group agree between runs;
rows with null ids come first among equal sizes. The driver gathers nothing; the targets are worked out in one task over
one row a source, so sources may number millions, not billions. An empty table gives an empty result. A source of size 0 gets target 0. Other columns are kept by `sample`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.storage import shuffle_partitions, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "systematic"
#: Rows of a range of documents, on average.
ROWS = 1_000_000


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, ratio, offset from (source, source_size).

    Weights are dealt to the sources in code point order, null last. The level `l` at which the targets min(weight * l,
    cap * size) add up to all sizes is found in closed form over the sources ordered by cap * size / weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    w = totals.withColumn("weight", F.element_at(cyc, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("capped", (F.lit(cap) * F.col("source_size")).cast("double"))
    w = w.withColumn("bound", F.col("capped") / F.col("weight"))
    order = Window.orderBy("bound", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("spent", F.coalesce(F.sum("capped").over(before), F.lit(0.0)))
    w = w.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.sum("source_size").over(everything).cast("double") - F.col("spent")) / F.col("left_weight"))
    level = F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "level"))).over(everything)["level"]
    w = w.withColumn("target", F.least(F.col("weight") * level, F.col("capped")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    seeded = F.md5(F.encode(F.concat(F.lit(SEED + ":"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))), "UTF-8"))
    offset = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return w.select("source", "source_size", "target", ratio.alias("ratio"), offset.alias("offset"))


def _ranked(sized: DataFrame) -> DataFrame:
    """sized (source, size, doc_id, ...) with `place`: the row's number within its source, by size and id."""
    keys = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    sized = stage(sized, "mix-sizes")  # texts are read once; the ranges are drawn from, and dealt to, this narrow table
    tasks = max(shuffle_partitions(sized.sparkSession), sized.count() // ROWS + 1)
    parts = sized.repartitionByRange(tasks, *keys).withColumn("part", F.spark_partition_id())
    parts = stage(parts, "mix-ranges")
    counts = parts.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"))
    shift = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("part", "source", F.coalesce(shift, F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id"))
    ranked = parts.withColumn("local", local).alias("a").join(
        shifts.alias("b"), (F.col("a.part") == F.col("b.part")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    )
    return ranked.select("a.*", (F.col("b.shift") + F.col("a.local")).alias("place"))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    ranked = _ranked(sized)
    totals = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(stage(totals, "mix-totals"), weights, cap)
    joined = ranked.alias("r").join(t.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    # Whole copies are set apart, so that rounding cannot add to them at large places.
    whole = F.floor("ratio")
    upto = lambda k: F.floor(F.col("offset") + (F.col("ratio") - whole) * k)
    copies = (whole + upto(F.col("place")) - upto(F.col("place") - 1)).cast("long")
    return joined.select("r.doc_id", "r.source", "r.size", "t.source_size", "t.target", copies.alias("copies"))


def sample(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns as they came.

    Ids are taken to be unique here, as a row's copies are found by its id.
    """
    copies = plan(docs, weights, cap).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    joined = docs.join(copies.withColumnRenamed("doc_id", "_id"), docs["doc_id"].cast("long") == F.col("_id"))
    return joined.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[docs[c] for c in docs.columns])

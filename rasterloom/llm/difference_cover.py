"""The difference-cover suffix sort modulo 3 as tables: triples at two thirds of the positions are sorted and named, their
names are sorted by the same means, and the suffixes that are left are merged by counting what comes before them.

`suffix_dedup` cuts its input down before it sorts, and sorts the rest in blocks; this form sorts whole inputs of any size
without a block or a driver-side list, and the README tells what that costs. Positions need not be dense: a gap ends a text.
Every level of names reaches three times as far, so gaps must be longer than a name of the last level spans (729 for 200
bytes); then no suffix runs into the next text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.storage import shuffle_partitions, stage


def _before(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """keys, and for each flag the number of rows that have it and smaller keys. One row a key, in ranges of keys."""
    sums = rows.groupBy(*keys).agg(*[F.count_if(f).alias(f"_{n}") for n, f in flags.items()])
    parts = sums.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).withColumn("_part", F.spark_partition_id())
    parts = stage(parts, "cover-keys")
    totals = parts.groupBy("_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in flags])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}_0") for n in flags])
    local = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    both = parts.join(totals, "_part")
    return both.select(*keys, *[(F.coalesce(F.sum(f"_{n}").over(local), F.lit(0)) + F.col(f"_{n}_0")).alias(n) for n in flags])


def suffix_ranks(symbols: DataFrame, need: int | None = None, span: int = 1) -> DataFrame:
    """(pos, rank) of the suffixes of symbols (pos, c), c at least 1; a position without a symbol counts as 0.

    rank is the number of smaller suffixes. With `need`, suffixes whose first `need` symbols are equal may share a rank;
    the sort stops as soon as its names span that many. Several texts, whose suffixes may be equal, need it. span is the
    number of symbols that c stands for.
    """
    slot = F.explode(F.array(*[F.struct((F.col("pos") - k).alias("pos"), F.lit(k).alias("k"), "c") for k in range(3)])).alias("s")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("c")))
    triples = symbols.select(slot).select("s.*").groupBy("pos").agg(*[F.coalesce(at(k), F.lit(0)).alias(f"c{k}") for k in range(3)])
    triples = stage(triples.where("c0 > 0 AND pos >= 0"), "cover-triples")
    sample = triples.where("pos % 3 <> 0")
    name = ["c0", "c1", "c2"]
    names = stage(_before(sample, name, {"rank": F.lit(True)}), "cover-names")
    named = stage(sample.join(names, name).select("pos", F.col("rank").alias("name")), "cover-sample")
    if (need is None or 3 * span < need) and names.count() < named.count():
        # Positions of one residue, then, after as wide a gap, those of the other.
        top = 2 * (symbols.agg(F.max("pos")).first()[0] // 3 + 2)
        third = F.floor(F.col("pos") / 3)
        inner = named.select((third + F.when(F.col("pos") % 3 == 2, top).otherwise(0)).alias("pos"), (F.col("name") + 1).alias("c"))
        sorted_inner = suffix_ranks(inner, need, 3 * span)
        back = F.when(F.col("pos") < top, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - top) + 2)
        named = stage(sorted_inner.select(back.alias("pos"), F.col("rank").alias("name")), "cover-sample")
    ranks = named.select("pos", (F.col("name") + 1).alias("r"))
    one = ranks.select((F.col("pos") - 1).alias("pos"), F.col("r").alias("r1"))
    two = ranks.select((F.col("pos") - 2).alias("pos"), F.col("r").alias("r2"))
    known = triples.select("pos", "c0", "c1").join(ranks, "pos", "left").join(one, "pos", "left").join(two, "pos", "left")
    known = stage(known.fillna(0, ["r1", "r2"]).withColumn("kind", F.col("pos") % 3), "cover-known")
    is_kind = lambda k: F.col("kind") == k
    near = _before(known.where("kind < 2"), ["c0", "r1"], {"zeros": is_kind(0), "others": is_kind(1)})
    far = _before(known.where("kind <> 1"), ["c0", "c1", "r2"], {"zeros": is_kind(0), "twos": is_kind(2)})
    among = _before(known.where("kind > 0"), ["r"], {"samples": F.lit(True)})
    zero = known.where("kind = 0").join(near, ["c0", "r1"]).join(far.drop("zeros"), ["c0", "c1", "r2"])
    zero = zero.select("pos", (F.col("zeros") + F.col("others") + F.col("twos")).alias("rank"))
    first = known.where("kind = 1").join(near.drop("others"), ["c0", "r1"]).join(among, "r")
    second = known.where("kind = 2").join(far.drop("twos"), ["c0", "c1", "r2"]).join(among, "r")
    rest = first.select("pos", "zeros", "samples").unionByName(second.select("pos", "zeros", "samples"))
    return stage(zero.unionByName(rest.select("pos", (F.col("zeros") + F.col("samples")).alias("rank"))), "cover-ranks")


def symbols_of(docs: DataFrame, stride: int) -> DataFrame:
    """(pos, c) of the bytes of (number, data): the text of a number begins at number * stride, more than any text's bytes."""
    bytes_of = F.posexplode(F.transform(F.regexp_extract_all(F.hex("data"), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long") + 1))
    return docs.select("number", bytes_of.alias("i", "c")).select((F.col("number") * stride + F.col("i")).alias("pos"), "c")

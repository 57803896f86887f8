"""Tile indexes kept as tables: exported once, imported and joined with requests without reading any bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, tile int, start long, stop long"


def checked(index: DataFrame) -> DataFrame:
    """index (key, tile, start, stop), one row per tile. A tile that is named twice is an error, whatever its rows say."""
    once = index.groupBy("key", "tile").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    said = F.raise_error(F.concat(F.lit("tile "), F.col("tile"), F.lit(" of "), F.col("key"), F.lit(" is indexed twice")))
    return once.where(F.when(F.col("n") > 1, said.cast("boolean")).otherwise(F.lit(True))).select("key", "tile", "start", "stop")


def export_index(index: DataFrame, path: str) -> None:
    """Written in ranges of keys, so that later reads of some keys skip the other files by their statistics."""
    checked(index).repartitionByRange("key", "tile").sortWithinPartitions("key", "tile").write.parquet(path)


def import_index(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    index = spark.read.schema(SCHEMA).parquet(path)
    return index if keys is None else index.where(F.col("key").isin(keys))


def wanted_tiles(requests: DataFrame, index: DataFrame) -> DataFrame:
    """requests (req_id, key, tile) with the byte range of each tile. A tile that the index lacks is an error."""
    both = requests.join(index, ["key", "tile"], "left")
    said = F.raise_error(F.concat(F.lit("no tile "), F.col("tile"), F.lit(" of "), F.col("key")))
    return both.withColumn("start", F.when(F.col("start").isNull(), said.cast("long")).otherwise(F.col("start")))

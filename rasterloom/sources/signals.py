"""Signals made of relational tables: lines, planes, pixels, rectangles and byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where its files give fewer: for kernels that cost far more than a
    shuffle of their input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, v): each user's values, rounded, in event order."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value").cast("long").alias("v"))
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select("user_id", i.cast("long").alias("i"), "v")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, line): arrays of doubles."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("line"))


def planes(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """(vec_id, plane): 8 rows of 8 samples; whole ones are floor(128 f) within -128..127, else 128 f."""
    v = vectors(spark, sf_dir)
    scaled = F.transform("line", lambda f: f * 128)
    if whole:
        scaled = F.transform("line", lambda f: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(f * 128))).cast("long"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(scaled, y * 8 + 1, F.lit(8)))
    return v.select("vec_id", rows.alias("plane"))


def plane_samples(planes_df: DataFrame, name: str = "v") -> DataFrame:
    """(vec_id, y, x, v) of planes."""
    rows = planes_df.select("vec_id", F.posexplode("plane").alias("y", "row"))
    return rows.select("vec_id", "y", F.posexplode("row").alias("x", name))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, r, g, b) with channels in 0..255."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.least(F.lit(255), F.floor(F.col("l_quantity") * 5)).cast("long").alias("r"),
        (F.round(F.col("l_discount") * 100).cast("long") * 25).alias("g"),
        (F.round(F.col("l_tax") * 100).cast("long") * 30).alias("b"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req_id, x, y, w, h): rectangles within a 4096 x 4096 frame."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("c"))
    k, c = F.col("req_id"), F.col("c")
    return o.select(
        "req_id",
        (k * 37 % 3840).alias("x"),
        ((k * 11 + c * 17) % 3840).alias("y"),
        (1 + k % 255).alias("w"),
        (1 + c % 254).alias("h"),
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, s, e): byte ranges [s, e) of bins."""
    li = read_table(spark, sf_dir, "lineitem")
    s = F.col("l_orderkey") * 10
    return li.select(F.col("l_suppkey").alias("k"), s.alias("s"), (s + F.floor("l_quantity").cast("long")).alias("e"))


def palette(spark: SparkSession) -> DataFrame:
    """(entry, r, g, b): 256 entries from a rule."""
    i = F.col("id")
    return spark.range(256).select(i.alias("entry"), (i * 7 % 256).alias("r"), (i * 13 % 256).alias("g"), (255 - i).alias("b"))

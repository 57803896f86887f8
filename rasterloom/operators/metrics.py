"""Error metrics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_aggregates(a: Column, b: Column) -> list[Column]:
    """n, peak and the exact sum of squared differences of whole samples."""
    d = a - b
    return [F.count(F.lit(1)).alias("n"), F.max(F.abs(d)).alias("peak"), F.sum((d * d).cast("decimal(20,0)")).alias("squares")]


def mse(squares: Column, n: Column) -> Column:
    return squares.cast("double") / n


def nmse(squares: Column, n: Column, bits: int) -> Column:
    return squares.cast("double") / n / float(((1 << bits) - 1) ** 2)


def size_bucket(v: Column) -> Column:
    """0 for 0, else one more than the exponent of the least power of two that is not smaller."""
    return F.when(v == 0, F.lit(0)).when(v == 1, F.lit(1)).otherwise(F.length(F.bin((v - 1).cast("long"))) + 1).cast("int")


def bucket_bound(bucket: Column) -> Column:
    return F.when(bucket == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), (bucket - 1).cast("double"))).cast("long")


def percentile_bounds(values: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """By key, the upper bound of the bucket that holds the nearest-rank percentile.

    Values are counted by bucket first; the cumulative step sees at most 65 rows a key.
    """
    counts = values.groupBy(*keys, size_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    run = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("run", run).withColumn("total", F.sum("n").over(w))
    rank = lambda p: F.greatest(F.ceil(F.col("total") * p / 100), F.lit(1))
    bounds = [bucket_bound(F.min(F.when(F.col("run") >= rank(p), F.col("bucket")))).alias(f"p{p}") for p in percents]
    return counts.groupBy(*keys).agg(F.sum("n").alias("reads"), *bounds)

"""Reading inputs and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local one is made only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_rasterloom_dir", None)
    if not found:
        if not (sc.master or "").split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = sc._rasterloom_dir = tempfile.mkdtemp(prefix="rasterloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def remove_staged(spark: SparkSession) -> None:
    """Delete the tables that this application has staged. Results that are still lazy cannot be read after this."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later reads survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts: the default of 10,000 would hold some 35 MB on either side of a Python worker.
BATCH_ROWS = 2_000


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session small, unless they are already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, k: int):
    """crc32 of the id as text, modulo k; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % k


def id_bitmap(ids: DataFrame, column: str, bits: int, hashed: bool = False) -> bytes:
    """A bitmap of 2**bits bits over xxhash64 of a column (or over a hash that it holds). Its size is fixed.

    It may hold false positives, never false negatives: callers use it to thin rows before an exact join.
    """
    h = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(1 << bits))
    parts = (
        ids.select((h + 1).alias("h"))
        .groupBy(F.bitmap_bucket_number("h").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
        .collect()
    )
    out = bytearray(max(1 << bits >> 3, 4096))
    for b, m in parts:
        out[(b - 1) * 4096 : b * 4096] = m
    return bytes(out)


def _where_bit(sent, want: bool):
    """Rows whose last column is a place of the bitmap that holds `want`, without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            bit = ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(bit == want))

    return run


def drop_ids(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """docs without the rows whose id is in ids (a table with that column alone); rows with a null id stay.

    Most rows are told apart by a bitmap of at most 32 MB and never move; only those that it cannot clear are joined.
    With so many ids that the bitmap fills up, this is a plain join again.
    """
    text_batches(docs.sparkSession)
    ids = stage(ids.where(F.col(column).isNotNull()).distinct(), "drop")
    bits = min(28, max(15, (16 * ids.count()).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(id_bitmap(ids, column, bits))
    marked = docs.select("*", F.pmod(F.xxhash64(F.col(column).cast("long").alias(column)), F.lit(1 << bits)).alias(f"at-{uuid.uuid4().hex}"))
    clear = marked.mapInArrow(_where_bit(sent, False), docs.schema)
    return clear.unionByName(marked.mapInArrow(_where_bit(sent, True), docs.schema).join(ids, column, "left_anti").select(docs.columns))

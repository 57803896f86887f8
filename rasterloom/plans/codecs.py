"""Queries of sequential kernels: block coding, file formats, framing. Their rows come back as they went in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators import blocks, codestream, rate, wavelet
from rasterloom.plans.registry import PLANES, query
from rasterloom.sources import raster_files
from rasterloom.sources.signals import plane_samples, planes, read_table, spread
from rasterloom.streaming import delivery


@query(f"WITH {PLANES} SELECT vec_id, y, x, v FROM sig")
def q_block_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5/3 analysis, bit-plane coding, decoding and synthesis of every plane."""
    coded = blocks.encode_blocks(spread(wavelet.analyse_planes(planes(spark, sf_dir))), "vec_id", "plane")
    return plane_samples(wavelet.synthesise_planes(blocks.decode_blocks(coded, "vec_id")))


@query(f"WITH {PLANES} SELECT vec_id, y, x, v, 8 AS width, 8 AS height FROM sig")
def q_pgx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes written as PGX files by expressions, and read back."""
    files = planes(spark, sf_dir).select("vec_id", raster_files.write_pgx(F.col("plane"), 8, 8).alias("payload"))
    parsed = raster_files.read_pgx(files, "vec_id", "payload")
    rows = parsed.select("vec_id", "width", "height", F.posexplode("plane").alias("y", "row"))
    return rows.select("vec_id", "y", F.posexplode("row").alias("x", "v"), "width", "height")


def _lzw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column(1).to_pylist()
        packed = [raster_files.lzw_encode(d) for d in data]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raster_files.lzw_decode(p) for p in packed], pa.binary())], ["page_id", "data"])


@query("SELECT page_id, md5(html) AS digest, strlen(html)::BIGINT AS size FROM pages")
def q_lzw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"))
    back = p.mapInArrow(_lzw, "page_id long, data binary")
    return back.select("page_id", F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("size"))


@query(
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, [0, 2, 8][event_id % 3 + 1] AS class, event_id % 900 AS id,
    event_id * 7 % 5000 AS "offset", event_id % 4 = 0 AS final, props AS text FROM events"""
)
def q_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages framed by expressions, joined in order to one response a user, and decoded."""
    e = F.col("event_id")
    cls = F.element_at(F.array(F.lit(0), F.lit(2), F.lit(8)), (e % 3 + 1).cast("int"))
    message = delivery.message_bytes(cls, e % 900, e * 7 % 5000, e % 4 == 0, F.encode("props", "UTF-8"))
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.hex(message).alias("m"))
    parts = F.array_sort(F.collect_list(F.struct("event_id", "m")))
    whole = rows.groupBy("user_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["m"]), "")).alias("body"))
    out = delivery.decode_responses(whole.select("user_id", F.concat("body", delivery.end_bytes()).alias("payload")), "user_id", "payload")
    return out.select("user_id", "ordinal", "class", "id", "offset", "final", F.decode("data", "UTF-8").alias("text"))


_RGB = f"WITH {PLANES}, rgb AS (SELECT vec_id, c, y, x, [v + 128, 127 - v, abs(v)][c + 1] AS v FROM sig, range(3) t(c))"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:

    def each(change) -> Column:
        return F.transform("plane", lambda row: F.transform(row, lambda v: change(v)))

    rgb = F.array(each(lambda v: v + 128), each(lambda v: 127 - v), each(F.abs))
    return spread(planes(spark, sf_dir).select("vec_id", rgb.alias("image")))


def _samples(images: DataFrame) -> DataFrame:
    rows = images.select("vec_id", F.posexplode("planes").alias("c", "plane")).select("vec_id", "c", F.posexplode("plane").alias("y", "row"))
    return rows.select("vec_id", "c", "y", F.posexplode("row").alias("x", "v"))


@query(f"{_RGB} SELECT vec_id, c, y, x, v FROM rgb")
def q_codestream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images to lossless codestreams and back."""
    return _samples(codestream.decode_images(codestream.encode_images(_images(spark, sf_dir), "vec_id", "image"), "vec_id"))


@query(f"{_RGB} SELECT vec_id, CASE c WHEN 2 THEN 0 ELSE 1 END AS c, y - 2 AS y, x - 3 AS x, v FROM rgb WHERE c IN (2, 0) AND y BETWEEN 2 AND 5 AND x BETWEEN 3 AND 5")
def q_codestream_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of two components, in the order asked for, of a tiled stream: only the tiles it touches are decoded."""
    streams = codestream.encode_images(_images(spark, sf_dir), "vec_id", "image", tile=4)
    return _samples(codestream.decode_images(streams, "vec_id", region=(3, 2, 3, 4), components=[2, 0]))


@query("SELECT vec_id, 8 AS width, 8 AS height, 3 AS components, 8 AS bits, 2 AS levels, true AS colour, true AS supported FROM embeddings")
def q_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codestream.inspect_images(codestream.encode_images(_images(spark, sf_dir), "vec_id", "image"), "vec_id")


@query("SELECT vec_id, t AS tile, t = 0 AS first, true AS chained FROM embeddings, range(4) r(t)")
def q_tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile bodies by one pass over headers; each begins 14 bytes after the one before ends."""
    streams = codestream.encode_images(_images(spark, sf_dir), "vec_id", "image", tile=4)
    before = F.lag("stop").over(Window.partitionBy("vec_id").orderBy("tile"))
    index = codestream.index_tiles(streams, "vec_id").withColumn("before", before)
    return index.select("vec_id", "tile", F.col("before").isNull().alias("first"), F.coalesce(F.col("start") == F.col("before") + 14, F.lit(True)).alias("chained"))


@query("SELECT p_partkey, substr(p_name, 2, 3) AS part, 1 + 3 <= strlen(p_name) AS inside FROM part")
def q_subrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checked window of bytes over a payload."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("payload"))
    return p.select("p_partkey", F.decode(F.substring("payload", 2, 3), "UTF-8").alias("part"), (F.octet_length("payload") >= 4).alias("inside"))


@query()
def q_rate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest quantisation of each 9/7 plane that fits 40 bytes."""
    coded = spread(wavelet.analyse_planes(planes(spark, sf_dir, whole=False), wavelet.FORWARD_97))
    return rate.search_planes(coded, "vec_id", "plane", 40)


@query(
    """WITH d AS (SELECT user_id, event_id % 40 AS id, min(event_id) AS place FROM events GROUP BY ALL),
    b AS (SELECT *, 40 + id * 37 % 400 AS length, CASE WHEN id % 3 > 0 THEN id * 11 % 500 END AS wanted, id % 7 * 20 AS known FROM d),
    f AS (SELECT *, least(coalesce(wanted, length), length) AS until, least(known, length) AS since FROM b WHERE id % 11 <> 0),
    p AS (SELECT user_id, id, place, length, until, unnest(CASE WHEN since < until THEN range(since, until, 128) WHEN until = length THEN [since] ELSE [] END) AS start FROM f),
    s AS (SELECT *, greatest(start, least(start + 128, until)) - start AS n, CASE WHEN id < 16 THEN 3 ELSE 4 END + CASE WHEN start < 128 THEN 1 ELSE 2 END AS fixed FROM p),
    c AS (SELECT *, fixed + CASE WHEN n < 128 THEN 1 ELSE 2 END + n AS cost FROM s),
    r AS (SELECT *, row_number() OVER w AS number, sum(cost) OVER w AS spent FROM c WINDOW w AS (PARTITION BY user_id ORDER BY place, start)),
    cut AS (SELECT *, list_max(list_filter(range(1, 129), lambda k: fixed + CASE WHEN k < 128 THEN 1 ELSE 2 END + k <= 900 - (spent - cost))) AS part
            FROM r WHERE number <= 6 AND spent > 900 AND spent - cost <= 900),
    sent AS (SELECT user_id, number - 1 AS ordinal, id, start, start + n AS stop, start + n = length AS final FROM r WHERE number <= 6 AND spent <= 900
             UNION ALL SELECT user_id, number - 1, id, start, start + part, false FROM cut WHERE part IS NOT NULL),
    ends AS (SELECT user_id, CASE WHEN (SELECT count(*) FROM r WHERE r.user_id = u.user_id AND number <= 6 AND spent > 900) > 0 THEN 4
             WHEN (SELECT count(*) FROM r WHERE r.user_id = u.user_id AND number > 6) > 0 THEN 7 ELSE 2 END AS reason,
             (SELECT count(*) FROM sent WHERE sent.user_id = u.user_id) AS ordinal FROM (SELECT DISTINCT user_id FROM d) u)
    SELECT user_id, ordinal, id, start, stop, final, NULL::INTEGER AS reason FROM sent
    UNION ALL SELECT user_id, ordinal, NULL, NULL, NULL, NULL, reason FROM ends"""
)
def q_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered demands answered up to 900 bytes or 6 messages a session; the last message may be cut short."""
    e = read_table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 40).alias("id")).agg(F.min("event_id").alias("place"))
    i = F.col("id")
    demands = e.select(
        "user_id", "place", "id", F.lit(0).alias("class"), (40 + i * 37 % 400).alias("length"), F.when(i % 3 > 0, i * 11 % 500).alias("wanted"),
        (i % 7 * 20).alias("known"), (i % 11 == 0).alias("complete"),
    )
    return delivery.deliver(demands, "user_id", "place", 900, 128, 6).drop("class")

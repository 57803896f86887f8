"""Queries of lookups, aggregates, packet orders and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import protocol, samples
from rasterloom.operators import grid, lookup, metrics, packets, ranges
from rasterloom.plans.registry import EVENTS, FRAGMENTS, PIXELS, PLANES, REGIONS, query
from rasterloom.sources.signals import event_lines, fragments, palette, pixels, plane_samples, planes, read_table, regions

_PALETTE = "pal AS (SELECT i AS entry, i * 7 % 256 AS pr, i * 13 % 256 AS pg, 255 - i AS pb FROM range(256) t(i))"


# Lookups and joins


@query(f"WITH {PIXELS}, {_PALETTE} SELECT l_orderkey, l_linenumber, r AS index, pr AS r, pg AS g, pb AS b FROM sig JOIN pal ON r = entry")
def q_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("r").alias("index"))
    return lookup.strict_lookup(px, "index", palette(spark), "entry")


@query(
    f"""WITH {PIXELS}, px AS (SELECT *, row_number() OVER () AS pixel FROM sig)
    SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber,
    coalesce(max(CASE WHEN association = 1 THEN v END), max(CASE WHEN association = 0 AND NOT opacity THEN v END)) AS red,
    coalesce(max(CASE WHEN association = 2 THEN v END), max(CASE WHEN association = 0 AND NOT opacity THEN v END)) AS green,
    max(CASE WHEN opacity THEN v END) AS alpha, count(*) AS n
    FROM (SELECT l_orderkey, l_linenumber, pixel, c, [r, g, b][c + 1] AS v FROM px, range(3) t(c)) s
    JOIN (VALUES (0, 2, false), (1, 1, false), (2, 0, true)) d(channel, association, opacity) ON c = channel GROUP BY pixel"""
)
def q_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components to colours by channel definitions, with opacity, within each pixel's row."""
    definitions = [(0, 2, False), (1, 1, False), (2, 0, True)]
    px = pixels(spark, sf_dir)
    parts = [F.col(c) for c in "rgb"]
    colour = lambda k: lookup.channel_of(parts, definitions, k)
    return px.select(
        "l_orderkey", "l_linenumber", colour(1).alias("red"), colour(2).alias("green"), lookup.opacity_of(parts, definitions).alias("alpha"), F.lit(len(definitions)).cast("long").alias("n")
    )


@query(
    f"""WITH {REGIONS} SELECT req_id, tx AS tile_x, ty AS tile_y, greatest(x, tx * 256) AS x0, greatest(y, ty * 256) AS y0,
    least(x + w, tx * 256 + 256) AS x1, least(y + h, ty * 256 + 256) AS y1
    FROM regions JOIN range(16) a(tx) ON tx * 256 < x + w AND x < tx * 256 + 256 JOIN range(16) b(ty) ON ty * 256 < y + h AND y < ty * 256 + 256"""
)
def q_region_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.clip_to_tile(grid.overlapping_tiles(regions(spark, sf_dir), 256), 256)
    return out.select("req_id", "tile_x", "tile_y", "x0", "y0", "x1", "y1")


@query(
    """WITH t AS (SELECT p_partkey, p_size * 41 AS w, (1 + p_partkey % 30) * 37 AS h, [256, 512][p_partkey % 2 + 1] AS e FROM part),
    u AS (SELECT *, ceil(w / e)::BIGINT AS nx, ceil(h / e)::BIGINT AS ny FROM t)
    SELECT p_partkey, i AS tile, i % nx * e AS x0, i // nx * e AS y0, least(i % nx * e + e, w) AS x1, least(i // nx * e + e, h) AS y1
    FROM (SELECT *, unnest(range(nx * ny)) AS i FROM u)"""
)
def q_tiles_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    edge = F.when(F.col("p_partkey") % 2 == 0, F.lit(256)).otherwise(F.lit(512))
    tiles = grid.nominal_tiles((F.col("p_size") * 41).cast("long"), (1 + F.col("p_partkey") % 30) * 37, edge)
    return p.select("p_partkey", F.inline(tiles))


@query(
    f"""WITH {REGIONS}, cols AS (SELECT bx, bx * 64 AS cx FROM range(64) a(bx)), rws AS (SELECT by_, by_ * 64 AS cy FROM range(64) b(by_))
    SELECT req_id, bx, by_ FROM regions JOIN cols ON cx < x + w + 4 AND x - 4 < cx + 64 JOIN rws ON cy < y + h + 4 AND y - 4 < cy + 64"""
)
def q_codeblock_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code blocks that a window with its halo depends on: enumerated by number, then met by equality."""
    halo = grid.HALO["97"]
    wide = regions(spark, sf_dir).select("req_id", (F.col("x") - halo).alias("x"), (F.col("y") - halo).alias("y"), (F.col("w") + 2 * halo).alias("w"), (F.col("h") + 2 * halo).alias("h"))
    hits = grid.overlapping_tiles(wide, 64).select("req_id", F.col("tile_x").alias("bx"), F.col("tile_y").alias("by_"))
    blocks = spark.range(64 * 64).select((F.col("id") % 64).alias("bx"), F.floor(F.col("id") / 64).alias("by_"))
    return hits.join(lookup.maybe_broadcast(blocks), ["bx", "by_"]).select("req_id", "bx", "by_")


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_suppkey % 7 = 0 THEN 100 + l_suppkey % 5 END, CASE WHEN l_partkey % 3 = 0 THEN 50 + l_partkey % 11 END,
    CASE WHEN o_custkey % 2 = 0 THEN 20 + o_custkey % 9 END, 1) AS step FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""
)
def q_effective_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile component over tile over component over default; rows are matched by a left join on the image."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"], "left")
    step = lookup.effective(
        F.when(F.col("l_suppkey") % 7 == 0, 100 + F.col("l_suppkey") % 5),
        F.when(F.col("l_partkey") % 3 == 0, 50 + F.col("l_partkey") % 11),
        F.when(F.col("o_custkey") % 2 == 0, 20 + F.col("o_custkey") % 9),
        F.lit(1),
    )
    return joined.select("l_orderkey", "l_linenumber", step.alias("step"))


_YCC = """WITH p AS MATERIALIZED (SELECT vec_id, list_transform(embedding[1:64], lambda e: greatest(-128, least(127, floor(e::DOUBLE * 128)))::BIGINT + 128) AS v FROM embeddings),
    j AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v[i + 1] AS luma, v[i // 16 * 8 + i % 8 // 2 + 1] AS cb, v[i // 16 * 8 + i % 8 // 2 + 33] AS cr FROM p, range(64) t(i))"""


@query(f"{_YCC} SELECT vec_id, y, x, luma, cb, cr FROM j")
def q_chroma_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each luma sample with the chroma of its 2 x 2 block; the blocks travel in the plane's own row, so nothing moves."""
    return _ycc(spark, sf_dir)


def _ycc(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cell(v, y, x):
        half_y, half_x = F.floor(y / 2).cast("int"), F.floor(x / 2).cast("int")
        at = lambda r: F.get(F.get("plane", r), half_x)
        return F.struct((v + 128).alias("luma"), (at(half_y) + 128).alias("cb"), (at(half_y + 4) + 128).alias("cr"))

    cells = F.transform("plane", lambda row, y: F.transform(row, lambda v, x: cell(v, y, x)))
    rows = planes(spark, sf_dir).select("vec_id", F.posexplode(cells).alias("y", "row"))
    return rows.select("vec_id", "y", F.posexplode("row").alias("x", "c")).select("vec_id", "y", "x", "c.*")


@query(
    f"""{_YCC} SELECT vec_id, y, x, greatest(0, least(255, round(luma::DOUBLE + 1.402::DOUBLE * (cr::DOUBLE - 128))::BIGINT)) AS r,
    greatest(0, least(255, round(luma::DOUBLE - 0.34413::DOUBLE * (cb::DOUBLE - 128) - 0.71414::DOUBLE * (cr::DOUBLE - 128))::BIGINT)) AS g,
    greatest(0, least(255, round(luma::DOUBLE + 1.772::DOUBLE * (cb::DOUBLE - 128))::BIGINT)) AS b FROM j"""
)
def q_sycc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _ycc(spark, sf_dir)
    rgb = samples.ycc_to_rgb8(F.col("luma"), F.col("cb"), F.col("cr"))
    return s.select("vec_id", "y", "x", *[c.alias(n) for c, n in zip(rgb, "rgb", strict=True)])


@query(
    """WITH req AS (SELECT o_orderkey AS req_id, [o_orderkey % 3, (o_orderkey + 1) % 3] AS comps FROM orders),
    e AS (SELECT req_id, unnest(comps) AS component, unnest([0, 1]) AS pos FROM req)
    SELECT req_id, pos, component, name FROM e JOIN (VALUES (0, 'red'), (1, 'green'), (2, 'blue')) c(id, name) ON component = id"""
)
def q_component_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in the order of the request."""
    k = F.col("o_orderkey")
    req = read_table(spark, sf_dir, "orders").select(k.alias("req_id"), F.posexplode(F.array(k % 3, (k + 1) % 3)).alias("pos", "component"))
    names = F.array(*map(F.lit, ["red", "green", "blue"]))
    return req.withColumn("name", F.get(names, F.col("component").cast("int"))).where("name IS NOT NULL")


@query("SELECT l_orderkey, l_linenumber, l_suppkey % 6 AS resolution, l_partkey % 8 AS layer FROM lineitem WHERE l_suppkey % 6 <= 5 - 2 AND l_partkey % 8 < 3")
def q_resolution_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    out = li.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 6).alias("resolution"), (F.col("l_partkey") % 8).alias("layer"))
    return out.where("resolution <= 5 - 2 AND layer < 3")


@query(
    """WITH idx AS (SELECT DISTINCT l_suppkey AS tile, l_linenumber AS resolution FROM lineitem),
    want AS (SELECT s_suppkey AS tile, r AS resolution FROM supplier, range(1, 8) t(r))
    SELECT w.tile, w.resolution, i.tile IS NOT NULL AS found FROM want w LEFT JOIN idx i ON w.tile = i.tile AND w.resolution = i.resolution"""
)
def q_precinct_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of the wanted precincts; those that are missing are told."""
    idx = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_linenumber").cast("long").alias("resolution")).distinct()
    want = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("resolution"))
    return want.join(idx.withColumn("found", F.lit(True)), ["tile", "resolution"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query(
    f"""WITH {PLANES}, a AS (SELECT * FROM sig WHERE vec_id % 2 = 0), b AS (SELECT vec_id - 1 AS vec_id, y, x, v FROM sig WHERE vec_id % 2 = 1 AND NOT (y = 7 AND vec_id % 10 = 1))
    SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, count(*) FILTER (a.v IS NULL OR b.v IS NULL) AS unmatched, max(abs(a.v - b.v)) AS peak
    FROM a FULL JOIN b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = b.x GROUP BY 1"""
)
def q_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded against reference samples by position; positions that one side lacks are counted."""
    s = plane_samples(planes(spark, sf_dir))
    a = s.where("vec_id % 2 = 0").withColumnRenamed("v", "a")
    b = s.where("vec_id % 2 = 1 AND NOT (y = 7 AND vec_id % 10 = 1)").select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", F.col("v").alias("b"))
    both = lookup.positional_join(a, b, ["vec_id", "y", "x"])
    return both.groupBy("vec_id").agg(F.count_if(~F.col("matched")).alias("unmatched"), F.max(F.abs(F.col("a") - F.col("b"))).alias("peak"))


@query(
    f"""WITH {REGIONS}, t AS (SELECT req_id, w, h, (least(x + w, tx * 256 + 256) - greatest(x, tx * 256)) * (least(y + h, ty * 256 + 256) - greatest(y, ty * 256)) AS area
    FROM regions JOIN range(16) a(tx) ON tx * 256 < x + w AND x < tx * 256 + 256 JOIN range(16) b(ty) ON ty * 256 < y + h AND y < ty * 256 + 256)
    SELECT req_id, count(*) AS tiles, sum(area)::BIGINT AS area, sum(area) = max(w * h) AS whole FROM t GROUP BY req_id"""
)
def q_tile_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a region in its tiles are disjoint and cover it."""
    t = grid.clip_to_tile(grid.overlapping_tiles(regions(spark, sf_dir), 256), 256)
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return t.groupBy("req_id").agg(F.count(F.lit(1)).alias("tiles"), area.alias("area"), (area == F.max(F.col("w") * F.col("h"))).alias("whole"))


# Aggregates

_PAIR = f"""WITH {PLANES}, q AS (SELECT vec_id, v AS a, (sign(v) * floor(abs(v) / 8))::BIGINT * 8 AS b FROM sig),
    e AS (SELECT vec_id, count(*) AS n, max(abs(a - b)) AS peak, sum((a - b) * (a - b))::DOUBLE AS s FROM q GROUP BY vec_id)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plane_samples(planes(spark, sf_dir))
    q = samples.quantise(F.col("v").cast("double"), F.lit(8.0)) * 8
    return s.groupBy("vec_id").agg(*metrics.error_aggregates(F.col("v"), q))


@query(f"{_PAIR} SELECT vec_id, n, peak, s / n AS mse FROM e")
def q_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("vec_id", "n", "peak", metrics.mse(F.col("squares"), F.col("n")).alias("mse"))


@query(f"{_PAIR} SELECT vec_id, s / n / 65025.0::DOUBLE AS nmse FROM e")
def q_nmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("vec_id", metrics.nmse(F.col("squares"), F.col("n"), 8).alias("nmse"))


@query(f"{_PAIR} SELECT vec_id, peak, peak <= 7 AND s / n <= 12 AS pass FROM e")
def q_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("peak") <= 7) & (metrics.mse(F.col("squares"), F.col("n")) <= 12)
    return _errors(spark, sf_dir).select("vec_id", "peak", ok.alias("pass"))


@query(f"WITH {PLANES} SELECT vec_id, y % 2 AS yb, x % 2 AS xb, max(CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END) AS planes FROM sig GROUP BY ALL")
def q_band_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit planes of the largest magnitude by band."""
    s = plane_samples(planes(spark, sf_dir))
    return s.groupBy("vec_id", (F.col("y") % 2).alias("yb"), (F.col("x") % 2).alias("xb")).agg(F.max(samples.magnitude_planes(F.col("v"))).alias("planes"))


@query("SELECT o_custkey, list_reduce(list(1 + o_orderkey % 60), lambda a, b: gcd(a, b))::INT AS spacing FROM orders GROUP BY o_custkey")
def q_gcd_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    seps = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(1 + F.col("o_orderkey") % 60).alias("s"))
    return seps.select("o_custkey", grid.common_divisor(F.col("s")).alias("spacing"))


@query(
    """WITH t AS (SELECT l_suppkey, l_partkey % 5000 AS v FROM lineitem),
    b AS (SELECT l_suppkey, CASE WHEN v = 0 THEN 0 WHEN v = 1 THEN 1 ELSE length(bin(v - 1)) + 1 END AS bucket, count(*) AS n FROM t GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM b)
    SELECT l_suppkey, sum(n)::BIGINT AS reads, min(CASE WHEN run >= greatest(ceil(total * 50 / 100), 1) THEN CASE WHEN bucket = 0 THEN 0 ELSE 1::BIGINT << (bucket - 1) END END) AS p50,
    min(CASE WHEN run >= greatest(ceil(total * 95 / 100), 1) THEN CASE WHEN bucket = 0 THEN 0 ELSE 1::BIGINT << (bucket - 1) END END) AS p95 FROM c GROUP BY l_suppkey"""
)
def q_hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = read_table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 5000).alias("v"))
    return metrics.percentile_bounds(reads, ["l_suppkey"], "v", [50, 95])


@query(
    """SELECT l_suppkey % 10 AS tile, count(*) AS blocks, sum(l_partkey)::BIGINT AS bytes, count(*) FILTER (l_partkey % 64 = 0) AS empty, max(l_partkey) AS largest,
    sum(l_linenumber)::BIGINT AS passes FROM lineitem GROUP BY 1"""
)
def q_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums over code blocks, by tile."""
    return read_table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("tile")).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("l_partkey").alias("bytes"),
        F.count_if(F.col("l_partkey") % 64 == 0).alias("empty"),
        F.max("l_partkey").alias("largest"),
        F.sum("l_linenumber").alias("passes"),
    )


@query(
    """SELECT p_partkey, sum(ceil(bw / 64) * ceil(bh / 64))::BIGINT AS blocks FROM (SELECT p_partkey, p_size * 19 AS w, (1 + p_partkey % 50) * 23 AS h FROM part),
    LATERAL (SELECT * FROM (VALUES (ceil(w / 4), ceil(h / 4)), (floor(ceil(w / 2) / 2), ceil(h / 4)), (ceil(w / 4), floor(ceil(h / 2) / 2)), (floor(ceil(w / 2) / 2), floor(ceil(h / 2) / 2)),
    (floor(w / 2), ceil(h / 2)), (ceil(w / 2), floor(h / 2)), (floor(w / 2), floor(h / 2))) b(bw, bh)) GROUP BY p_partkey"""
)
def q_codeblock_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 64 blocks of the seven bands of two levels."""
    w, h = (F.col("p_size") * 19).cast("long"), (1 + F.col("p_partkey") % 50) * 23
    half = lambda n: (samples.ceil_div(n, 2), F.floor(n / 2).cast("long"))
    (lw, hw), (lh, hh) = half(w), half(h)
    (llw, lhw), (llh, lhh) = half(lw), half(lh)
    bands = [(llw, llh), (lhw, llh), (llw, lhh), (lhw, lhh), (hw, lh), (lw, hh), (hw, hh)]
    total = sum((grid.code_blocks(a, b) for a, b in bands[1:]), grid.code_blocks(*bands[0]))
    return read_table(spark, sf_dir, "part").select("p_partkey", total.alias("blocks"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS place, 1 + l_suppkey % 5 AS passes, l_partkey AS size FROM lineitem),
    d AS (SELECT DISTINCT * FROM s), f AS (SELECT *, coalesce(sum(passes) OVER (PARTITION BY l_orderkey ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d)
    SELECT l_orderkey, coalesce(sum(size) FILTER (NOT (first >= 10 AND first % 3 <> 0)), 0)::BIGINT AS mq_bytes, coalesce(sum(size) FILTER (first >= 10 AND first % 3 <> 0), 0)::BIGINT AS raw_bytes
    FROM f GROUP BY l_orderkey"""
)
def q_segment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")
    s = read_table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("at"), (1 + F.col("l_suppkey") % 5).alias("passes"), F.col("l_partkey").alias("size")).distinct()
    return packets.mq_or_raw(s, ["l_orderkey"], "at")


# Packet orders

_PACKETS = """packets AS (SELECT DISTINCT l_orderkey, l_suppkey % 3 AS layer, l_partkey % 4 AS resolution, l_linenumber % 3 AS component, l_partkey % 7 * 64 AS y, l_suppkey % 5 * 64 AS x
    FROM lineitem)"""


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        "l_orderkey", (s % 3).alias("layer"), (p % 4).alias("resolution"), (F.col("l_linenumber") % 3).alias("component"), (p % 7 * 64).alias("y"), (s % 5 * 64).alias("x")
    ).distinct()


def _ordered(name: str):
    columns = ", ".join(packets.PROGRESSIONS[name])

    @query(f"WITH {_PACKETS} SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {columns}) - 1 AS seq FROM packets")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return packets.sequence_packets(_packets(spark, sf_dir), ["l_orderkey"], name)

    return run


def _register_orders() -> None:
    from rasterloom.plans.registry import ORACLE_SQL, QUERIES

    for name in packets.PROGRESSIONS:
        key = f"q_order_{name.lower()}"
        QUERIES[key] = _ordered(name)
        ORACLE_SQL[key] = ORACLE_SQL.pop("run")
        del QUERIES["run"]


_register_orders()

_VOLUMES = [(0, 2, 1, 0, 3), (1, 4, 2, 0, 2), (2, 4, 3, 1, 3)]


@query(
    f"""WITH {_PACKETS}, v(volume, res_end, layer_end, comp_start, comp_end) AS (VALUES (0, 2, 1, 0, 3), (1, 4, 2, 0, 2), (2, 4, 3, 1, 3))
    SELECT l_orderkey, layer, resolution, component, y, x, min(volume) AS volume FROM packets JOIN v ON resolution < res_end AND layer < layer_end
    AND component >= comp_start AND component < comp_end GROUP BY ALL"""
)
def q_poc_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.first_volume(_packets(spark, sf_dir), _VOLUMES, ["l_orderkey", "layer", "resolution", "component", "y", "x"])


@query(
    """SELECT user_id, event_id, length(props) AS size, coalesce(sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at
    FROM events"""
)
def q_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.length("props").alias("size"))
    return e.withColumn("at", packets.running_offset(F.col("size"), ["user_id"], ["event_id"]))


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS event_type FROM events GROUP BY user_id")
def q_ordered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.assemble(read_table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query(
    """WITH c AS (SELECT user_id, event_id, 4096 + event_id % 61440 AS coarseness, length(props) * 3 AS size FROM events WHERE length(props) * 3 <= 120)
    SELECT user_id, arg_max(coarseness, (size, -event_id)) AS coarseness, max(size) AS size, 120 - max(size) <= 32 AS success FROM c GROUP BY user_id"""
)
def q_rate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidates within a budget the largest; the first wins ties."""
    budget = 120
    c = read_table(spark, sf_dir, "events").select("user_id", "event_id", (4096 + F.col("event_id") % 61440).alias("coarseness"), (F.length("props") * 3).alias("size"))
    best = c.where(F.col("size") <= budget).groupBy("user_id").agg(
        F.max_by("coarseness", F.struct(F.col("size"), -F.col("event_id"))).alias("coarseness"), F.max("size").alias("size")
    )
    return best.withColumn("success", budget - F.col("size") <= max(32, -(-budget // 500)))


@query(
    """SELECT user_id, event_id, size, sent FROM (SELECT user_id, event_id, length(props) + 5 AS size, sum(length(props) + 5) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS sent FROM events)
    WHERE sent <= 1000"""
)
def q_limited_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", (F.length("props") + 5).alias("size"))
    return packets.within_limit(e, ["user_id"], ["event_id"], "size", 1000)


@query("SELECT user_id, arg_min(event_type, last) AS victim FROM (SELECT user_id, event_type, max(event_id) AS last FROM events WHERE event_type <> 'click' GROUP BY ALL) GROUP BY user_id")
def q_lru_victim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least recently used key of each session, but for the one in use."""
    used = read_table(spark, sf_dir, "events").where("event_type <> 'click'").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return used.groupBy("user_id").agg(F.min_by("event_type", "last").alias("victim"))


# Ranges and caches

_MERGED = f"""WITH {FRAGMENTS}, o AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS opens FROM fragments
    WINDOW w AS (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM o),
    merged AS (SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, grp)"""


@query(f"{_MERGED} SELECT * FROM merged")
def q_range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.merge_ranges(fragments(spark, sf_dir), ["k"])


@query(
    f"""{_MERGED}, p AS (SELECT k, coalesce(max(CASE WHEN s = 0 THEN e END), 0) AS prefix, max(e) AS last FROM merged GROUP BY k)
    SELECT k, prefix, CASE WHEN prefix = CASE WHEN k % 2 = 0 THEN prefix ELSE last END THEN 'complete' WHEN prefix > 0 THEN 'prefix:' || prefix ELSE 'none' END AS state FROM p"""
)
def q_cache_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranges.merge_ranges(fragments(spark, sf_dir), ["k"])
    last = merged.groupBy("k").agg(F.coalesce(F.max(F.when(F.col("s") == 0, F.col("e"))), F.lit(0)).alias("prefix"), F.max("e").alias("last"))
    final = F.when(F.col("k") % 2 == 0, F.col("prefix")).otherwise(F.col("last"))
    return last.select("k", "prefix", ranges.model_state(F.col("prefix"), final).alias("state"))


@query(
    """WITH d AS (SELECT o_orderkey, o_custkey, o_orderkey % 500 AS wanted, 300 AS length FROM orders), m AS (SELECT c_custkey, c_custkey % 400 AS known, c_custkey % 9 = 0 AS complete FROM customer WHERE c_custkey % 2 = 0),
    j AS (SELECT o_orderkey, least(coalesce(known, 0), length) AS start, least(wanted, length) AS stop, coalesce(complete, false) AS complete, length FROM d LEFT JOIN m ON o_custkey = c_custkey)
    SELECT o_orderkey, start, stop FROM j WHERE NOT (complete OR (start >= stop AND stop < length))"""
)
def q_demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("bin"), (F.col("o_orderkey") % 500).alias("wanted"), F.lit(300).alias("length"))
    c = F.col("c_custkey")
    model = read_table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(c.alias("bin"), (c % 400).alias("known"), (c % 9 == 0).alias("complete"))
    return ranges.plan_demands(d, model, ["bin"]).select("o_orderkey", "start", "stop")


@query(
    """WITH t AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN '0' ELSE event_type END AS tid FROM events),
    c AS (SELECT *, CASE WHEN lag(tid) OVER w IS NULL OR tid <> lag(tid) OVER w OR tid = '0' THEN 1 ELSE 0 END AS ch FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, tid, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS generation FROM c"""
)
def q_identity_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tid = F.when(F.col("event_type") == "click", F.lit("0")).otherwise(F.col("event_type"))
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", tid.alias("tid"))
    return ranges.generations(e, ["user_id"], "event_id", "tid")


@query(
    f"""{_MERGED}, want AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_orderkey * 10 + 2 AS a, l_orderkey * 10 + 6 AS b FROM lineitem)
    SELECT w.k, w.l_orderkey, w.a, w.b, m.s, m.e FROM want w JOIN merged m ON w.k = m.k AND m.s <= w.a AND m.e >= w.b"""
)
def q_cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that one merged range covers, of every row."""
    merged = ranges.merge_ranges(fragments(spark, sf_dir), ["k"])
    at = F.col("l_orderkey") * 10
    want = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", (at + 2).alias("a"), (at + 6).alias("b"))
    return ranges.covered_reads(want, merged, ["k"]).select("k", "l_orderkey", "a", "b", "s", "e")


@query("SELECT o_orderkey, o_custkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_custkey % 4 = o_orderkey % 3 AS keeps FROM orders")
def q_model_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tid, actual = (F.col("o_custkey") % 4).cast("string"), (F.col("o_orderkey") % 3).cast("string")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", protocol.model_applies(tid, actual).alias("keeps"))


@query(
    """SELECT user_id, count(*) > count(DISTINCT event_type) AS repeated, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id"""
)
def q_duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a list of demands names a key twice."""
    g = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg((F.sum("n") > F.count(F.lit(1))).alias("repeated"), F.count(F.lit(1)).alias("kinds"))


# Containers


@query(
    """SELECT c_custkey, printf('%08X', 8 + strlen(c_name)) || hex(encode('xml ')) || hex(encode(c_name)) AS box,
    '0000000C' || hex(encode('jP  ')) || '0D0A870A' AS signature, printf('%08X', 22) || hex(encode('ihdr')) || printf('%08X', 1 + c_custkey % 500) || printf('%08X', 1 + c_custkey % 300) || '00030707' || '0000' AS header
    FROM customer"""
)
def q_box_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.sources import boxes

    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    header = boxes.image_header(1 + k % 500, 1 + k % 300, F.lit(3), F.lit(8))
    return c.select(
        "c_custkey",
        F.hex(boxes.write_box("xml ", F.encode("c_name", "UTF-8"))).alias("box"),
        F.hex(boxes.signature()).alias("signature"),
        F.hex(header).alias("header"),
    )


@query(
    """SELECT c_custkey, unnest([0, 1, 2, 3]) AS ordinal, unnest(['jP  ', 'ihdr', 'xml ', 'uuid']) AS type, unnest([0, 12, 34, 42 + strlen(c_name)])::BIGINT AS at,
    unnest([4, 14, strlen(c_name), 3])::BIGINT AS size FROM customer"""
)
def q_box_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that were written by expressions, read back by the parser."""
    from rasterloom.sources import boxes

    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    header = boxes.image_header(1 + k % 500, 1 + k % 300, F.lit(3), F.lit(8))
    last = boxes.write_box("uuid", F.unhex(F.lit("010203")))
    data = F.concat(boxes.signature(), header, boxes.write_box("xml ", F.encode("c_name", "UTF-8")), last)
    return boxes.parse_boxes(c.select("c_custkey", data.alias("payload")), "c_custkey", "payload")


@query(
    """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ['ftyp', 'jP  ', 'jp2h'] WHEN c_custkey % 7 = 0 THEN ['jP  ', 'ftyp', 'jp2h', 'jp2h'] ELSE ['jP  ', 'ftyp', 'jp2h', 'jp2c'] END AS t FROM customer)
    SELECT c_custkey, CASE WHEN t[1] <> 'jP  ' THEN 'signature first' WHEN t[2] <> 'ftyp' THEN 'file type second' WHEN len(list_filter(t, lambda x: x = 'jp2h')) <> 1 THEN 'one header' WHEN NOT list_contains(t, 'jp2c') THEN 'no codestream' ELSE 'ok' END AS status FROM b"""
)
def q_box_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.sources import boxes

    k = F.col("c_custkey")
    types = (
        F.when(k % 5 == 0, F.array(*map(F.lit, ["ftyp", "jP  ", "jp2h"])))
        .when(k % 7 == 0, F.array(*map(F.lit, ["jP  ", "ftyp", "jp2h", "jp2h"])))
        .otherwise(F.array(*map(F.lit, ["jP  ", "ftyp", "jp2h", "jp2c"])))
    )
    return read_table(spark, sf_dir, "customer").select("c_custkey", boxes.order_status(types).alias("status"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'jp2' ELSE 'jph' END AS kind, 1 + c_custkey % 500 AS height, 1 + c_custkey % 300 AS width, 3::BIGINT AS components,
    CASE WHEN c_custkey % 3 > 0 THEN 8::BIGINT END AS bits, CASE WHEN c_custkey % 3 = 0 THEN [8, 12, 1 + c_custkey % 38] END AS depths,
    'enumerated' AS method, CASE c_custkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 18 ELSE 16 END::BIGINT AS space, strlen(c_name)::BIGINT AS stream_bytes,
    ['xml ', 'zzzz'] AS metadata, c_name AS note, 'ok' AS status FROM customer"""
)
def q_box_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole containers, written by expressions; fields, metadata and status read back."""
    from rasterloom.sources import boxes, containers

    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.encode("c_name", "UTF-8")
    varying = k % 3 == 0
    header = boxes.image_header(1 + k % 500, 1 + k % 300, F.lit(3), F.when(varying, 256).otherwise(8))
    depths = boxes.bits_per_component(F.array(F.lit(8), F.lit(12), (1 + k % 38).cast("int")), F.array(*[F.lit(False)] * 3))
    colour = F.when(k % 4 == 1, boxes.colour_specification(containers.SYCC)).otherwise(boxes.colour_specification(containers.SRGB))
    second = boxes.colour_specification(containers.GREY)
    inner = F.concat(header, F.when(varying, depths).otherwise(F.unhex(F.lit(""))), colour, second, boxes.write_box("zzzz", F.unhex(F.lit("01"))))
    kind = F.when(k % 2 == 0, boxes.file_type("jp2 ")).otherwise(boxes.file_type("jph "))
    payload = F.concat(boxes.signature(), kind, boxes.write_box("xml ", name), boxes.header_superbox(inner), boxes.codestream(name))
    found = containers.parse_containers(c.select("c_custkey", payload.alias("payload")), "c_custkey", "payload")
    return found.select(
        "c_custkey", "kind", "header.height", "header.width", "header.components", "header.bits",
        F.when(F.size("depths.depths") > 0, F.transform("depths.depths", lambda d: d["bits"])).alias("depths"),
        "colour.method", "colour.space", F.get("codestreams", F.lit(0))["size"].alias("stream_bytes"),
        F.transform("metadata", lambda m: m["type"]).alias("metadata"), F.decode(F.get("metadata", F.lit(0))["data"], "UTF-8").alias("note"), "status",
    )


@query(
    """WITH t AS (SELECT p_partkey, p_partkey % 5 AS entries, p_size % 4 AS columns, p_partkey % 3 - 1 AS extra FROM part)
    SELECT p_partkey, CASE WHEN entries = 0 THEN 'palette entries' WHEN columns = 0 THEN 'palette columns' WHEN extra <> 0 THEN 'palette length'
    WHEN p_partkey % 7 = 0 THEN 'palette padding' ELSE 'ok' END AS palette,
    CASE WHEN p_partkey % 4 = 3 THEN 'mapped component' WHEN p_partkey % 6 = 5 THEN 'mapping type' WHEN p_partkey % 6 = 0 AND p_size % 5 > 0 THEN 'direct mapping with a column'
    WHEN p_partkey % 6 BETWEEN 1 AND 4 AND p_size % 5 >= 3 THEN 'palette column' ELSE 'ok' END AS mapping FROM t JOIN part USING (p_partkey)"""
)
def q_palette_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of 7-bit columns and mappings of one channel, some of them against the rules."""
    from rasterloom.sources import boxes, containers

    p = read_table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    entries, columns = k % 5, size % 4
    cells = F.greatest(F.lit(0).cast("long"), entries * columns + k % 3 - 1)
    value = F.when(k % 7 == 0, "FF").otherwise("7F")
    palette = F.concat(boxes.u16(entries), boxes.u8(columns), F.unhex(F.repeat(F.lit("06"), columns.cast("int"))), F.unhex(F.repeat(value, cells.cast("int"))))
    kind = F.when(k % 6 == 0, 0).when(k % 6 == 5, 2).otherwise(1)
    mapping = F.concat(boxes.u16(k % 4), boxes.u8(kind), boxes.u8(size % 5))
    found = p.select("p_partkey", palette.alias("palette"), mapping.alias("mapping"))
    return found.select(
        "p_partkey", containers.palette_fields(F.col("palette"))["status"].alias("palette"), containers.mapping_fields(F.col("mapping"), F.lit(3), F.lit(3))["status"].alias("mapping")
    )


@query(
    """WITH t AS (SELECT o_orderkey, [o_orderkey % 4, o_custkey % 4, 2] AS ch, [0, [0, 0, 1, 5][o_orderkey % 4 + 1], [0, 1, 2, 65535][o_custkey % 4 + 1]] AS kind,
      [o_orderkey % 3, o_custkey % 5, o_orderkey % 2] AS assoc FROM orders),
    e AS (SELECT *, list_zip(ch, kind, assoc) AS e FROM t),
    a AS (SELECT *, list_filter(e, lambda x: x[2] IN (1, 2)) AS alphas, list_filter(e, lambda x: x[2] = 0) AS colours FROM e)
    SELECT o_orderkey, CASE WHEN len(list_filter(e, lambda x: x[1] > 2)) > 0 THEN 'unknown channel'
    WHEN len(list_filter(e, lambda x: x[2] NOT IN (0, 1, 2, 65535))) > 0 THEN 'channel type'
    WHEN len(list_filter(e, lambda x: x[2] = 0 AND x[3] = 0)) > 0 THEN 'colour without association'
    WHEN len(list_filter(e, lambda x: x[2] <> 65535 AND x[3] > 3)) > 0 THEN 'association beyond the colours'
    WHEN len(list_filter(alphas, lambda x: x[1] = 2)) > 0 THEN 'signed opacity'
    WHEN len(list_distinct(list_transform(e, lambda x: [x[2], x[3]]))) < 3 THEN 'repeated meaning'
    WHEN len(alphas) = 2 AND alphas[1][3] = alphas[2][3] THEN 'mixed opacity'
    WHEN len(list_filter(alphas, lambda x: x[3] = 0)) > 0 AND len(list_filter(alphas, lambda x: x[3] > 0)) > 0 THEN 'opacity of whole and part'
    WHEN len(list_distinct(ch)) < 3 THEN 'undescribed channel'
    WHEN len(list_distinct(list_transform(colours, lambda x: x[3]))) < 3 THEN 'undescribed colour' ELSE 'ok' END AS status FROM a"""
)
def q_cdef_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel definitions of three channels (the last is signed) in a colour space of three."""
    from rasterloom.sources import boxes, containers

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    rows = [(k % 4, F.lit(0), k % 3), (c % 4, pick([0, 0, 1, 5], k), c % 5), (F.lit(2), pick([0, 1, 2, 65535], c), k % 2)]
    data = F.concat(boxes.u16(F.lit(3)), *[boxes.u16(v) for row in rows for v in row])
    signed = F.array(F.lit(False), F.lit(False), F.lit(True))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", data.alias("data"))
    return o.select("o_orderkey", containers.channel_fields(F.col("data"), signed, F.lit(3), F.lit(False))["status"].alias("status"))


@query(f"WITH {EVENTS} SELECT user_id, count(*) AS n, sum(v)::BIGINT AS total, max(v) AS peak FROM sig GROUP BY user_id")
def q_work_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked sums and ceilings of counters; an overflow is an error in ANSI mode."""
    return event_lines(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("peak"))

"""Queries of projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import contexts, limits, protocol, samples
from rasterloom.plans.registry import EVENTS, PIXELS, PLANES, REAL_PLANES, REGIONS, query
from rasterloom.sources.signals import event_lines, pixels, plane_samples, planes, read_table, regions

ID = ("l_orderkey", "l_linenumber")


@query(f"WITH {PIXELS} SELECT l_orderkey, l_linenumber, r - 128 AS r, g - 128 AS g, b - 128 AS b FROM sig")
def q_level_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*ID, *[samples.level_shift(F.col(c), 8).alias(c) for c in "rgb"])


@query(f"WITH {EVENTS} SELECT user_id, i, greatest(0, least(255, v - 200 + 128)) AS packed FROM sig")
def q_clamp_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select("user_id", "i", samples.unshift_clamped(F.col("v") - 200).alias("packed"))


@query(f"WITH {PIXELS} SELECT l_orderkey, l_linenumber, (r + 2 * g + b) >> 2 AS y, b - g AS db, r - g AS dr FROM sig")
def q_rct_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, db, dr = samples.rct(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, sf_dir).select(*ID, y.alias("y"), db.alias("db"), dr.alias("dr"))


@query(f"WITH {PIXELS} SELECT l_orderkey, l_linenumber, r, g, b, true AS exact FROM sig")
def q_rct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    y, db, dr = samples.rct(F.col("r"), F.col("g"), F.col("b"))
    r, g, b = samples.inverse_rct(y, db, dr)
    same = (r == F.col("r")) & (g == F.col("g")) & (b == F.col("b"))
    return p.select(*ID, r.alias("r"), g.alias("g"), b.alias("b"), same.alias("exact"))


@query(
    f"""WITH {PIXELS} SELECT l_orderkey, l_linenumber, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y,
    -0.16875::DOUBLE * r + -0.33126::DOUBLE * g + 0.5::DOUBLE * b AS cb, 0.5::DOUBLE * r + -0.41869::DOUBLE * g + -0.08131::DOUBLE * b AS cr FROM sig"""
)
def q_ict_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, cb, cr = samples.ict(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, sf_dir).select(*ID, y.alias("y"), cb.alias("cb"), cr.alias("cr"))


@query(
    f"""WITH {PIXELS}, t AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y,
    -0.16875::DOUBLE * r + -0.33126::DOUBLE * g + 0.5::DOUBLE * b AS cb, 0.5::DOUBLE * r + -0.41869::DOUBLE * g + -0.08131::DOUBLE * b AS cr FROM sig)
    SELECT l_orderkey, l_linenumber, round(y + 1.402::DOUBLE * cr)::BIGINT AS r,
    round(y - 0.34413::DOUBLE * cb - 0.71414::DOUBLE * cr)::BIGINT AS g, round(y + 1.772::DOUBLE * cb)::BIGINT AS b FROM t"""
)
def q_ict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = samples.inverse_ict(*samples.ict(F.col("r"), F.col("g"), F.col("b")))
    return pixels(spark, sf_dir).select(*ID, *[F.round(c).cast("long").alias(n) for c, n in zip(back, "rgb", strict=True)])


@query(
    """SELECT l_orderkey, l_linenumber, (1.0::DOUBLE + (l_partkey % 2048) / 2048.0::DOUBLE) * pow(2.0::DOUBLE, (8 + l_linenumber % 3 - l_suppkey % 32)::DOUBLE) AS delta
    FROM lineitem"""
)
def q_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    delta = samples.step_size(F.col("l_partkey") % 2048, F.col("l_suppkey") % 32, F.lit(8), F.col("l_linenumber") % 3)
    return li.select(*ID, delta.alias("delta"))


@query(f"WITH {REAL_PLANES} SELECT vec_id, y, x, (sign(v) * floor(abs(v) / 3.25::DOUBLE))::BIGINT AS q FROM sig")
def q_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plane_samples(planes(spark, sf_dir, whole=False))
    return s.select("vec_id", "y", "x", samples.quantise(F.col("v"), F.lit(3.25)).alias("q"))


@query(f"WITH {PLANES} SELECT vec_id, y, x, (v * 65536) / pow(2.0::DOUBLE, 22.0::DOUBLE) * (0.5::DOUBLE * 3.25::DOUBLE) AS v FROM sig")
def q_dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plane_samples(planes(spark, sf_dir))
    return s.select("vec_id", "y", "x", samples.dequantise((F.col("v") * 65536).cast("double"), F.lit(8), F.lit(3.25)).alias("v"))


@query(
    f"""WITH {PLANES}, t AS (SELECT vec_id, y, x, v * 4096 AS c FROM sig)
    SELECT vec_id, y, x, abs(c) >= 131072 AS inside, CASE WHEN abs(c) >= 131072 THEN sign(c)::BIGINT * (abs(c) >> 16) END AS restored FROM t"""
)
def q_maxshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plane_samples(planes(spark, sf_dir))
    inside, restored = samples.maxshift_restore(F.col("v") * 4096, available=18, shift=4)
    return s.select("vec_id", "y", "x", inside.alias("inside"), restored.alias("restored"))


@query(
    f"""WITH {PLANES} SELECT vec_id, y, x, CASE WHEN v < 0 THEN -(abs(v) >> 3) ELSE abs(v) >> 3 END AS transferred,
    CASE WHEN v < 0 THEN -(abs(v) >> 2) ELSE abs(v) >> 2 END AS from_word FROM sig"""
)
def q_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plane_samples(planes(spark, sf_dir))
    word = F.abs("v") + F.when(F.col("v") < 0, F.lit(1 << 31)).otherwise(F.lit(0))
    return s.select(
        "vec_id", "y", "x", samples.toward_zero_shift(F.col("v"), 3).alias("transferred"), samples.sign_magnitude_shift(word, 2).alias("from_word")
    )


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey AS m, 1 + l_linenumber % 7 AS n, l_suppkey % 2 AS e FROM lineitem),
    u AS (SELECT *, (((m & ((1::BIGINT << n) - 1)) | (e << n) | 1) + 2) * (1::BIGINT << 17) AS size FROM t)
    SELECT l_orderkey, l_linenumber, CASE WHEN m & 1 = 1 THEN -size ELSE size END AS coefficient FROM u"""
)
def q_rebuild_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    c = samples.rebuild_cleanup(F.col("l_partkey"), 1 + F.col("l_linenumber") % 7, F.col("l_suppkey") % 2, 12)
    return li.select(*ID, c.alias("coefficient"))


@query(f"WITH {EVENTS} SELECT user_id, i, (v * 37 - 4096) >> 4 AS v FROM sig")
def q_precision_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select("user_id", "i", samples.reduce_precision(F.col("v") * 37 - 4096, 12, 8).alias("v"))


@query(
    """WITH t AS (SELECT c_custkey, ('0x' || hex(encode(substr(c_name, 1, 1))))::BIGINT AS a, ('0x' || hex(encode(substr(c_name, 2, 1))))::BIGINT AS b,
    ('0x' || substr(md5(c_name), 1, 2))::BIGINT AS p, ('0x' || substr(md5(c_name), 3, 2))::BIGINT AS q FROM customer)
    SELECT c_custkey, a AS u8, a * 256 + b AS u16_be, b * 256 + a AS u16_le,
    CASE WHEN p * 256 + q >= 32768 THEN p * 256 + q - 65536 ELSE p * 256 + q END AS i16_be FROM t"""
)
def q_sample_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    data, digest = F.encode("c_name", "UTF-8"), F.unhex(F.md5(F.encode("c_name", "UTF-8")))
    return c.select(
        "c_custkey",
        samples.decode_sample(data, 0, 1).alias("u8"),
        samples.decode_sample(data, 0, 2).alias("u16_be"),
        samples.decode_sample(data, 0, 2, little=True).alias("u16_le"),
        samples.decode_sample(digest, 0, 2, signed=True).alias("i16_be"),
    )


@query(
    f"""WITH {REGIONS}, t AS (SELECT *, 1 + req_id % 4 AS s FROM regions)
    SELECT req_id, ceil(x / s)::BIGINT AS x0, ceil(y / s)::BIGINT AS y0, ceil((x + w) / s)::BIGINT AS x1, ceil((y + h) / s)::BIGINT AS y1,
    ceil(x / s) < ceil((x + w) / s) AND ceil(y / s) < ceil((y + h) / s) AS ok FROM t"""
)
def q_grid_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).withColumn("s", 1 + F.col("req_id") % 4)
    ends = {"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h")}
    out = r.select("req_id", *[samples.ceil_div(v, F.col("s")).alias(k) for k, v in ends.items()])
    return out.withColumn("ok", F.expr("x0 < x1 AND y0 < y1"))


@query(
    f"""WITH {REGIONS} SELECT req_id, d, ceil(x / (1 << d))::BIGINT AS x0, ceil(y / (1 << d))::BIGINT AS y0,
    ceil((x + w) / (1 << d))::BIGINT AS x1, ceil((y + h) / (1 << d))::BIGINT AS y1 FROM regions, range(0, 4) t(d)"""
)
def q_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(3))))
    two = F.pow(F.lit(2), F.col("d")).cast("long")
    ends = {"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h")}
    return r.select("req_id", "d", *[samples.ceil_div(v, two).alias(k) for k, v in ends.items()])


@query(
    f"""WITH {REGIONS} SELECT req_id, CASE WHEN x % 2 = 0 THEN (w + 1) // 2 ELSE w // 2 END AS low,
    w - CASE WHEN x % 2 = 0 THEN (w + 1) // 2 ELSE w // 2 END AS high FROM regions"""
)
def q_low_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = samples.low_count(F.col("w"), F.col("x"))
    return regions(spark, sf_dir).select("req_id", low.alias("low"), (F.col("w") - low).alias("high"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_partkey % 64 % 3 WHEN 0 THEN 'cleanup' WHEN 1 THEN 'significance' ELSE 'refinement' END AS pass,
    l_partkey % 64 >= 10 AND l_partkey % 64 % 3 <> 0 AND l_suppkey % 2 = 0 AS raw,
    CASE WHEN l_partkey % 64 < 10 THEN 10 - l_partkey % 64 WHEN (l_partkey % 64 - 10) % 3 = 0 THEN 2 ELSE 1 END AS capacity FROM lineitem"""
)
def q_raw_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_partkey") % 64
    return read_table(spark, sf_dir, "lineitem").select(
        *ID, contexts.coding_pass(i).alias("pass"), contexts.is_raw_pass(i, F.col("l_suppkey") % 2 == 0).alias("raw"), contexts.pass_capacity(i).alias("capacity")
    )


_NEAR = """t AS (SELECT l_orderkey, l_linenumber, ['LL', 'LH', 'HL', 'HH'][l_suppkey % 4 + 1] AS band, l_partkey % 3 AS h, l_orderkey % 3 AS v,
    l_linenumber % 5 AS d FROM lineitem),
    u AS (SELECT *, CASE WHEN band = 'HL' THEN v ELSE h END AS a, CASE WHEN band = 'HL' THEN h ELSE v END AS b FROM t)"""


@query(
    f"""WITH {_NEAR} SELECT l_orderkey, l_linenumber, band, CASE WHEN band = 'HH' THEN
        CASE WHEN d >= 3 THEN 8 WHEN d = 2 THEN CASE WHEN h + v >= 1 THEN 7 ELSE 6 END WHEN d = 1 THEN 3 + least(h + v, 2) ELSE least(h + v, 2) END
    ELSE CASE WHEN a = 2 THEN 8 WHEN a = 1 THEN CASE WHEN b >= 1 THEN 7 WHEN d >= 1 THEN 6 ELSE 5 END
        WHEN b = 2 THEN 4 WHEN b = 1 THEN 3 ELSE least(d, 2) END END AS context FROM u"""
)
def q_zero_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    band = F.element_at(F.array(*[F.lit(b) for b in ("LL", "LH", "HL", "HH")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    near = li.select(*ID, band.alias("band"), (F.col("l_partkey") % 3).alias("h"), (F.col("l_orderkey") % 3).alias("v"), (F.col("l_linenumber") % 5).alias("d"))
    return near.select(*ID, "band", contexts.zero_context(F.col("band"), F.col("h"), F.col("v"), F.col("d")).alias("context"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, greatest(-1, least(1, l_partkey % 5 - 2)) AS h, greatest(-1, least(1, l_suppkey % 5 - 2)) AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN h = 0 THEN CASE WHEN v = 0 THEN 9 ELSE 10 END WHEN h * v > 0 THEN 13 WHEN v = 0 THEN 12 ELSE 11 END AS context,
    CASE WHEN h < 0 OR (h = 0 AND v < 0) THEN 1 ELSE 0 END AS flip FROM t"""
)
def q_sign_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, flip = contexts.sign_context(F.col("l_partkey") % 5 - 2, F.col("l_suppkey") % 5 - 2)
    return read_table(spark, sf_dir, "lineitem").select(*ID, label.alias("context"), flip.alias("flip"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN 16 ELSE 14 + least(l_suppkey % 3, 1) END AS context FROM lineitem")
def q_refinement_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = contexts.refinement_context(F.col("l_partkey") % 4 == 0, F.col("l_suppkey") % 3)
    return read_table(spark, sf_dir, "lineitem").select(*ID, label.alias("context"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN 1 + l_suppkey % 100 <= 64 AND CASE WHEN l_linenumber % 2 = 0
    THEN (1 + l_suppkey % 100) * 16 <= (l_partkey % 200) * 32 ELSE (1 + l_suppkey % 100) * 32 <= (l_partkey % 200) * 5 END THEN 'dense' ELSE 'checked' END AS backend
    FROM lineitem"""
)
def q_backend_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = 1 + F.col("l_suppkey") % 100
    out = contexts.dense_backend(width, width * 16, F.col("l_partkey") % 200, F.col("l_linenumber") % 2 == 0)
    return read_table(spark, sf_dir, "lineitem").select(*ID, out.alias("backend"))


@query(
    """WITH t AS (SELECT p_partkey, p_partkey % 80 AS s FROM part)
    SELECT p_partkey, CASE WHEN s < 64 THEN array_to_string(list_filter(['bypass', 'reset', 'terminate', 'causal', 'predictable', 'segmentation'],
    lambda n, i: (s >> (i - 1)) & 1 = 1), ',') END AS styles FROM t"""
)
def q_style_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", contexts.style_names(F.col("p_partkey") % 80).alias("styles"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 3 + l_linenumber % 3) * 256 + l_suppkey % 256 AS precinct FROM lineitem")
def q_precinct_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = protocol.precinct_id(F.col("l_partkey"), F.col("l_linenumber") % 3, F.col("l_suppkey") % 256, F.lit(3), F.lit(256))
    return read_table(spark, sf_dir, "lineitem").select(*ID, p.alias("precinct"))


@query(
    """WITH t AS (SELECT o_orderkey, o_orderkey % 9 AS c, o_custkey % 3 AS id FROM orders)
    SELECT o_orderkey, CASE WHEN c IN (0, 1) THEN 0 WHEN c IN (2, 8) THEN c WHEN c = 6 AND id = 0 THEN 6 END AS class FROM t"""
)
def q_bin_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", protocol.bin_class(F.col("o_orderkey") % 9, F.col("o_custkey") % 3).alias("class"))


@query(
    """WITH t AS (SELECT o_orderkey, o_orderkey * o_custkey % 300000000 AS v FROM orders)
    SELECT o_orderkey, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS size,
    CASE WHEN v >= 268435456 THEN printf('%02X', 128 + (v >> 28)) ELSE '' END || CASE WHEN v >= 2097152 THEN printf('%02X', 128 + (v >> 21) % 128) ELSE '' END
    || CASE WHEN v >= 16384 THEN printf('%02X', 128 + (v >> 14) % 128) ELSE '' END || CASE WHEN v >= 128 THEN printf('%02X', 128 + (v >> 7) % 128) ELSE '' END
    || printf('%02X', v % 128) AS bytes FROM t"""
)
def q_vbas_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_orderkey") * F.col("o_custkey") % 300000000
    return read_table(spark, sf_dir, "orders").select("o_orderkey", protocol.vbas_size(v).alias("size"), protocol.vbas_bytes(v).alias("bytes"))


@query("SELECT p_partkey, url_encode(p_name || '/' || p_type || '+é') AS coded, p_name || '/' || p_type || '+é' AS back FROM part")
def q_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("/", "p_name", F.concat("p_type", F.lit("+é")))
    p = read_table(spark, sf_dir, "part").select("p_partkey", protocol.percent_encode(text).alias("coded"))
    return p.withColumn("back", protocol.percent_decode(F.col("coded")))


_MODEL = """models AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Hm' ELSE 'H' || o_custkey END || ',P' || o_orderkey || ':' || o_custkey % 1000
    || CASE WHEN o_orderkey % 3 = 0 THEN ',M1' ELSE '' END AS model FROM orders)"""


@query(
    f"""WITH {_MODEL}, items AS (SELECT o_orderkey, unnest(split(model, ',')) AS item FROM models)
    SELECT o_orderkey, CASE WHEN item = 'Hm' THEN 6 WHEN item LIKE 'H%' THEN 2 WHEN item LIKE 'P%' THEN 0 ELSE 8 END AS class,
    CASE WHEN item = 'Hm' THEN 0 ELSE substr(split_part(item, ':', 1), 2)::BIGINT END AS id,
    CASE WHEN contains(item, ':') THEN split_part(item, ':', 2)::BIGINT END AS prefix, item AS text FROM items"""
)
def q_model_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = read_table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    head = F.when(k % 5 == 0, F.lit("Hm")).otherwise(F.concat(F.lit("H"), c))
    model = F.concat(head, F.lit(",P"), k, F.lit(":"), c % 1000, F.when(k % 3 == 0, F.lit(",M1")).otherwise(F.lit("")))
    items = o.select("o_orderkey", F.inline(protocol.parse_model(model)))
    return items.withColumn("text", protocol.format_model_item(F.col("class"), F.col("id"), F.col("prefix")))


@query(
    """WITH t AS (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS k FROM orders)
    SELECT o_orderkey, k NOT IN (1, 2) AS ok, CASE WHEN k NOT IN (1, 2) THEN o_custkey::VARCHAR END AS tid,
    CASE WHEN k NOT IN (1, 2) THEN '0,' || o_orderkey % 50 END AS roff FROM t"""
)
def q_request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read_table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    tail = F.when(k == 1, F.lit("&tid=1")).when(k == 2, F.lit("&quality=9")).otherwise(F.lit(""))
    q = F.concat(F.lit("target=a&tid="), "o_custkey", F.lit("&fsiz=100,100&roff=0,"), F.col("o_orderkey") % 50, F.lit("&rsiz=10,10&comps=0,1&len=2000&type=jpp-stream"), tail)
    m = o.select("o_orderkey", protocol.request_fields(q).alias("m"))
    return m.select("o_orderkey", F.col("m").isNotNull().alias("ok"), F.col("m")["tid"].alias("tid"), F.col("m")["roff"].alias("roff"))


@query(
    """WITH t AS (SELECT o_orderkey, o_orderkey % 90 AS x, 1 + o_custkey % 20 AS w, [o_orderkey % 4, o_custkey % 4, 3] AS comps FROM orders)
    SELECT o_orderkey, CASE WHEN x + w > 100 THEN 'outside' WHEN comps[1] >= comps[2] OR comps[2] >= comps[3] THEN 'components' ELSE 'ok' END AS status FROM t"""
)
def q_request_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    comps = F.array(F.col("o_orderkey") % 4, F.col("o_custkey") % 4, F.lit(3).cast("long"))
    rising = F.forall(F.sequence(F.lit(1), F.size(comps) - 1), lambda i: F.get(comps, i - 1) < F.get(comps, i))
    x, w = F.col("o_orderkey") % 90, 1 + F.col("o_custkey") % 20
    return o.select("o_orderkey", F.when(x + w > 100, "outside").when(~rising, "components").otherwise("ok").alias("status"))


@query("SELECT c_custkey, regexp_replace(substr(c_name, 1, 2) || chr(7) || ' ', '[^!-~]', '.', 'g') AS code FROM customer")
def q_fourcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.substring("c_name", 1, 2), F.lit("\x07 "))
    return read_table(spark, sf_dir, "customer").select("c_custkey", protocol.fourcc_text(code).alias("code"))


@query(f"WITH {PIXELS} SELECT l_orderkey, l_linenumber, c AS component, [r, g, b][c + 1] AS v FROM sig, range(3) t(c)")
def q_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved pixels to planes, one row per component."""
    return pixels(spark, sf_dir).select(*ID, F.posexplode(F.array("r", "g", "b")).alias("component", "v"))


@query(f"WITH {REGIONS} SELECT req_id, x - x % 2 AS x0, y - y % 2 AS y0, x + w AS x1, y + h AS y1 FROM regions")
def q_even_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select(
        "req_id", samples.even_start(F.col("x")).alias("x0"), samples.even_start(F.col("y")).alias("y0"), F.expr("x + w").alias("x1"), F.expr("y + h").alias("y1")
    )


def _grid(w: str, h: str) -> str:
    return f"((({w}) + 63) // 64 * ((({h}) + 63) // 64))"


@query(
    f"""WITH t AS (SELECT p_partkey, p_size * 97 AS w, (p_partkey % 400) * 83 AS h, [1, 2, 3, 8][p_partkey % 4 + 1] AS c FROM part)
    SELECT p_partkey, CASE WHEN w < 4 OR h < 4 OR w > 32768 OR h > 32768 THEN 'axes' WHEN c NOT IN (1, 3, 8) THEN 'components'
    WHEN w * h > 67108864 OR (c = 8 AND w * h > 33554432) THEN 'pixels' ELSE 'ok' END AS status,
    shared AS shared_bytes, blocks, greatest(0, least(8, blocks, floor((4294967296 - shared) / 4194304)::BIGINT)) AS workers
    FROM (SELECT *, 4 * w * h * c + 4096 * blocks + 12 * greatest(w, h) + 2147483648 AS shared FROM
    (SELECT *, c * ({_grid('w // 2', '(h + 1) // 2')} + {_grid('(w + 1) // 2', 'h // 2')} + {_grid('w // 2', 'h // 2')}
      + {_grid('(w + 1) // 2 // 2', '(h + 3) // 4')} + {_grid('(w + 3) // 4', '(h + 1) // 2 // 2')}
      + {_grid('(w + 1) // 2 // 2', '(h + 1) // 2 // 2')} + {_grid('(w + 3) // 4', '(h + 3) // 4')}) AS blocks FROM t))"""
)
def q_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of geometries before any work: bytes that all workers share, code blocks, and the workers that fit."""
    c = F.element_at(F.array(*[F.lit(k) for k in (1, 2, 3, 8)]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") * 97).alias("w"), (F.col("p_partkey") % 400 * 83).alias("h"), c.alias("c"))
    px = F.col("w") * F.col("h")
    status = F.when(F.expr("w < 4 OR h < 4 OR w > 32768 OR h > 32768"), "axes").when(~F.col("c").isin(1, 3, 8), "components")
    status = status.when((px > 64 << 20) | ((F.col("c") == 8) & (px > 32 << 20)), "pixels").otherwise("ok")
    p = p.withColumn("blocks", limits.encode_blocks(F.col("w"), F.col("h"), F.col("c")))
    p = p.withColumn("shared_bytes", limits.shared_bytes(F.col("w"), F.col("h"), F.col("c"), F.col("blocks")))
    return p.select("p_partkey", status.alias("status"), "shared_bytes", "blocks", limits.workers(F.col("shared_bytes"), F.col("blocks"), 8).alias("workers"))


@query(
    """WITH t AS (SELECT p_partkey, p_size * 97 AS w, 1 + p_partkey % 400 * 83 AS h, p_partkey % 4 AS r, [0, 1, 50000, 5000000][p_partkey % 4 + 1] AS most FROM part),
    s AS (SELECT p_partkey, most, ((w + (1 << r) - 1) // (1 << r)) * ((h + (1 << r) - 1) // (1 << r))
      + ((w + (2 << r) - 1) // (2 << r)) * (((h + (1 << r) - 1) // (1 << r)) + ((h + (2 << r) - 1) // (2 << r))) AS samples FROM t)
    SELECT p_partkey, samples, CASE WHEN most <= 0 THEN 'invalid limit' WHEN samples > most THEN 'limit exceeded' ELSE 'ok' END AS status FROM s"""
)
def q_decode_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that a request of three components (two of them subsampled) gives at a resolution, against a limit."""
    k = F.col("p_partkey")
    one = lambda dx, dy: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
    samples = limits.output_samples(F.col("p_size").cast("long") * 97, 1 + k % 400 * 83, F.array(one(1, 1), one(2, 1), one(2, 2)), k % 4)
    most = F.element_at(F.array(*[F.lit(n) for n in (0, 1, 50_000, 5_000_000)]), (k % 4 + 1).cast("int"))
    p = read_table(spark, sf_dir, "part").select("p_partkey", samples.alias("samples"), most.alias("most"))
    return p.select("p_partkey", "samples", limits.decode_status(F.col("samples"), F.col("most")).alias("status"))


@query("SELECT p_partkey, floor(floor((1 + p_partkey % 7)::DOUBLE * 0.25::DOUBLE * (p_size * 64)) / 8)::BIGINT AS budget FROM part")
def q_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.floor((1 + F.col("p_partkey") % 7).cast("double") * F.lit(0.25) * (F.col("p_size") * 64))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.floor(bits / 8).cast("long").alias("budget"))


@query(
    """WITH t AS (SELECT p_partkey, [128, 256, 512, 1024][p_partkey % 4 + 1] AS edge, p_size % 8 AS levels, 6 + p_partkey % 13 AS bits, 1 + p_partkey % 3 AS c FROM part)
    SELECT p_partkey, edge IN (256, 512, 1024) AND levels IN (2, 5, 6) AND bits BETWEEN 8 AND 16 AND c IN (1, 3) AS ok,
    concat_ws(',', CASE WHEN edge NOT IN (256, 512, 1024) THEN 'edge' END, CASE WHEN levels NOT IN (2, 5, 6) THEN 'levels' END,
    CASE WHEN bits NOT BETWEEN 8 AND 16 THEN 'bits' END, CASE WHEN c NOT IN (1, 3) THEN 'components' END) AS reasons FROM t"""
)
def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which profiles are supported, and what speaks against the others."""
    edge = F.element_at(F.array(*[F.lit(k) for k in (128, 256, 512, 1024)]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rules = {
        "edge": edge.isin(256, 512, 1024),
        "levels": (F.col("p_size") % 8).isin(2, 5, 6),
        "bits": (6 + F.col("p_partkey") % 13).between(8, 16),
        "components": (1 + F.col("p_partkey") % 3).isin(1, 3),
    }
    reasons = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in rules.items()])
    return read_table(spark, sf_dir, "part").select("p_partkey", contexts.all_of(list(rules.values())).alias("ok"), reasons.alias("reasons"))


@query(f"WITH {PLANES} SELECT vec_id, count(*) AS samples, count(*) FILTER (v NOT BETWEEN -64 AND 63) AS outside FROM sig GROUP BY vec_id")
def q_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples beyond a signed 7-bit range, counted inside each plane's own row."""
    flat = F.flatten("plane")
    outside = F.size(F.filter(flat, lambda v: ~v.between(-64, 63)))
    return planes(spark, sf_dir).select("vec_id", F.size(flat).cast("long").alias("samples"), outside.cast("long").alias("outside"))

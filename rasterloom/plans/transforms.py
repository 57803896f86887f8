"""Queries of wavelet transforms and of neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators import grid, wavelet
from rasterloom.plans.registry import EVENTS, FORWARD_53, PLANES, REAL_PLANES, REGIONS, lift, query
from rasterloom.sources.signals import event_lines, plane_samples, planes, read_table, regions

_F53, _F53_END = lift("sig", "user_id", "i", FORWARD_53)
_BAND = "CASE WHEN i % 2 = 0 THEN 'L' ELSE 'H' END AS band, i // 2 AS k"


def _sql_97(forward: bool) -> list[tuple[int, str]]:
    weights = [(1, wavelet.ALPHA), (0, wavelet.BETA), (1, wavelet.GAMMA), (0, wavelet.DELTA)]
    if forward:
        return [(p, f"v + {w!r}::DOUBLE * (lo + hi)") for p, w in weights]
    return [(p, f"v - {w!r}::DOUBLE * (lo + hi)") for p, w in reversed(weights)]


@query(f"WITH {EVENTS}, {_F53} SELECT user_id, i, {_BAND}, v AS coefficient FROM {_F53_END}")
def q_dwt53_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wavelet.lift_lines(event_lines(spark, sf_dir), ["user_id"], "i", wavelet.FORWARD_53)
    band = F.when(F.col("i") % 2 == 0, "L").otherwise("H")
    return out.select("user_id", "i", band.alias("band"), F.floor(F.col("i") / 2).alias("k"), F.col("v").alias("coefficient"))


@query(f"WITH {EVENTS} SELECT user_id, i, v FROM sig")
def q_idwt53_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward, then inverse: the lines come back."""
    there = wavelet.lift_lines(event_lines(spark, sf_dir), ["user_id"], "i", wavelet.FORWARD_53)
    return wavelet.lift_lines(there, ["user_id"], "i", wavelet.INVERSE_53).select("user_id", "i", "v")


_F97, _F97_END = lift("real", "user_id", "i", _sql_97(True))


@query(
    f"""WITH {EVENTS}, real AS (SELECT user_id, i, v::DOUBLE AS v FROM sig), {_F97} SELECT user_id, i,
    CASE WHEN i % 2 = 0 THEN v * {wavelet.LOW_SCALE!r}::DOUBLE ELSE v * {wavelet.HIGH_SCALE!r}::DOUBLE END AS coefficient FROM {_F97_END}"""
)
def q_dwt97_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    out = wavelet.lift_lines(lines, ["user_id"], "i", wavelet.FORWARD_97)
    return out.select("user_id", "i", wavelet.scale_bands(F.col("v"), F.col("i")).alias("coefficient"))


@query(f"WITH {EVENTS} SELECT user_id, i, v, true AS close FROM sig")
def q_idwt97_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and inverse, with scales: the lines come back, but for rounding."""
    lines = event_lines(spark, sf_dir).withColumn("w", F.col("v").cast("double"))
    there = wavelet.lift_lines(lines, ["user_id"], "i", wavelet.FORWARD_97, v="w")
    scaled = wavelet.scale_bands(wavelet.scale_bands(F.col("w"), F.col("i")), F.col("i"), inverse=True)
    back = wavelet.lift_lines(there.withColumn("w", scaled), ["user_id"], "i", wavelet.INVERSE_97, v="w")
    return back.select("user_id", "i", F.round("w").cast("long").alias("v"), (F.abs(F.col("w") - F.col("v")) < 1e-6).alias("close"))


_COLS, _COLS_END = lift("sig", "vec_id, x", "y", FORWARD_53)
_ROWS, _ROWS_END = lift(_COLS_END, "vec_id, y", "x", FORWARD_53)


@query(f"WITH {PLANES}, {_COLS}, {_ROWS} SELECT vec_id, y, x, CASE WHEN x % 2 = 0 THEN 'L' ELSE 'H' END || CASE WHEN y % 2 = 0 THEN 'L' ELSE 'H' END AS band, v FROM {_ROWS_END}")
def q_dwt53_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, then rows, inside each plane's own row: no shuffle."""
    s = plane_samples(wavelet.analyse_planes(planes(spark, sf_dir)))
    return s.select("vec_id", "y", "x", wavelet.band_name(F.col("y"), F.col("x")).alias("band"), "v")


@query(f"WITH {PLANES} SELECT vec_id, y, x, v FROM sig")
def q_idwt53_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_samples(wavelet.synthesise_planes(wavelet.analyse_planes(planes(spark, sf_dir))))


_C97, _C97_END = lift("sig", "vec_id, x", "y", _sql_97(True))
_R97, _R97_END = lift(_C97_END, "vec_id, y", "x", _sql_97(True))


@query(f"WITH {REAL_PLANES}, {_C97}, {_R97} SELECT vec_id, y, x, v FROM {_R97_END}")
def q_dwt97_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_samples(wavelet.analyse_planes(planes(spark, sf_dir, whole=False), wavelet.FORWARD_97))


_L2 = f"low AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, v FROM {_ROWS_END} WHERE x % 2 = 0 AND y % 2 = 0)"
_C2, _C2_END = lift("low", "vec_id, x", "y", FORWARD_53)
_R2, _R2_END = lift(_C2_END, "vec_id, y", "x", FORWARD_53)


@query(
    f"""WITH {PLANES}, {_COLS}, {_ROWS}, {_L2}, {_C2}, {_R2}
    SELECT vec_id, 1 AS level, y, x, v FROM {_ROWS_END} WHERE x % 2 = 1 OR y % 2 = 1 UNION ALL SELECT vec_id, 2, y, x, v FROM {_R2_END}"""
)
def q_dwt53_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: the second works on the quarter of low bands."""
    one = wavelet.analyse_planes(planes(spark, sf_dir))
    two = wavelet.analyse_planes(one.withColumn("plane", wavelet.low_low(F.col("plane"))))
    cols = ["vec_id", F.lit(1).alias("level"), "y", "x", "v"]
    high = plane_samples(one).where("x % 2 = 1 OR y % 2 = 1").select(cols)
    return high.unionByName(plane_samples(two).withColumn("level", F.lit(2)).select("vec_id", "level", "y", "x", "v"))


@query(f"WITH {PLANES} SELECT vec_id, y, x, v FROM sig WHERE y BETWEEN 2 AND 3 AND x BETWEEN 4 AND 5")
def q_window_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2 x 2 window from the coefficients within its halo alone; equal to a crop of the whole plane.

    Coefficients outside of the plan are dropped before the inverse. The kept range starts at an even position, so bands
    keep their parity.
    """
    coded = wavelet.analyse_planes(planes(spark, sf_dir))
    halo = grid.HALO["53"]
    y0, y1, x0, x1 = 2, 4, 4, 6
    cut = lambda a, b: (max(0, 2 * (a // 2 - halo)), min(8, 2 * (-(-b // 2) + halo)))
    (ya, yb), (xa, xb) = cut(y0, y1), cut(x0, x1)
    part = F.transform(F.slice("plane", ya + 1, yb - ya), lambda row: F.slice(row, xa + 1, xb - xa))
    back = plane_samples(wavelet.synthesise_planes(coded.withColumn("plane", part)))
    moved = back.select("vec_id", (F.col("y") + ya).alias("y"), (F.col("x") + xa).alias("x"), "v")
    return moved.where(f"y >= {y0} AND y < {y1} AND x >= {x0} AND x < {x1}")


def _axis_sql(a: str, e: str, n: int, halo: int) -> tuple[str, str]:
    stop = f"least(ceil({e} / 2)::BIGINT + {halo}, {n})"
    return f"least(greatest({a} // 2 - {halo}, 0), {stop})", stop


def _window_sql() -> str:
    out, src = [], "SELECT req_id, x AS ox0, y AS oy0, x + w AS ox1, y + h AS oy1 FROM regions"
    for k, r in enumerate((2, 1)):
        full, low = -(-4096 // (1 << (2 - r))), -(-4096 // (1 << (3 - r)))
        cells = []
        for axis in "xy":
            for band, n in (("l", low), ("h", full - low)):
                a, b = _axis_sql(f"o{axis}0", f"o{axis}1", n, 4)
                cells.append(f"{a} AS {band}{axis}0, {b} AS {band}{axis}1")
        out.append(f"w{k} AS (SELECT *, {r} AS resolution, {', '.join(cells)} FROM ({src}))")
        src = f"SELECT req_id, lx0 AS ox0, ly0 AS oy0, lx1 AS ox1, ly1 AS oy1 FROM w{k}"
    return f"WITH {REGIONS}, {', '.join(out)} SELECT * FROM w0 UNION ALL BY NAME SELECT * FROM w1"


@query(_window_sql())
def q_window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.synthesis_windows(regions(spark, sf_dir), 4096, 4096, 2, "97")
    return out.drop("x", "y", "w", "h")


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN sum(p) OVER w % 256 < 0 THEN sum(p) OVER w % 256 + 256 ELSE sum(p) OVER w % 256 END::BIGINT AS v
    FROM (SELECT o_orderkey, o_custkey, o_orderkey % 256 AS p FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def q_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal differences summed up along a row, modulo 256."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", F.pmod(F.sum(F.col("o_orderkey") % 256).over(w), F.lit(256)).alias("v"))


@query(
    f"""WITH {PLANES}, s AS (SELECT vec_id, y, x, (abs(v) >= 16)::INT AS on_ FROM sig),
    rows AS (SELECT *, coalesce(lag(on_) OVER w, 0) + coalesce(lead(on_) OVER w, 0) AS beside FROM s WINDOW w AS (PARTITION BY vec_id, y ORDER BY x))
    SELECT vec_id, y, x, beside AS h, coalesce(lag(on_) OVER w, 0) + coalesce(lead(on_) OVER w, 0) AS v,
    coalesce(lag(beside) OVER w, 0) + coalesce(lead(beside) OVER w, 0) AS d,
    beside + coalesce(lag(on_) OVER w, 0) + CASE WHEN y % 4 = 3 THEN 0 ELSE coalesce(lead(on_) OVER w, 0) END AS causal
    FROM rows WINDOW w AS (PARTITION BY vec_id, x ORDER BY y)"""
)
def q_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant neighbours of a static map, by direction; `causal` does not look below a stripe of four rows."""
    on = F.transform("plane", lambda row: F.transform(row, lambda v: (F.abs(v) >= 16).cast("int")))
    p = planes(spark, sf_dir).withColumn("on", on)

    def at(y, x):
        return F.coalesce(F.get(F.get("on", y), x), F.lit(0))

    def cell(y, x):
        below = at(y + 1, x)
        h, up = at(y, x - 1) + at(y, x + 1), at(y - 1, x)
        d = at(y - 1, x - 1) + at(y - 1, x + 1) + at(y + 1, x - 1) + at(y + 1, x + 1)
        return F.struct(h.alias("h"), (up + below).alias("v"), d.alias("d"), (h + up + F.when(y % 4 == 3, 0).otherwise(below)).alias("causal"))

    eight = F.sequence(F.lit(0), F.lit(7))
    cells = p.select("vec_id", F.posexplode(F.transform(eight, lambda y: F.transform(eight, lambda x: cell(y, x)))).alias("y", "row"))
    return cells.select("vec_id", "y", F.posexplode("row").alias("x", "c")).select("vec_id", "y", "x", "c.*")

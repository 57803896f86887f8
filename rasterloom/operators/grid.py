"""Rectangles on grids: tiles, regions, dependency windows of a synthesis, common spacings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.samples import ceil_div

#: Samples beyond a window that a synthesis of the 5/3 and of the 9/7 transform needs.
HALO = {"53": 2, "97": 4}


def overlapping_tiles(regions: DataFrame, edge: int) -> DataFrame:
    """regions (x, y, w, h, ...) with one row per tile (tile_x, tile_y) that they touch.

    Tile numbers are enumerated from the rectangle's ends, so that what follows is an equality join, not a comparison of
    every region with every tile. The rows of a region are as many as the tiles it touches.
    """
    span = lambda a, n: F.sequence(F.floor(F.col(a) / edge), F.floor((F.col(a) + F.col(n) - 1) / edge))
    rows = regions.where("w > 0 AND h > 0").withColumn("tile_y", F.explode(span("y", "h")))
    return rows.withColumn("tile_x", F.explode(span("x", "w")))


def clip_to_tile(tiles: DataFrame, edge: int) -> DataFrame:
    """With (x0, y0, x1, y1): the part of the region within the tile, half open."""
    left, top = F.col("tile_x") * edge, F.col("tile_y") * edge
    return (
        tiles.withColumn("x0", F.greatest(F.col("x"), left))
        .withColumn("y0", F.greatest(F.col("y"), top))
        .withColumn("x1", F.least(F.col("x") + F.col("w"), left + edge))
        .withColumn("y1", F.least(F.col("y") + F.col("h"), top + edge))
    )


def nominal_tiles(width: Column, height: Column, edge: Column) -> Column:
    """Array of (tile, x0, y0, x1, y1) of an image, in raster order, clipped to it."""
    across = ceil_div(width, edge)
    down = ceil_div(height, edge)

    def tile(i: Column) -> Column:
        x, y = (i % across) * edge, F.floor(i / across) * edge
        return F.struct(
            i.alias("tile"), x.alias("x0"), y.alias("y0"), F.least(x + edge, width).alias("x1"), F.least(y + edge, height).alias("y1")
        )

    return F.transform(F.sequence(F.lit(0).cast("long"), across * down - 1), tile)


def band_axis(start: Column, end: Column, length: Column, halo: int) -> tuple[Column, Column]:
    """Start and end of the band samples that the output start..end needs."""
    stop = F.least(ceil_div(end, 2) + halo, length)
    return F.least(F.greatest(F.floor(start / 2).cast("long") - halo, F.lit(0)), stop), stop


def synthesis_windows(regions: DataFrame, width: int, height: int, levels: int, transform: str) -> DataFrame:
    """regions (x, y, w, h, ...) with one row per level: what its output needs of the low and high bands of each axis.

    Rows have resolution, the output rectangle (ox0, oy0, ox1, oy1) and lx0, lx1, hx0, hx1, ly0, ly1, hy0, hy1.
    """
    halo = HALO[transform]
    steps = []
    out = {"ox0": F.col("x"), "oy0": F.col("y"), "ox1": F.col("x") + F.col("w"), "oy1": F.col("y") + F.col("h")}
    for resolution in range(levels, 0, -1):
        cells = dict(out)
        for axis, size in (("x", width), ("y", height)):
            full, low = -(-size >> (levels - resolution)), None
            full = -(-size // (1 << (levels - resolution)))
            low = -(-size // (1 << (levels - resolution + 1)))
            for band, n in (("l", low), ("h", full - low)):
                a, b = band_axis(out[f"o{axis}0"], out[f"o{axis}1"], F.lit(n).cast("long"), halo)
                cells[f"{band}{axis}0"], cells[f"{band}{axis}1"] = a, b
        steps.append(F.struct(F.lit(resolution).alias("resolution"), *[v.cast("long").alias(k) for k, v in cells.items()]))
        out = {"ox0": cells["lx0"], "oy0": cells["ly0"], "ox1": cells["lx1"], "oy1": cells["ly1"]}
    return regions.withColumn("_level", F.explode(F.array(*steps))).select("*", "_level.*").drop("_level")


def common_divisor(values: Column) -> Column:
    """Greatest common divisor of an array of whole numbers from 1 to 255."""
    return F.array_max(F.filter(F.sequence(F.lit(1), F.array_min(values).cast("int")), lambda d: F.forall(values, lambda v: v % d == 0)))


def code_blocks(width: Column, height: Column, edge: int = 64) -> Column:
    return ceil_div(width, edge) * ceil_div(height, edge)

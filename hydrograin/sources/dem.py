"""Elevation: tiles as cells, and the window of an area cut out of all tiles that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def window(tile_cells: DataFrame, boxes: DataFrame, pixels: int, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, row, col, z) of each box (aoi_id, min_lon, min_lat, max_lon, max_lat) from tile cells (tile_id, row, col, z).

    Each tile gives the rows and columns that lie in the box, moved to the box's own origin; tiles don't overlap.
    """
    b = geo.dem_tiles(boxes)
    edges = [F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    r0, r1, c0, c1 = geo.tile_window(F.col("tile_south"), F.col("tile_west"), *edges, pixels)
    eps = 1e-6
    top = F.floor((90 - F.col("max_lat")) * pixels + eps).cast("int")
    left = F.floor((F.col("min_lon") + 180) * pixels + eps).cast("int")
    b = b.withColumns({"_r0": r0, "_r1": r1, "_c0": c0, "_c1": c1, "_dr": (89 - F.col("tile_south")) * pixels - top, "_dc": (F.col("tile_west") + 180) * pixels - left})
    hit = tile_cells.join(b.select(key, "tile_id", "_r0", "_r1", "_c0", "_c1", "_dr", "_dc"), "tile_id").where("row >= _r0 AND row < _r1 AND col >= _c0 AND col < _c1")
    return hit.select(key, (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"), "z")


def window_grid(boxes: DataFrame, pixels: int, key: str = "aoi_id") -> DataFrame:
    """Grid rows (origin_x, origin_y, px_w, px_h, height, width) of the windows."""
    eps = 1e-6
    top, left = F.floor((90 - F.col("max_lat")) * pixels + eps), F.floor((F.col("min_lon") + 180) * pixels + eps)
    bottom, right = F.ceil((90 - F.col("min_lat")) * pixels - eps), F.ceil((F.col("max_lon") + 180) * pixels - eps)
    return boxes.select(
        key, (left / pixels - 180).alias("origin_x"), (90 - top / pixels).alias("origin_y"), F.lit(1 / pixels).alias("px_w"), F.lit(-1 / pixels).alias("px_h"),
        (bottom - top).cast("int").alias("height"), (right - left).cast("int").alias("width"),
    )

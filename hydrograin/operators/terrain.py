"""Terrain from elevation cells (aoi_id, row, col, z): gradients, shadow, drainage, height above drainage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from . import tiled
from .raster import neighbourhood
from .tiled import STEPS, accumulation, drainage

__all__ = ["STEPS", "above_source", "accumulate", "accumulation", "drainage", "gradient", "landing_zones", "radar_shadow", "receivers", "slope_degrees", "trace_downstream", "trace_upstream"]


def _along(line: str, place: str, z: str, key: str) -> Column:
    """Difference per cell along a line: central inside, one-sided at its ends; null next to missing values."""
    w = W.partitionBy(key, line).orderBy(place)
    here, before, after = F.col(z), F.lag(F.struct(place, z)).over(w), F.lead(F.struct(place, z)).over(w)
    back, on = before[place] == F.col(place) - 1, after[place] == F.col(place) + 1
    back, on = F.coalesce(back, F.lit(False)), F.coalesce(on, F.lit(False))
    return F.when(back & on, (after[z] - before[z]) / 2).when(on, after[z] - here).when(back, here - before[z])


def gradient(cells: DataFrame, x_m: Column | float, y_m: Column | float, z: str = "z", key: str = "aoi_id") -> DataFrame:
    """cells with grad_east and grad_south in metres per metre; x_m and y_m are the sides of a cell."""
    x_m, y_m = (F.lit(m) if isinstance(m, (int, float)) else m for m in (x_m, y_m))
    return cells.withColumn("grad_east", _along("row", "col", z, key) / x_m).withColumn("grad_south", _along("col", "row", z, key) / y_m)


def slope_degrees(cells: DataFrame, x_m: Column | float, y_m: Column | float, z: str = "z", key: str = "aoi_id") -> DataFrame:
    found = gradient(cells, x_m, y_m, z, key)
    return found.withColumn("slope", F.degrees(F.atan(F.hypot("grad_east", "grad_south"))))


def radar_shadow(azimuth: Column | float, cutoff: float = DEFAULT.terrain.radar_shadow_slope_degrees) -> Column:
    """Shadow or layover, from grad_east and grad_south: slope along the look direction steeper than the cut-off. Never null."""
    az = F.radians(F.lit(azimuth) if isinstance(azimuth, (int, float)) else azimuth)
    slant = F.abs(F.col("grad_east") * F.sin(az) - F.col("grad_south") * F.cos(az))
    return F.coalesce(slant > F.tan(F.radians(F.lit(cutoff))), F.lit(False))


def receivers(cells: DataFrame, x_m: Column | float, y_m: Column | float, z: str = "z", key: str = "aoi_id") -> DataFrame:
    """cells with (to_row, to_col), the neighbour of steepest descent; null for sinks and missing cells.

    x_m and y_m are the sides of a cell in metres: numbers, or columns of cells, as areas differ in latitude.
    """
    x_m, y_m = (F.lit(float(m)) if isinstance(m, (int, float)) else m for m in (x_m, y_m))
    near = neighbourhood(cells, F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.col(z).alias("z")), 1, "_near", key)

    def drop(p: Column) -> Column:
        dr, dc = p["r"] - F.col("row"), p["c"] - F.col("col")
        order = F.lit(None).cast("int")
        for i, (a, b) in enumerate(STEPS):
            order = F.when((dr == a) & (dc == b), i).otherwise(order)
        fall = (F.col(z) - p["z"]) / F.hypot(dc * x_m, dr * y_m)
        return F.when(order.isNotNull() & (fall > 0), F.struct(fall.alias("fall"), (-order).alias("order"), p["r"].alias("r"), p["c"].alias("c")))

    best = F.array_max(F.filter(F.transform("_near", drop), lambda x: x.isNotNull()))
    found = near.withColumn("_best", best).drop("_near")
    return found.withColumn("to_row", F.col("_best.r")).withColumn("to_col", F.col("_best.c")).drop("_best")


def accumulate(z: np.ndarray, x_m: float, y_m: float) -> np.ndarray:
    """Cells that drain through each cell, itself included; sinks are not filled, missing cells count nothing."""
    step = tiled.targets(np.pad(z, 1, constant_values=np.nan), x_m, y_m)
    return tiled.drained(tiled.inside(step), np.where(np.isnan(z), 0, 1).ravel()).reshape(z.shape)


def above_source(z: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Height above the source that a breadth-first walk reaches a cell from; missing cells are barriers.

    The walk goes on by whole fronts, in the order of a queue: a cell belongs to the first of the front that reaches it.
    """
    h, w = z.shape
    wide = np.pad(z, 1, constant_values=np.nan).ravel()
    base, step = np.full(len(wide), np.nan), np.array([a * (w + 2) + b for a, b in STEPS])
    front = np.flatnonzero(np.pad(source, 1, constant_values=False).ravel() & ~np.isnan(wide))
    base[front] = wide[front]
    while len(front):
        to, by = (front[:, None] + step[None, :]).ravel(), np.repeat(front, len(step))
        fresh = np.isnan(base[to]) & ~np.isnan(wide[to])
        to, first = np.unique(to[fresh], return_index=True)
        order = np.argsort(first)
        to, by = to[order], by[fresh][first[order]]
        base[to] = base[by]
        front = to
    return z - base.reshape(h + 2, w + 2)[1:-1, 1:-1]


def _trace(step: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Rows (row, col, start_row, start_col, step) that are reached by steps (row, col, next_row, next_col), one join for each.

    The steps are written once: each round reads them as they lie, instead of finding all receivers anew.
    """
    from .tables import stage

    step = stage(step)
    front = stage(starts.select(key, "row", "col", F.col("row").alias("start_row"), F.col("col").alias("start_col"), F.lit(0).alias("step")))
    path, n = front, 0
    while not front.isEmpty():
        n += 1
        front = stage(front.join(step, [key, "row", "col"]).select(key, F.col("next_row").alias("row"), F.col("next_col").alias("col"), "start_row", "start_col", F.lit(n).alias("step")))
        path = path.unionByName(front)
    return path


def trace_downstream(received: DataFrame, starts: DataFrame, key: str = "aoi_id") -> DataFrame:
    """Extension: the cells that water from each start passes, with their number on the way.

    received: cells with (to_row, to_col), see receivers(). Water only falls, so every path ends.
    """
    step = received.where("to_row IS NOT NULL").select(key, "row", "col", F.col("to_row").alias("next_row"), F.col("to_col").alias("next_col"))
    return _trace(step, starts, key)


def trace_upstream(received: DataFrame, starts: DataFrame, key: str = "aoi_id") -> DataFrame:
    """Extension: the cells whose water passes each start, with the number of steps to it."""
    step = received.where("to_row IS NOT NULL").select(key, F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.col("row").alias("next_row"), F.col("col").alias("next_col"))
    return _trace(step, starts, key)


def landing_zones(cells: DataFrame, settlements: DataFrame, px_m2: float, metres: Column, slope_max: float = DEFAULT.landing.max_slope_degrees, area_min: float = DEFAULT.landing.min_area_m2, distance_max: float = DEFAULT.landing.max_distance_from_settlement_m, key: str = "aoi_id") -> DataFrame:
    """Extension: flat components near a settlement: (aoi_id, component, area_m2, nearest_m), large ones first.

    cells hold slope, row, col and (x, y) in metres; settlements hold (x, y) in metres; few per area.
    """
    from .components import label_components

    flat = label_components(cells.where(F.col("slope") <= slope_max), 8, key)
    near = flat.join(settlements.select(key, F.col("x").alias("sx"), F.col("y").alias("sy")), key).groupBy(key, "component").agg(F.min(metres).alias("nearest_m"))
    size = flat.groupBy(key, "component").agg((F.count("*") * px_m2).alias("area_m2"))
    return size.where(F.col("area_m2") >= area_min).join(near.where(F.col("nearest_m") <= distance_max), [key, "component"]).orderBy(F.desc("area_m2"))

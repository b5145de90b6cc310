"""Spatial joins without cross products: everything meets on grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import geo, wkb
from .raster import point_lookup
from .tables import stage


#: A bin is halved at most so often, until the bin of a point holds about so many positions.
DEPTH, FEW = 12, 8
#: Bounds on distances give way by so much, for rounding.
_SLACK = 1e-12


def _finite(x: str, y: str) -> Column:
    """True where both are numbers, neither infinite nor missing."""
    return (F.abs(x) < F.lit(float("inf"))) & (F.abs(y) < F.lit(float("inf")))


def _bins(points: DataFrame, size: float, depth: int | Column) -> DataFrame:
    """points with the numbers (_bx, _by) of their bins of size / 2 ** depth; a bin of depth 0 is slightly wider than size."""
    at = lambda c: F.floor(F.col(c) / (size * (1 + 1e-9)) * F.pow(F.lit(2.0), F.lit(depth) if isinstance(depth, int) else depth))
    return points.withColumns({"_bx": at("x"), "_by": at("y")})


def _depth(positions: DataFrame, size: float, key: str) -> int:
    """How often to halve bins of `size`: a position then shares its bin with FEW others on average, dense places counted by their positions."""
    deep = positions.select(key, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("_l"))
    held = _bins(deep, size, F.col("_l")).groupBy(key, "_l", "_bx", "_by").agg(F.count("*").cast("double").alias("n"))
    mean = {r["_l"]: r["m"] for r in held.groupBy("_l").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    return next((n for n in sorted(mean) if mean[n] <= FEW), min(mean, key=lambda n: (mean[n], n), default=0))


def _boxes(bins: DataFrame, up: int, key: str) -> DataFrame:
    """Extent and weight of what the bins (_bx, _by) hold, for bins 2 ** up times as large."""
    b = bins.groupBy(key, F.shiftright("_bx", up).alias("_cx"), F.shiftright("_by", up).alias("_cy"))
    return b.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("w").alias("w"))


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows over all shuffle partitions, however small they are: joins make many of few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _extents(placed: DataFrame, key: str) -> DataFrame:
    return placed.groupBy(key, "_bx", "_by").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("w").alias("w"))


def _bounds(pairs: DataFrame) -> DataFrame:
    """pairs of boxes a and b with the squares of the least and greatest distance (_low, _high) of their points."""
    a, b = F.col("a"), F.col("b")
    gap = lambda c: F.greatest(F.lit(0.0), b[f"{c}0"] - a[f"{c}1"], a[f"{c}0"] - b[f"{c}1"])
    span = lambda c: F.greatest(b[f"{c}1"] - a[f"{c}0"], a[f"{c}1"] - b[f"{c}0"])
    square = lambda f: F.pow(f("x"), F.lit(2)) + F.pow(f("y"), F.lit(2))
    return pairs.withColumns({"_low": square(gap) * (1 - _SLACK), "_high": square(span) * (1 + _SLACK)})


def _meet(placed: DataFrame, others: DataFrame, depth: int, key: str, most: float, settle) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (_bx, _by, _cx, _cy) of a bin of `placed` and one of `others`, both of the last depth, that have to be compared point by point.

    Bins of others are halved step by step, and settle(pairs with _low and _high) says what is left of them each time and
    what is settled for a bin as a whole: so the number of pairs goes with the bins, whatever lies within `most`.
    """
    own, bins = stage(_extents(placed, key)), stage(_extents(others, key))
    box = F.struct("x0", "x1", "y0", "y1")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    pairs = own.select(key, "_bx", "_by", box.alias("a"), F.explode(offsets).alias("_o"))
    pairs = pairs.select(key, "_bx", "_by", "a", (F.shiftright("_bx", depth) + F.col("_o.i")).alias("_px"), (F.shiftright("_by", depth) + F.col("_o.j")).alias("_py"))
    whole = None
    for up in range(depth, -1, -1):
        part = _boxes(bins, up, key).select(key, "_cx", "_cy", box.alias("b"), "w", *([F.col("_cx").alias("_px"), F.col("_cy").alias("_py")] if up == depth else [F.shiftright("_cx", 1).alias("_px"), F.shiftright("_cy", 1).alias("_py")]))
        found = _bounds(_dealt(pairs, key, "_bx", "_by").join(part, [key, "_px", "_py"])).where(F.sqrt("_low") <= most)
        found, done = settle(found)
        if done is not None:
            whole = done if whole is None else whole.unionByName(done)
        pairs = found.select(key, "_bx", "_by", "a", F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
    return pairs.select(key, "_bx", "_by", F.col("_px").alias("_cx"), F.col("_py").alias("_cy")), whole


def nearest(points: DataFrame, nodes: DataFrame, most: float, point_id: str, node_id: str, key: str = "aoi_id") -> DataFrame:
    """points with the nearest node within `most` (lowest id on ties) and its distance; null for both where none is.

    points (aoi_id, point_id, x, y); nodes (aoi_id, node_id, x, y). Equal positions count once. Positions lie in bins
    that hold few nodes; a bin of points meets only bins of nodes that are not farther than the farthest corner of another.
    """
    at = points.where(_finite("x", "y")).select(key, "x", "y").distinct().withColumn("w", F.lit(1))
    to = stage(nodes.where(_finite("x", "y")).groupBy(key, "x", "y").agg(F.min(node_id).alias(node_id)))
    depth = _depth(to, most, key)
    at, to = stage(_bins(at, most, depth)), _bins(to.withColumn("w", F.lit(1)), most, depth)

    def settle(pairs: DataFrame) -> tuple[DataFrame, None]:
        return pairs.withColumn("_least", F.min("_high").over(W.partitionBy(key, "_bx", "_by"))).where("_low <= _least"), None

    pairs, _ = _meet(at, to, depth, key, most, settle)
    near = to.select(key, F.col("_bx").alias("_cx"), F.col("_by").alias("_cy"), node_id, F.col("x").alias("_nx"), F.col("y").alias("_ny"))
    near = pairs.join(near, [key, "_cx", "_cy"]).select(key, "_bx", "_by", node_id, "_nx", "_ny")
    d2 = F.pow(F.col("x") - F.col("_nx"), F.lit(2)) + F.pow(F.col("y") - F.col("_ny"), F.lit(2))
    found = _dealt(at, key, "_bx", "_by").join(near, [key, "_bx", "_by"]).withColumn("_d2", d2).where(F.sqrt("_d2") <= most)
    best = found.groupBy(key, "x", "y").agg(F.min(F.struct("_d2", node_id)).alias("_b"))
    best = best.select(key, "x", "y", F.col(f"_b.{node_id}").alias(node_id), F.sqrt("_b._d2").alias("distance"))
    return points.join(best, [key, "x", "y"], "left").select(*[points[c] for c in points.columns], node_id, "distance")


def count_within(centres: DataFrame, points: DataFrame, radius: float, centre_id: str, key: str = "aoi_id") -> DataFrame:
    """centres with `n`, the number of points within the radius, 0 included.

    Equal positions count once, with their number. Bins of points that lie within the radius of a whole bin of centres
    count as wholes; only those that its circles may cut are looked at point by point.
    """
    at = centres.where(_finite("x", "y")).select(key, "x", "y").distinct().withColumn("w", F.lit(1))
    to = stage(points.where(_finite("x", "y")).groupBy(key, "x", "y").agg(F.count("*").alias("w")))
    depth = _depth(to, radius, key)
    at, to = stage(_bins(at, radius, depth)), stage(_bins(to, radius, depth))
    inside = F.col("_high") <= radius * radius

    def settle(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = stage(pairs)
        return pairs.where(~inside), pairs.where(inside).select(key, "_bx", "_by", "w")

    pairs, whole = _meet(at, to, depth, key, radius, settle)
    full = at.drop("w").join(whole.groupBy(key, "_bx", "_by").agg(F.sum("w").alias("w")), [key, "_bx", "_by"]).select(key, "x", "y", "w")
    cells = to.select(key, F.col("_bx").alias("_cx"), F.col("_by").alias("_cy"), F.col("x").alias("_px"), F.col("y").alias("_py"), "w")
    d2 = F.pow(F.col("x") - F.col("_px"), F.lit(2)) + F.pow(F.col("y") - F.col("_py"), F.lit(2))
    pairs = _dealt(pairs, key, "_bx", "_by", "_cx", "_cy")
    cut = at.drop("w").join(pairs, [key, "_bx", "_by"]).join(cells, [key, "_cx", "_cy"]).where(d2 <= radius * radius).select(key, "x", "y", "w")
    counted = full.unionByName(cut).groupBy(key, "x", "y").agg(F.sum("w").alias("n"))
    found = centres.join(counted, [key, "x", "y"], "left")
    return found.select(*[centres[c] for c in centres.columns], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def covered_cells(shapes: DataFrame, grid: DataFrame, inside, pad: Column | float = 0.0, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, shape_id, row, col): cells whose centre satisfies inside(row of shapes, x, y).

    shapes hold shape_id and box (min_x, min_y, max_x, max_y in grid units); only cells in the box, padded, are tried,
    and only hits leave the row.
    """
    g = grid.select(key, *[F.col(c).alias(f"_{c}") for c in ("origin_x", "origin_y", "px_w", "px_h", "height", "width")])
    s = shapes.join(g, key)
    pad = F.lit(pad) if isinstance(pad, (int, float)) else pad
    top, left = geo.cell_of(F.col("box.min_x") - pad, F.col("box.max_y") + pad, F.col("_origin_x"), F.col("_origin_y"), F.col("_px_w"), F.col("_px_h"))
    bottom, right = geo.cell_of(F.col("box.max_x") + pad, F.col("box.min_y") - pad, F.col("_origin_x"), F.col("_origin_y"), F.col("_px_w"), F.col("_px_h"))
    r0, r1 = F.greatest(top, F.lit(0)), F.least(bottom, F.col("_height") - 1)
    c0, c1 = F.greatest(left, F.lit(0)), F.least(right, F.col("_width") - 1)
    s = s.withColumns({"_r0": r0, "_r1": r1, "_c0": c0, "_c1": c1}).where("_r1 >= _r0 AND _c1 >= _c0")

    def row_hits(r: Column) -> Column:
        x = lambda c: F.col("_origin_x") + (c + 0.5) * F.col("_px_w")
        y = F.col("_origin_y") + (r + 0.5) * F.col("_px_h")
        return F.transform(F.filter(F.sequence(F.col("_c0"), F.col("_c1")), lambda c: inside(x(c), y)), lambda c: F.struct(r.alias("row"), c.alias("col")))

    hits = F.flatten(F.transform(F.sequence(F.col("_r0"), F.col("_r1")), row_hits))
    return s.select(key, "shape_id", F.explode(hits).alias("_h")).select(key, "shape_id", "_h.row", "_h.col")


def _first_centre(x: np.ndarray, origin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first column whose centre lies at x or behind it."""
    c = np.ceil((x - origin) / size - 0.5)
    for shift in (-1, 1):  # where rounding has missed it by one
        centre = origin + (c + min(shift, 0) + 0.5) * size
        c = np.where(centre >= x, c - 1, c) if shift < 0 else np.where(centre < x, c + 1, c)
    return c


def scan_lines(owner: np.ndarray, sides: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (owner, row, first column, end column) of cells whose centre lies inside shapes, from all their sides at once.

    owner: the shape of each side (x1, y1, x2, y2); grid: (origin_x, origin_y, px_w, px_h, height, width) of each shape. A
    row's crossings with the sides, in order, bound the spans by pairs: holes and several parts are one rule.
    """
    x1, y1, x2, y2 = sides.T
    ox, oy, pw, ph, height, width = grid[owner].T
    low = np.ceil((np.maximum(y1, y2) - oy) / ph - 0.5) - 1
    high = np.floor((np.minimum(y1, y2) - oy) / ph - 0.5) + 1
    low, high = np.clip(low, 0, height), np.clip(high, -1, height - 1)
    n = np.maximum(high - low + 1, 0).astype(np.int64)
    side = np.repeat(np.arange(len(owner)), n)
    row = low[side] + np.arange(len(side)) - np.repeat(np.cumsum(n) - n, n)
    y = oy[side] + (row + 0.5) * ph[side]
    cuts = (y1[side] > y) != (y2[side] > y)
    side, row, y = side[cuts], row[cuts], y[cuts]
    x = x1[side] + (y - y1[side]) * (x2[side] - x1[side]) / (y2[side] - y1[side])
    of = owner[side]
    order = np.lexsort((x, row, of))
    of, row, x, side = of[order], row[order], x[order], side[order]
    # Rings are closed, so each row of a shape has an even number of crossings; what an open one leaves over counts nothing.
    a = wkb.pairs(of, row)
    b = a + 1
    c0 = np.clip(_first_centre(x[a], ox[side[a]], pw[side[a]]), 0, width[side[a]])
    c1 = np.clip(_first_centre(x[b], ox[side[b]], pw[side[b]]), 0, width[side[b]])
    some = c1 > c0
    return of[a][some], row[a][some].astype(np.int64), c0[some].astype(np.int64), c1[some].astype(np.int64)


def polygon_cells(shapes: DataFrame, grid: DataFrame, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, shape_id, row, col): cells whose centre lies inside polygons (aoi_id, shape_id, parts) with closed rings.

    Scan lines over batches of shapes; only the rows that a side crosses are looked at, whatever lies between.
    """
    names = ("origin_x", "origin_y", "px_w", "px_h", "height", "width")
    placed = shapes.select(key, "shape_id", "parts").join(grid.select(key, *names), key)
    kinds = dict(placed.dtypes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                g = np.stack([part.column(3 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(6)], axis=1)
                owner, row, c0, c1 = scan_lines(*wkb.sides_of(part.column(2)), g)
                size = c1 - c0
                upto = np.cumsum(size)
                lo = 0
                while lo < len(size):  # so many spans at once that their cells stay below about a million
                    hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20), side="right")))
                    n = size[lo:hi]
                    col = np.repeat(c0[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    which = pa.array(np.repeat(owner[lo:hi], n))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(which), part.column(1).take(which), pa.array(np.repeat(row[lo:hi], n).astype(np.int32)), pa.array(col.astype(np.int32))], [key, "shape_id", "row", "col"])
                    lo = hi

    return placed.mapInArrow(of, f"{key} {kinds[key]}, shape_id {kinds['shape_id']}, row int, col int")


def footprint_stats(shapes: DataFrame, hits: DataFrame, cells: DataFrame, grid: DataFrame, threshold: float = DEFAULT.flood.probability_threshold, key: str = "aoi_id") -> DataFrame:
    """Per shape: pixel_count, flooded_fraction, mean_probability, sampled_centroid.

    Shapes (aoi_id, shape_id, and point (x, y) or kind and parts) that cover no cell centre are read at their
    representative point, 0 outside the raster.
    """
    p = F.coalesce("probability", F.lit(0.0)).cast("double")
    cover = hits.join(cells.select(key, "row", "col", "probability"), [key, "row", "col"]).groupBy(key, "shape_id")
    cover = cover.agg(F.count("*").alias("pixel_count"), F.count_if(p >= threshold).alias("_flooded"), F.sum(p).alias("_sum"))
    bare = shapes.join(cover.select(key, "shape_id"), [key, "shape_id"], "left_anti")
    if "point" not in shapes.columns:
        bare = bare.select(key, "shape_id", wkb.representative_point(F.col("kind"), F.col("parts")).alias("point"))
    bare = point_lookup(bare.select(key, "shape_id", "point.x", "point.y"), cells, grid, "probability", key=key)
    bare = bare.select(key, "shape_id", F.lit(0).cast("long").alias("pixel_count"), F.when(p >= threshold, 1.0).otherwise(0.0).alias("flooded_fraction"), p.alias("mean_probability"), F.lit(True).alias("sampled_centroid"))
    full = shapes.select(key, "shape_id").join(cover, [key, "shape_id"]).select(key, "shape_id", "pixel_count", (F.col("_flooded") / F.col("pixel_count")).alias("flooded_fraction"), (F.col("_sum") / F.col("pixel_count")).alias("mean_probability"), F.lit(False).alias("sampled_centroid"))
    return full.unionByName(bare)


def footprints(shapes: DataFrame, cells: DataFrame, grid: DataFrame, threshold: float = DEFAULT.flood.probability_threshold, key: str = "aoi_id") -> DataFrame:
    """footprint_stats of polygons (aoi_id, shape_id, kind, parts) in grid coordinates."""
    return footprint_stats(shapes.select(key, "shape_id", "kind", "parts"), polygon_cells(shapes, grid, key), cells, grid, threshold, key)

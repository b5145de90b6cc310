"""Flood map: radar cells before and after to probability, mask, polygons, area and step counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, geo
from ..functions.numbers import half_even
from ..operators import components, raster, terrain
from ..operators.tables import stage


@dataclass
class FloodMap:
    cells: DataFrame  #: aoi_id, row, col, probability (0 outside the mask), raw, component
    polygons: DataFrame
    thresholds: DataFrame
    counts: DataFrame
    area: DataFrame


def refuse_mismatch(post: DataFrame, pres: DataFrame, most: int = DEFAULT.pairing.max_pre_scenes, key: str = "aoi_id") -> None:
    """ValueError unless every area has 1 to `most` pre scenes, all with the cells' extent of its post scene.

    Cells beyond one scene's grid would silently fall out of the join of both otherwise. One aggregation of each input.
    """
    extent = F.struct(F.count("*"), F.min("row"), F.max("row"), F.min("col"), F.max("col"))
    own = post.groupBy(key).agg(extent.alias("own"))
    each = pres.groupBy(key, "scene_id").agg(extent.alias("one")).join(own, key, "full")
    n, other = F.count("one"), F.count_if(F.col("one").isNotNull() & ~F.col("one").eqNullSafe(F.col("own")))
    wrong = each.groupBy(key).agg(n.alias("n"), other.alias("other")).where((F.col("n") == 0) | (F.col("n") > most) | (F.col("other") > 0)).first()
    if wrong:
        raise ValueError(f"area {wrong[0]}: " + (f"{wrong['other']} pre scenes do not share the grid of the post scene" if wrong["other"] else f"{wrong['n']} pre scenes, 1 to {most} are required"))


def flood_map(post: DataFrame, pres: DataFrame, grid: DataFrame, height: DataFrame | None = None, config: Config = DEFAULT, key: str = "aoi_id") -> FloodMap:
    """Flood maps of all areas.

    post (aoi_id, row, col, vv, vh, mask) and pres (the same with scene_id) are cells in dB; height has (row, col, slope,
    shadow, hand) on the same grid, null where unknown. An area without a pixel valid in all scenes has an empty map.
    ValueError if scenes of an area differ in their grid, or if it has none or too many pre scenes.
    """
    refuse_mismatch(post, pres, config.pairing.max_pre_scenes, key)
    c = config.flood
    bands = ("vv", "vh")

    def clean(cells: DataFrame, by: str) -> DataFrame:
        cells = cells.withColumns({b: classify.usable_or_null(F.col(b), F.col("mask")) for b in bands})
        for b in bands:
            near = raster.neighbourhood(cells, F.col(b), c.speckle_filter_size // 2, "_near", by) if c.speckle_filter_size > 1 else None
            if near is not None:
                cells = near.withColumn(b, F.when(F.col(b).isNotNull(), raster.array_median(F.col("_near")).cast("float"))).drop("_near")
        return cells

    after = clean(post, key)
    before = clean(pres.withColumn("_scene", F.concat_ws("|", key, "scene_id")), "_scene")
    before = raster.median_composite(before, keys=(key, "row", "col"))
    both = after.select(key, "row", "col", *[F.col(b).alias(f"post_{b}") for b in bands]).join(before, [key, "row", "col"])
    both = both.withColumn("ratio", classify.combine(*[classify.log_ratio(F.col(f"post_{b}"), F.col(b)) for b in bands], c.vv_weight, c.vh_weight))
    both = stage(both.withColumn("valid", F.col("ratio").isNotNull()))
    thresholds = raster.otsu(both.where("valid"), "ratio", key, c.otsu_histogram_bins, c.otsu_fallback_min_db, c.otsu_fallback_max_db)
    scored = both.join(thresholds.select(key, "threshold"), key, "left").withColumn("raw", F.when(F.col("valid"), classify.probability(F.col("ratio"), F.col("threshold"), c.probability_scale_db).cast("float")))
    scored = scored.withColumn("candidate", F.coalesce(F.col("raw") >= c.probability_threshold, F.lit(False)))
    if height is not None:
        scored = scored.join(height.select(key, "row", "col", "slope", "shadow", "hand"), [key, "row", "col"], "left")
    else:
        scored = scored.withColumns({"slope": F.lit(None).cast("double"), "shadow": F.lit(False), "hand": F.lit(None).cast("double")})
    reasons = {
        "excluded_water": classify.permanent_water(F.col("vv"), F.col("vh"), c.permanent_water_vv_max_db, c.permanent_water_vh_max_db),
        "excluded_slope": classify.above(F.col("slope"), config.terrain.slope_cutoff_degrees),
        "excluded_shadow": F.coalesce("shadow", F.lit(False)),
        "excluded_hand": classify.above(F.col("hand"), config.terrain.hand_cutoff_m),
    }
    scored = stage(scored.withColumn("reason", F.when(F.col("candidate"), F.coalesce(classify.first_reason(reasons), F.lit("kept")))))
    kept = components.label_components(scored.where("reason = 'kept'").select(key, "row", "col"), 8, key)
    large = stage(components.large_components(kept, c.min_component_size_px, key))
    cells = scored.join(large.select(key, "row", "col", "component"), [key, "row", "col"], "left")
    cells = stage(cells.select(key, "row", "col", F.when(F.col("component").isNotNull(), F.col("raw")).otherwise(F.lit(0.0).cast("float")).alias("probability"), "raw", "candidate", "valid", "reason", "component", F.col("slope").isNull().alias("slope_unknown"), F.col("hand").isNull().alias("hand_unknown")))
    n = lambda cond: F.count_if(cond)
    counts = cells.groupBy(key).agg(
        F.count("*").alias("pixels_total"), n(F.col("valid")).alias("valid"), n(F.col("candidate")).alias("candidate"), *[n(F.col("reason") == r).alias(r) for r in reasons],
        n((F.col("reason") == "kept") & F.col("component").isNull()).alias("excluded_small"), n(F.col("component").isNotNull()).alias("final"), n(F.col("slope_unknown")).alias("slope_unknown"), n(F.col("hand_unknown")).alias("hand_unknown"),
    )
    area = counts.join(grid, key).select(key, pixel_area(F.col("final")).alias("flooded_area_km2"))
    return FloodMap(cells, components.polygons(large.select(key, "row", "col", "component"), grid, key), thresholds, counts, area)


def pixel_area(n):
    """km² of n pixels at a grid's centre, from the UTM image of one pixel there; needs the grid's columns."""
    lon, lat = F.col("origin_x") + F.col("width") / 2 * F.col("px_w"), F.col("origin_y") + F.col("height") / 2 * F.col("px_h")
    zone = ((lon + 180) / 6).cast("int") + 1
    x0, y0 = geo.to_utm(lon, lat, zone)
    x1, y1 = geo.to_utm(lon + F.col("px_w"), lat, zone)
    x2, y2 = geo.to_utm(lon, lat + F.col("px_h"), zone)
    return half_even(n * F.abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 1e6, 6)


def terrain_layers(dem: DataFrame, dem_grid: DataFrame, grid: DataFrame, direction: Column | str, accumulation: int = DEFAULT.upstream.accumulation_threshold, config: Config = DEFAULT, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, row, col, slope, shadow, hand) on the radar grid, from elevation cells on their own grid.

    direction: ascending or descending, for all areas or as a column of dem_grid. Cell sizes are each area's own.
    """
    lat = F.col("origin_y") + F.col("height") / 2 * F.col("px_h")
    mx, my = geo.metres_per_pixel(F.col("px_w"), F.col("px_h"), lat)
    rising = F.upper(F.lit(direction) if isinstance(direction, str) else direction).startswith("ASC")
    azimuth = F.when(rising, config.flood.s1_look_azimuth_ascending_deg).otherwise(config.flood.s1_look_azimuth_descending_deg)
    placed = dem.join(F.broadcast(dem_grid.select(key, mx.alias("_mx"), my.alias("_my"), azimuth.alias("_azimuth"))), key)
    sloped = terrain.slope_degrees(placed, F.col("_mx"), F.col("_my"))
    sloped = sloped.withColumn("shadow", terrain.radar_shadow(F.col("_azimuth"), config.terrain.radar_shadow_slope_degrees))
    hand = terrain.drainage(placed, accumulation, F.col("_mx"), F.col("_my"))
    layers = stage(sloped.select(key, "row", "col", "slope", "shadow").join(hand, [key, "row", "col"], "left").withColumn("v", F.struct("slope", "shadow", "hand")))
    moved = raster.resample_nearest(layers.select(key, "row", "col", "v"), dem_grid, grid, "v", key)
    return moved.select(key, "row", "col", "v.slope", F.coalesce("v.shadow", F.lit(False)).alias("shadow"), "v.hand")

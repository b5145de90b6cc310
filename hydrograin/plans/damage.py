"""Damage: buildings, roads and bridges against the flood map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, geo, wkb
from ..functions.numbers import half_even
from ..operators import facts, lines, raster, spatial
from ..operators.tables import stage


@dataclass
class Damage:
    buildings: DataFrame
    roads: DataFrame
    bridges: DataFrame
    counts: DataFrame
    facts: DataFrame
    limitations: list[str]


def zone_of(grid: DataFrame, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, zone): the UTM zone at the middle of each grid."""
    return grid.select(key, (((F.col("origin_x") + F.col("width") / 2 * F.col("px_w") + 180) / 6).cast("int") + 1).alias("zone"))


def projected(points: DataFrame, grid: DataFrame, key: str = "aoi_id") -> DataFrame:
    """points with (x, y) in degrees moved to UTM metres, and their zone."""
    east, north = geo.to_utm(F.col("x"), F.col("y"), F.col("zone"))
    return points.join(F.broadcast(zone_of(grid, key)), key).withColumns({"_e": east, "_n": north}).drop("x", "y").withColumnsRenamed({"_e": "x", "_n": "y"})


def sample(points: DataFrame, cells: DataFrame, grid: DataFrame, key: str = "aoi_id") -> DataFrame:
    """points (sx, sy in metres, zone) with the probability of their cell."""
    lon, lat = geo.from_utm(F.col("sx"), F.col("sy"), F.col("zone"))
    placed = points.withColumns({"_lon": lon, "_lat": lat})
    return raster.point_lookup(placed, cells.select(key, "row", "col", F.col("probability").cast("double").alias("probability")), grid, "probability", "_lon", "_lat", key).drop("_lon", "_lat", "row", "col")


def _layer(layers: DataFrame, kind: str) -> DataFrame:
    return layers.where(F.col("feature_type") == kind)


def _tag(name: str) -> Column:
    return F.element_at("tags", F.lit(name))


def buildings(layer: DataFrame, cells: DataFrame, grid: DataFrame, config: Config = DEFAULT, key: str = "aoi_id") -> DataFrame:
    d = config.damage
    stats = spatial.footprints(layer.withColumn("shape_id", F.col("osm_id")), cells, grid, config.flood.probability_threshold, key)
    f = F.col("flooded_fraction")
    rows = layer.select(key, "osm_id", "osm_type", "clipped", "kind", "parts", wkb.representative_point(F.col("kind"), F.col("parts")).alias("point"))
    found = rows.join(stats.withColumnRenamed("shape_id", "osm_id"), [key, "osm_id"])
    return found.select(
        key, "osm_id", "osm_type", classify.status(f, possibly=d.possibly_affected_overlap_fraction, affected=d.affected_overlap_fraction).alias("status"),
        classify.confidence(f, F.col("sampled_centroid"), d.possibly_affected_overlap_fraction, d.affected_overlap_fraction, d.confidence_high_margin, d.confidence_medium_margin).alias("confidence"),
        half_even(f, 4).alias("flooded_fraction"), half_even(F.col("mean_probability"), 4).alias("mean_probability"), F.col("pixel_count").alias("pixels"), "clipped",
        F.when(F.col("sampled_centroid"), "centroid").otherwise("footprint").alias("sampled"), F.col("point.x").alias("lon"), F.col("point.y").alias("lat"), "kind", "parts",
    )


def roads(layer: DataFrame, cells: DataFrame, grid: DataFrame, config: Config = DEFAULT, key: str = "aoi_id") -> DataFrame:
    d = config.damage
    by = [key, "osm_id"]
    # The parts of a multi-line are one road: vertices in order, lengths along each part.
    points = projected(lines.vertices(layer, key), grid, key)
    segs = lines.segments(points, [*by, "part", "zone"], ["idx"])
    samples = sample(lines.sample_lines(segs, d.road_sample_spacing_m, [*by, "part", "zone"]), cells, grid, key)
    wet = lines.edge_probability(samples, by, threshold=config.flood.probability_threshold)
    length = segs.groupBy(*by).agg(F.sum("length").alias("length_m"))
    found = layer.select(key, "osm_id", "osm_type", "tags", "clipped", "kind", "parts").join(length, by, "left").join(wet, by, "left")
    f = F.coalesce("flooded_fraction", F.lit(0.0))
    km = F.coalesce("length_m", F.lit(0.0)) / 1000
    return found.select(
        key, "osm_id", "osm_type", _tag("highway").alias("highway"), _tag("name").alias("name"),
        classify.status(f, possibly=d.possibly_affected_overlap_fraction, affected=d.affected_overlap_fraction).alias("status"),
        classify.confidence(f, None, d.possibly_affected_overlap_fraction, d.affected_overlap_fraction, d.confidence_high_margin, d.confidence_medium_margin).alias("confidence"),
        half_even(f, 4).alias("flooded_fraction"), half_even(F.col("mean_probability"), 4).alias("flood_probability"), half_even(F.col("max_probability"), 4).alias("max_probability"),
        half_even(km, 6).alias("length_km"), half_even(f * km, 6).alias("flooded_length_km"), "clipped", "kind", "parts",
    )


def bridges(layer: DataFrame, cells: DataFrame, grid: DataFrame, config: Config = DEFAULT, key: str = "aoi_id") -> DataFrame:
    """Bridges by the cells whose centre lies within the buffer of the line, measured in metres."""
    d = config.damage
    by = [key, "osm_id"]
    points = projected(lines.vertices(layer, key), grid, key)
    segs = lines.segments(points, [*by, "part", "zone"], ["idx"])
    line = segs.groupBy(*by, "zone").agg(F.collect_list(F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x2"), F.col("y2"))).alias("edges"), F.sum("length").alias("length_m"))
    placed = layer.select(key, "osm_id", F.col("osm_id").alias("shape_id"), wkb.bounds(F.col("parts")).alias("box"), wkb.representative_point(F.col("kind"), F.col("parts")).alias("point")).join(line, by)
    # Metres to degrees, with room for high latitudes; the exact distance decides.
    pad = d.bridge_buffer_m / geo.DEGREE_M / F.greatest(F.lit(0.05), F.cos(F.radians(F.greatest(F.abs("box.min_y"), F.abs("box.max_y")))))

    def near(x: Column, y: Column) -> Column:
        e, n = geo.to_utm(x, y, F.col("zone"))
        return wkb.distance_squared(F.col("edges"), e, n) < d.bridge_buffer_m**2

    hits = spatial.covered_cells(placed, grid, near, pad, key)
    stats = spatial.footprint_stats(placed, hits, cells, grid, config.flood.probability_threshold, key).withColumnRenamed("shape_id", "osm_id")
    f = F.col("flooded_fraction")
    found = layer.select(key, "osm_id", "osm_type", "tags", "clipped", "kind", "parts").join(stats, by).join(line.select(*by, "length_m"), by)
    return found.select(
        key, "osm_id", "osm_type", _tag("name").alias("name"), _tag("highway").alias("highway"), classify.bridge_structure(F.col("tags")).alias("structure"),
        classify.bridge_status(f, d.possibly_affected_overlap_fraction).alias("status"),
        classify.confidence(f, F.col("sampled_centroid"), d.possibly_affected_overlap_fraction, d.affected_overlap_fraction, d.confidence_high_margin, d.confidence_medium_margin).alias("confidence"),
        half_even(f, 4).alias("flooded_fraction"), half_even(F.col("mean_probability"), 4).alias("mean_probability"), F.lit(d.bridge_buffer_m).alias("buffer_m"), half_even(F.col("length_m") / 1000, 6).alias("length_km"), "clipped", "kind", "parts",
    )


def damage(layers: DataFrame, cells: DataFrame, grid: DataFrame, missing: list[str] | None = None, config: Config = DEFAULT, key: str = "aoi_id") -> Damage:
    """Damage of all areas. layers: decoded features with feature_type and aoi_id; ValueError without a building layer."""
    missing = missing or []
    if "building" in missing:
        raise ValueError("the building layer is required")
    cells = cells.select(key, "row", "col", "probability")
    b = stage(buildings(_layer(layers, "building"), cells, grid, config, key))
    r = stage(roads(_layer(layers, "highway"), cells, grid, config, key))
    g = stage(bridges(_layer(layers, "bridge"), cells, grid, config, key))
    counts = facts.damage_counts(b, r, g, key)
    return Damage(b, r, g, counts, facts.facts(counts, facts.DAMAGE, "damage", key), [f"no {m} extract" for m in missing])


def damage_counts(layers: DataFrame, cells: DataFrame, grid: DataFrame, config: Config = DEFAULT, key: str = "aoi_id") -> DataFrame:
    """The counts of damage() alone: no layer is written, and what only its features hold is never computed."""
    cells = cells.select(key, "row", "col", "probability")
    b, r, g = (f(_layer(layers, name), cells, grid, config, key) for f, name in ((buildings, "building"), (roads, "highway"), (bridges, "bridge")))
    return facts.damage_counts(b.select(key, "status"), r.select(key, "status", "length_km", "flooded_length_km"), g.select(key, "status", "structure"), key)

"""Isolation: which settlements lost road access to services."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, wkb
from ..functions.numbers import half_even
from ..operators import facts, graph, lines, spatial
from ..operators.tables import stage
from .damage import projected, sample


@dataclass
class Isolation:
    settlements: DataFrame
    summary: DataFrame
    counts: DataFrame
    facts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    closed: DataFrame


def _points(layer: DataFrame, tag: str, values: tuple[str, ...], key: str) -> DataFrame:
    """Features with one of the values of a tag: (aoi_id, osm_id, tag, name, lon, lat), named after the tag if they have no name."""
    own = F.element_at("tags", F.lit(tag))
    name = F.coalesce(F.nullif(F.element_at("tags", F.lit("name")), F.lit("")), F.concat(F.lit(f"{tag}/"), own))
    at = wkb.representative_point(F.col("kind"), F.col("parts"))
    chosen = layer.where(classify.has_tag(F.col("tags"), (tag,), values))
    return chosen.select(key, "osm_id", own.alias("tag"), name.alias("name"), at.alias("p")).select(key, "osm_id", "tag", "name", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def destinations(layers: DataFrame, config: Config = DEFAULT, key: str = "aoi_id") -> DataFrame:
    """Facilities and towns: (aoi_id, kind, tag, name, lon, lat, osm_id)."""
    c = config.isolation
    facility = _points(layers.where("feature_type = 'amenity'"), "amenity", c.facility_tags, key).withColumn("kind", F.lit("facility"))
    place = _points(layers.where("feature_type = 'place'"), "place", c.destination_place_tags, key).withColumn("kind", F.lit("place"))
    return facility.unionByName(place)


def settlements(layers: DataFrame, config: Config = DEFAULT, key: str = "aoi_id") -> DataFrame:
    return _points(layers.where("feature_type = 'place'"), "place", config.isolation.place_tags, key).withColumnRenamed("tag", "place")


def check_classes(settlements: DataFrame) -> None:
    """ValueError if a settlement has a class that is none of the known ones, or none at all."""
    if row := settlements.where(~F.coalesce(F.col("class").isin(*graph.CLASSES), F.lit(False))).select("class").first():
        raise ValueError(f"unexpected class {row[0]}")


def isolation(layers: DataFrame, cells: DataFrame, grid: DataFrame, buildings: DataFrame | None = None, config: Config = DEFAULT, key: str = "aoi_id") -> Isolation:
    """Access of the settlements of all areas. buildings: the damage stage's, for counts around settlements (0 without)."""
    c = config.isolation
    layers = layers.where(F.col("feature_type").isin("highway", "amenity", "place"))
    points = projected(lines.vertices(layers.where("feature_type = 'highway'"), key), grid, key)
    zones = points.select(key, "zone").distinct()
    look = lambda s: sample(s.join(F.broadcast(zones), key) if "zone" not in s.columns else s, cells, grid, key)
    nodes, edges, closed = graph.build(points, config.damage.road_sample_spacing_m, look, c.flood_threshold_edge, key)
    nodes, edges = stage(nodes), stage(edges)
    metric = lambda df: projected(df.withColumns({"x": F.col("lon"), "y": F.col("lat")}), grid, key).drop("zone")
    to = stage(metric(destinations(layers, config, key)).withColumn("destination_id", F.xxhash64("kind", "osm_id")))
    homes = stage(metric(settlements(layers, config, key)).withColumn("settlement_id", F.col("osm_id")))
    if buildings is None:
        homes = homes.withColumn("buildings_affected", F.lit(0).cast("long"))
    else:
        hit = metric(buildings.where("status = 'affected'").select(key, "lon", "lat"))
        homes = spatial.count_within(homes, hit, c.settlement_radius_m, "settlement_id", key).withColumnRenamed("n", "buildings_affected")
    found, summary = graph.solve(nodes, edges, to, homes, c, key)
    ranked = stage(graph.priority_rank(found, key))
    ranked = ranked.withColumns({"snapped": F.col("node_id").isNotNull(), "snap_distance_m": half_even(F.col("distance"), 2), "road_node": F.coalesce("node_id", F.lit(-1)), "priority_score": half_even(F.col("priority_score"), 4)})
    counts = facts.isolation_counts(ranked, summary, key)
    return Isolation(ranked, summary, counts, facts.facts(counts, facts.ISOLATION, "isolation", key), nodes, edges, closed)

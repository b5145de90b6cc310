"""Counts, facts, provenance and reports from the results of the stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Facts of each stage with their units, in the order of the output, and what a report line holds.
DAMAGE = {"buildings_total": "count", "buildings_affected": "count", "buildings_possibly_affected": "count", "roads_affected": "count", "road_km_affected": "km", "bridges_possibly_impacted": "count"}
ISOLATION = {"settlements_total": "count", "settlements_newly_cut_off": "count", "settlements_still_connected": "count", "settlements_no_pre_event_access": "count", "road_km_severed": "km", "buildings_affected_in_settlements": "count"}
FLOOD = {"flooded_area_km2": "km2"}
UNITS = {"area": "km2", "distance": "km", "count": "integer"}
REPORTED = ("buildings_total", "buildings_affected", "buildings_possibly_affected", "roads_total", "roads_affected", "road_km_affected", "bridges_total", "bridges_possibly_impacted")


def facts(counts: DataFrame, units: dict[str, str], stage: str, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, id, value, value_type, unit, source_stage): a row per count."""
    kinds = dict(counts.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).cast("string").alias("value"), F.lit("float" if kinds[c] in ("double", "float") else "int").alias("value_type"), F.lit(u).alias("unit"), F.lit(stage).alias("source_stage")) for c, u in units.items()])
    return counts.select(key, F.inline(rows))


def fact(all_facts: DataFrame, id_: str) -> DataFrame:
    """The fact of an id, per area."""
    return all_facts.where(F.col("id") == id_)


def damage_counts(buildings: DataFrame, roads: DataFrame, bridges: DataFrame, key: str = "aoi_id") -> DataFrame:
    """The counts of the damage stage per area; an area without a layer counts 0 for it."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    b = buildings.groupBy(key).agg(F.count("*").alias("buildings_total"), n(s == "affected").alias("buildings_affected"), n(s == "possibly_affected").alias("buildings_possibly_affected"), n(s == "unaffected").alias("buildings_unaffected"))
    km = lambda c: F.round(F.sum(c), 4)
    r = roads.groupBy(key).agg(F.count("*").alias("roads_total"), n(s == "affected").alias("roads_affected"), n(s == "possibly_affected").alias("roads_possibly_affected"), km(F.col("length_km")).alias("road_km_total"), km(F.when(s == "affected", F.col("length_km")).otherwise(0.0)).alias("road_km_affected"), km(F.col("flooded_length_km")).alias("road_km_flooded"))
    g = bridges.groupBy(key).agg(F.count("*").alias("bridges_total"), n(s == "possibly_impacted").alias("bridges_possibly_impacted"), n(s == "unaffected").alias("bridges_unaffected"), n(F.col("structure") == "road_bridge").alias("bridges_road_total"), n(F.col("structure") == "other_bridge").alias("bridges_non_road_total"))
    return b.join(r, key, "full").join(g, key, "full").fillna(0)


def isolation_counts(settlements: DataFrame, summary: DataFrame, key: str = "aoi_id") -> DataFrame:
    """The counts of the isolation stage per area; areas without a solution count no settlements."""
    n = lambda k: F.count_if(F.col("class") == k)
    found = settlements.groupBy(key).agg(
        F.count("*").alias("settlements_total"), n("newly_cut_off").alias("settlements_newly_cut_off"), n("still_connected").alias("settlements_still_connected"), n("no_pre_event_access").alias("settlements_no_pre_event_access"),
        F.count_if(F.col("node_id").isNull()).alias("settlements_unsnapped"), F.sum("buildings_affected").alias("buildings_affected_in_settlements"), F.round(F.coalesce(F.max("extra_distance_km"), F.lit(0.0)), 4).alias("max_extra_distance_km"),
    )
    own = summary.select(key, "status", "destinations_total", "destinations_snapped", F.col("severed_edges").alias("roads_severed_edges"), F.round(F.col("severed_m") / 1000, 4).alias("road_km_severed"))
    return own.join(found, key, "left").fillna(0)


def class_histogram(settlements: DataFrame, classes: tuple[str, ...], key: str = "aoi_id") -> DataFrame:
    """(aoi_id, class, n) for every class, 0 included."""
    counted = settlements.groupBy(key).agg(*[F.count_if(F.col("class") == c).alias(c) for c in classes])
    return counted.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in classes])))


def rollup(checks: DataFrame, *by: str) -> DataFrame:
    """Of checks (status PASS, WARN, FAIL or SKIP): how many there are of each, and whether none failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.groupBy(*by).agg(n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"), (n("FAIL") == 0).alias("ok"))


def extent(points: DataFrame, *by: str, x: str = "x", y: str = "y") -> DataFrame:
    """The least and the largest coordinates."""
    return points.groupBy(*by).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def report_line(counts: list[str] | tuple[str, ...] = REPORTED) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in counts])


def provenance(mode: str, config_hash: str, code_version: str, model_version: str, snapshot: str, post: Column, pre: Column, s2: Column, degradations: Column | None = None) -> Column:
    """Struct that says what a result came from. post, pre (array) and s2 are structs of scenes; mode is live, cached or degraded."""
    if mode not in ("live", "cached", "degraded"):
        raise ValueError(f"unknown mode {mode}")
    none = F.array().cast("array<struct<code:string,reason_key:string,details:string>>")
    return F.struct(
        F.lit(mode).alias("mode"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("computed_at"), F.lit(code_version).alias("code_version"), F.lit(config_hash).alias("config_hash"), F.lit(model_version).alias("model_version"),
        F.struct(post.alias("post"), pre.alias("pre"), post["relative_orbit"].alias("relative_orbit"), post["orbit_direction"].alias("direction")).alias("scenes"), s2.alias("s2"), F.lit(snapshot).alias("osm_snapshot_date"), (degradations if degradations is not None else none).alias("degradations"),
    )


def document(all_facts: DataFrame, settlements: DataFrame, meta: DataFrame, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, facts_json): the facts of each area with its ranked settlements. meta: (aoi_id, job_id, bbox, event_date, provenance)."""
    f = all_facts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_stage", "id", "value", "value_type", "unit"))).alias("facts"))
    row = F.struct("priority_rank", "name", "class", "buildings_affected", "extra_distance_km")
    s = settlements.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("cutoff_settlements"))
    head = F.struct(*[c for c in meta.columns if c != key], F.to_json(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])).alias("units"))
    joined = meta.join(f, key).join(s, key, "left")
    return joined.select(key, F.to_json(F.struct(head.alias("meta"), "facts", F.struct(F.coalesce("cutoff_settlements", F.array()).alias("cutoff_settlements")).alias("tables"))).alias("facts_json"))


def report_html(all_facts: DataFrame, templates: DataFrame, lang: str = "en", key: str = "aoi_id") -> DataFrame:
    """(aoi_id, html): the template (lang, html) of the language, or the English one, with `{{ id }}` filled from the facts."""
    values = all_facts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", "value"))).alias("values"))
    own = F.max(F.when(F.col("lang") == lang, F.col("html")))
    chosen = templates.agg(F.coalesce(own, F.max(F.when(F.col("lang") == "en", F.col("html")))).alias("template"))
    return values.crossJoin(F.broadcast(chosen)).select(key, text.render(F.col("template"), F.col("values"), left="{{ ", right=" }}").alias("html"))

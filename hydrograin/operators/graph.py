"""Road graphs as tables: nodes (aoi_id, node_id, x, y) and edges (aoi_id, u, v, length_m, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Isolation
from ..functions import classify
from . import lines
from .paths import distances, spread
from .spatial import nearest
from .tables import connected_components, numbered, stage

CLASSES = ("newly_cut_off", "still_connected", "no_pre_event_access")


def degrees(edges: DataFrame, key: str = "aoi_id") -> DataFrame:
    ends = edges.select(key, F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy(key, "node_id").agg(F.count("*").alias("degree"))


def contract(nodes: DataFrame, edges: DataFrame, key: str = "aoi_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, closed) after merging chains of nodes with two neighbours into single edges.

    edges are those of merge_edges(): one for each pair of nodes. A chain is a component of edges that meet in such nodes. One with two different ends becomes an edge between
    them; one that closes on itself is kept edge by edge, and `closed` counts those edges per area. Parallel chains add up.
    Node ids are numbered anew in their old order.
    """
    edges = stage(edges)
    two = stage(degrees(edges, key).where("degree = 2").select(key, "node_id"))
    measures = ("length_m", "flood_probability", "max_probability", "flooded_length_m")
    # Only edges at such nodes go through the steps; all others are kept as they are.
    at_u, at_v = (two.select(key, F.col("node_id").alias(end), F.lit(True).alias(f"_{end}2")) for end in ("u", "v"))
    edges = edges.join(at_u, [key, "u"], "left").join(at_v, [key, "v"], "left")
    inner = F.col("_u2").isNotNull() | F.col("_v2").isNotNull()
    chain = stage(edges.where(inner).select(key, "u", "v", *measures, F.xxhash64(key, "u", "v").alias("_e")))
    links = chain.select(key, "_e", F.explode(F.array("u", "v")).alias("node_id")).join(two, [key, "node_id"])
    links = links.groupBy(key, "node_id").agg(F.min("_e").alias("a"), F.max("_e").alias("b")).select("a", "b")
    chain = chain.join(connected_components(links).withColumnRenamed("node", "_e"), "_e", "left").withColumn("_chain", F.coalesce("component", "_e")).drop("component")
    tips = chain.select(key, "_chain", F.explode(F.array("u", "v")).alias("node_id")).join(two, [key, "node_id"], "left_anti")
    tips = tips.groupBy(key, "_chain").agg(F.min("node_id").alias("_a"), F.max("node_id").alias("_b"))
    chain = stage(chain.join(tips, [key, "_chain"], "left").withColumn("_open", F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))))
    pieces = stage(chain.select(
        key, F.least(F.when(F.col("_open"), F.col("_a")).otherwise(F.col("u")), F.when(F.col("_open"), F.col("_b")).otherwise(F.col("v"))).alias("u"),
        F.greatest(F.when(F.col("_open"), F.col("_a")).otherwise(F.col("u")), F.when(F.col("_open"), F.col("_b")).otherwise(F.col("v"))).alias("v"), *measures,
    ))
    beside = pieces.select(key, "u", "v").distinct().withColumn("_beside", F.lit(True))
    plain = edges.where(~inner).select(key, "u", "v", *measures).join(beside, [key, "u", "v"], "left")
    merged = plain.where("_beside IS NULL").drop("_beside").unionByName(lines.merge_edges(pieces.unionByName(plain.where("_beside").drop("_beside")), key))
    lost = chain.where("_open").select(key, F.explode(F.array("u", "v")).alias("node_id")).join(two, [key, "node_id"]).distinct()
    kept = numbered(nodes.join(lost, [key, "node_id"], "left_anti"), key, "node_id", "_new")
    renamed = merged
    for end in ("u", "v"):
        renamed = renamed.join(kept.select(key, F.col("node_id").alias(end), F.col("_new").alias(f"_{end}")), [key, end]).drop(end).withColumnRenamed(f"_{end}", end)
    closed = chain.where("NOT _open").groupBy(key).agg(F.count("*").alias("cycle_segments"))
    return kept.drop("node_id").withColumnRenamed("_new", "node_id"), renamed, closed


def build(line_points: DataFrame, spacing: float, sample, threshold: float, key: str = "aoi_id", id_: str = "osm_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, closed) of the contracted road graph from vertices (aoi_id, osm_id, part, idx, x, y) in metres.

    sample(points with sx, sy) adds `probability`, null outside the raster.
    """
    keyed = lines.vertex_keys(line_points, key=key)
    nodes = keyed.groupBy(key, "node_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    w = W.partitionBy(key, id_, "part").orderBy("idx")
    segs = lines.segments(keyed.withColumn("to", F.lead("node_id").over(w)), [key, id_, "part"], ["idx"])
    segs = segs.withColumn("seg", F.xxhash64(key, id_, "part", "idx"))
    wet = lines.segment_probability(sample(lines.sample_segments(segs, spacing)), [key, "seg"], threshold=threshold)
    rows = segs.select(key, "seg", F.col("node_id").alias("u"), F.col("to").alias("v"), F.col("length").alias("length_m")).join(wet, [key, "seg"], "left")
    rows = rows.select(key, "u", "v", "length_m", F.coalesce("probability", F.lit(0.0)).alias("flood_probability"), F.coalesce("max_probability", F.lit(0.0)).alias("max_probability"), F.coalesce("flooded_m", F.lit(0.0)).alias("flooded_length_m"))
    return contract(stage(nodes), lines.merge_edges(rows, key), key)


def shortest(edges: list[tuple[int, int, float]], sources: list[int]) -> dict[int, float]:
    """Distance of every node that can be reached from any of the sources."""
    out: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
        out.setdefault(v, []).append((u, w))
    return spread(out, [(0.0, s) for s in sources])


def relax(edges: DataFrame, sources: DataFrame, rounds: int | None = None, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, node_id, distance) by repeated joins, until no distance changes: for graphs beyond one task.

    With `rounds`, over at most so many edges.
    """
    arcs = edges.select(key, F.col("u").alias("a"), F.col("v").alias("b"), "length_m").union(edges.select(key, F.col("v"), F.col("u"), "length_m"))
    found = sources.select(key, "node_id", F.lit(0.0).alias("distance")).distinct()
    state, done = None, 0
    while rounds is None or done < rounds:
        ahead = found.join(arcs, (found[key] == arcs[key]) & (found["node_id"] == arcs["a"])).select(found[key], F.col("b").alias("node_id"), (F.col("distance") + F.col("length_m")).alias("distance"))
        found = stage(found.union(ahead).groupBy(key, "node_id").agg(F.min("distance").alias("distance")))
        done += 1
        # Nodes only come in and distances only fall: equal numbers and sums of row hashes mean equal rows.
        row = found.agg(F.count("*"), F.sum(F.xxhash64(key, "node_id", "distance").cast("decimal(38,0)"))).first()
        if row == state:
            break
        state = row
    return found


def solve(nodes: DataFrame, edges: DataFrame, destinations: DataFrame, settlements: DataFrame, config: Isolation = DEFAULT.isolation, key: str = "aoi_id") -> tuple[DataFrame, DataFrame]:
    """(settlements with node, distances, class, extra distance and score; summary per area with a typed status).

    settlements (aoi_id, settlement_id, x, y, buildings_affected, ...); destinations (aoi_id, destination_id, x, y).
    Status: NO_ROAD_GRAPH without edges, NO_DESTINATIONS without a destination near a road, else OK; classes are
    only given for OK.
    """
    at = nearest(destinations, nodes, config.settlement_snap_distance_m, "destination_id", "node_id", key)
    sources = stage(at.where("node_id IS NOT NULL").select(key, "node_id").distinct())
    cut = F.col("flood_probability") >= config.flood_threshold_edge
    dry = edges.where(~cut)
    left = dry.select(key, F.col("u").alias("node_id")).union(dry.select(key, F.col("v").alias("node_id")))
    pre = distances(edges, sources, key).withColumnRenamed("distance", "pre_m")
    post = distances(dry, sources.join(left, [key, "node_id"], "left_semi"), key).withColumnRenamed("distance", "post_m")
    areas = settlements.select(key).union(destinations.select(key)).union(nodes.select(key)).distinct()
    graph = edges.groupBy(key).agg(F.count("*").alias("edges"), F.count_if(cut).alias("severed_edges"), F.sum(F.when(cut, F.col("length_m")).otherwise(0.0)).alias("severed_m"), F.sum("length_m").alias("road_m"))
    summary = (
        areas.join(graph, key, "left")
        .join(destinations.groupBy(key).agg(F.count("*").alias("destinations_total")), key, "left")
        .join(sources.groupBy(key).agg(F.count("*").alias("destinations_snapped")), key, "left")
        .fillna(0, ["edges", "severed_edges", "severed_m", "road_m", "destinations_total", "destinations_snapped"])
    )
    summary = summary.withColumn("status", F.when(F.col("edges") == 0, "NO_ROAD_GRAPH").when(F.col("destinations_snapped") == 0, "NO_DESTINATIONS").otherwise("OK"))
    found = nearest(settlements, nodes, config.settlement_snap_distance_m, "settlement_id", "node_id", key)
    found = found.join(pre, [key, "node_id"], "left").join(post, [key, "node_id"], "left").join(summary.select(key, "status"), key)
    cls = classify.settlement_class(F.col("node_id").isNotNull(), F.col("pre_m"), F.col("post_m"))
    found = found.where("status = 'OK'").withColumn("class", cls).withColumn("extra_distance_km", F.when(F.col("class") == "still_connected", classify.extra_km(F.col("pre_m"), F.col("post_m"))))
    score = classify.priority_score(F.col("buildings_affected"), F.col("class"), config.severity_weights, config.priority_buildings_weight, config.priority_isolation_weight)
    return found.withColumn("priority_score", score), summary


def priority_rank(settlements: DataFrame, key: str = "aoi_id", score: str = "priority_score", cls: str = "class", name: str = "name", order: str = "settlement_id") -> DataFrame:
    """settlements with priority_rank from 1: by falling score, then class, then name, then id."""
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col(cls))
    place = F.when(place > 0, place).otherwise(99)
    w = W.partitionBy(key).orderBy(F.desc(score), place, F.coalesce(F.col(name), F.lit("")), order)
    return settlements.withColumn("priority_rank", F.row_number().over(w))

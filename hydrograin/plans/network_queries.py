"""More operators on the driver's tables with SQL: networks with cycles, access, counts, fallbacks and tag rules.

Keys stand in for maps as in `queries`: nations are the nodes of a road network with cycles, customers are junctions
between two of them, suppliers settlements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import classify
from ..operators import components, facts, graph, lines, raster, terrain
from ..operators.tables import stage
from ..sources import features
from .queries import _EDGES, _GRID, _edges, _grid_cells, query, table

_SOURCES = (3, 17)
_ROADS = """n AS (SELECT n_nationkey AS k FROM nation),
w AS (SELECT k AS u, (k * 7 + 3) % 25 AS v, 1 + k % 5 AS m FROM n UNION ALL SELECT k, (k + 1) % 25, 3 + k % 4 FROM n),
c AS (SELECT 1000 + c_custkey AS k, c_nationkey AS a, 1 + c_custkey % 7 AS wa, c_custkey * 11 % 25 AS b, 2 + c_custkey % 3 AS wb FROM customer),
arcs AS (SELECT u, v, min(m) AS m FROM (SELECT u, v, m FROM w UNION ALL SELECT v, u, m FROM w UNION ALL SELECT a, b, wa + wb FROM c UNION ALL SELECT b, a, wa + wb FROM c) GROUP BY ALL)"""
_CYCLES = f"""WITH RECURSIVE {_ROADS},
f AS (SELECT k, 0 AS d FROM n WHERE k IN {_SOURCES} UNION SELECT v, d + m FROM f JOIN arcs ON f.k = arcs.u WHERE d + m <= 60),
s AS (SELECT k, min(d) AS d FROM f GROUP BY 1)
SELECT CAST(k AS INT) AS node_id, CAST(d AS DOUBLE) AS distance FROM s
UNION ALL SELECT CAST(c.k AS INT), CAST(least(x.d + wa, y.d + wb) AS DOUBLE) FROM c JOIN s x ON x.k = c.a JOIN s y ON y.k = c.b"""


def _road_arcs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey").cast("int")
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    row = lambda df, u, v, m, p: df.select(F.lit(0).alias("aoi_id"), u.cast("int").alias("u"), v.cast("int").alias("v"), m.cast("double").alias("length_m"), p.cast("double").alias("flood_probability"))
    wet, dry, c_key = F.when(k % 3 == 0, 0.9).otherwise(0.0), F.lit(0.0), F.col("c_custkey")
    roads = row(n, k, (k * 7 + 3) % 25, 1 + k % 5, wet).union(row(n, k, (k + 1) % 25, 3 + k % 4, wet))
    return roads, row(c, c_key + 1000, F.col("c_nationkey"), 1 + c_key % 7, dry).union(row(c, c_key + 1000, c_key * 11 % 25, 2 + c_key % 3, dry))


def _cyclic(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    roads, junctions = _road_arcs(spark, sf)
    return roads.union(junctions), spark.createDataFrame([(0, s) for s in _SOURCES], "aoi_id int, node_id int")


@query(_CYCLES)
def shortest_path_cycles(spark, sf):
    return graph.distances(*_cyclic(spark, sf)).select("node_id", "distance")


@query(_CYCLES)
def shortest_path_relax_cycles(spark, sf):
    return graph.relax(*_cyclic(spark, sf)).select("node_id", "distance")


@query("""
WITH RECURSIVE n AS (SELECT n_nationkey AS k FROM nation),
w AS (SELECT k AS u, (k * 7 + 3) % 25 AS v, 1 + k % 5 AS m, k % 3 = 0 AS wet FROM n UNION ALL SELECT k, (k + 1) % 25, 3 + k % 4, k % 3 = 0 FROM n),
arcs AS (SELECT u, v, m, wet FROM w UNION ALL SELECT v, u, m, wet FROM w),
src AS (SELECT r_regionkey * 6 AS k FROM region WHERE r_regionkey < 2),
f AS (SELECT k, 0 AS d FROM src UNION SELECT v, d + m FROM f JOIN arcs ON f.k = arcs.u WHERE d + m <= 80),
g AS (SELECT k, 0 AS d FROM src WHERE k IN (SELECT u FROM arcs WHERE NOT wet) UNION SELECT v, d + m FROM g JOIN arcs ON g.k = arcs.u WHERE NOT wet AND d + m <= 80),
pre AS (SELECT k, min(d) AS d FROM f GROUP BY 1), post AS (SELECT k, min(d) AS d FROM g GROUP BY 1),
s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS b, CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 26 < 25 THEN s_suppkey % 26 END AS node FROM supplier),
x AS (SELECT s.k, node, b, pre.d AS a, post.d AS z, CASE WHEN pre.d IS NULL THEN 'no_pre_event_access' WHEN post.d IS NULL THEN 'newly_cut_off' ELSE 'still_connected' END AS class FROM s LEFT JOIN pre ON node = pre.k LEFT JOIN post ON node = post.k)
SELECT k, CAST(node AS INT) AS node_id, CAST(a AS DOUBLE) AS pre_m, CAST(z AS DOUBLE) AS post_m, class, CASE WHEN class = 'still_connected' THEN round(greatest(0, z - a) / 1000.0::DOUBLE, 6) END AS extra_km,
  CAST(b + 2.0 * CASE class WHEN 'newly_cut_off' THEN 1.0 WHEN 'no_pre_event_access' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM x""")
def reachability_solver(spark, sf):
    at = lambda df, k, x, y: df.select(F.lit(0).alias("aoi_id"), k, x.cast("double").alias("x"), y.cast("double").alias("y"))
    nodes = at(table(spark, sf, "nation"), F.col("n_nationkey").cast("int").alias("node_id"), F.col("n_nationkey") * 10_000, F.lit(0))
    r, s = F.col("r_regionkey"), F.col("s_suppkey")
    to = at(table(spark, sf, "region").where(r.isin(0, 1, 4)), r.alias("destination_id"), r * 60_000 + 10, F.when(r == 4, 1e7).otherwise(0.0))
    homes = at(table(spark, sf, "supplier"), s.alias("settlement_id"), s % 26 * 10_000 + 5, F.when(s % 9 == 0, 1e7).otherwise(0.0)).withColumn("buildings_affected", F.col("settlement_id") % 4)
    found, _ = graph.solve(nodes, _road_arcs(spark, sf)[0], to, homes)
    return found.select(F.col("settlement_id").alias("k"), F.col("node_id").cast("int").alias("node_id"), "pre_m", "post_m", "class", F.col("extra_distance_km").alias("extra_km"), F.col("priority_score").cast("double").alias("score"))


@query("""
WITH x AS (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS snapped, CASE WHEN o_custkey % 7 > 0 THEN o_totalprice END AS pre, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice + (o_custkey % 11 - 3) * 250.5::DOUBLE END AS post FROM orders)
SELECT k, CASE WHEN NOT snapped OR pre IS NULL THEN 'no_pre_event_access' WHEN post IS NULL THEN 'newly_cut_off' ELSE 'still_connected' END AS class, round(CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN greatest(0.0, post - pre) END / 1000, 6) AS extra_km FROM x""")
def settlement_access(spark, sf):
    pre, post = F.when(F.col("o_custkey") % 7 > 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") + (F.col("o_custkey") % 11 - 3) * 250.5)
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") != "P").alias("snapped"), pre.alias("pre"), post.alias("post"))
    extra = F.when(F.col("pre").isNotNull() & F.col("post").isNotNull(), classify.extra_km(F.col("pre"), F.col("post")))
    return x.select("k", classify.settlement_class(F.col("snapped"), F.col("pre"), F.col("post")).alias("class"), extra.alias("extra_km"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'road_bridge' ELSE 'other_bridge' END AS structure, CASE WHEN p_retailprice % 100 / 100 >= 0.05 THEN 'possibly_impacted' ELSE 'unaffected' END AS status FROM part")
def bridge_rules(spark, sf):
    tags = F.when(F.col("p_size") % 2 == 1, F.create_map(F.lit("highway"), "p_type")).otherwise(F.create_map(F.lit("railway"), "p_type"))
    return table(spark, sf, "part").select("p_partkey", classify.bridge_structure(tags).alias("structure"), classify.bridge_status(F.col("p_retailprice") % 100 / 100).alias("status"))


@query("""
WITH x AS (SELECT l_orderkey AS k, CASE WHEN l_discount <> 0.03 THEN l_discount END AS v, l_quantity AS w FROM lineitem)
SELECT k, round(coalesce(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 0), 9) AS p, max(coalesce(v, 0)) AS max_p, coalesce(sum(w) FILTER (v >= 0.05), 0) AS flooded_m FROM x GROUP BY 1""")
def segment_aggregate(spark, sf):
    d = F.col("l_discount")
    samples = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(d != 0.03, d).alias("probability"), F.col("l_quantity").alias("weight"))
    return lines.segment_probability(samples, ["k"], threshold=0.05).select("k", F.round("probability", 9).alias("p"), F.col("max_probability").alias("max_p"), "flooded_m")


@query("""
WITH x AS (SELECT event_type AS k, CASE WHEN event_id % 11 > 0 THEN value - 100 END AS v, user_id % 4 AS m FROM events)
SELECT k, count(*) FILTER (v > -60 AND m > 0) AS usable, count(*) FILTER (v > -60) AS above_floor, round(sum(CASE WHEN v > -60 AND m > 0 THEN v END), 2) AS total FROM x GROUP BY 1""")
def validity_masks(spark, sf):
    v, m = F.when(F.col("event_id") % 11 > 0, F.col("value") - 100), F.col("user_id") % 4
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("k")).agg(F.count_if(classify.usable(v, m)).alias("usable"), F.count_if(classify.usable(v)).alias("above_floor"), F.round(F.sum(classify.usable_or_null(v, m)), 2).alias("total"))


@query(f"SELECT p_brand, count(*) FILTER (p_size > 1 AND p_retailprice % 100 <= {DEFAULT.optical.cloud_limit_pct}) AS usable, count(*) AS n FROM part GROUP BY 1")
def cloud_usability(spark, sf):
    pct = F.when(F.col("p_size") > 1, F.col("p_retailprice") % 100)
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(classify.cloud_usable(pct)).alias("usable"), F.count("*").alias("n"))


@query("""
WITH x AS (SELECT p_partkey, p_size % 6 AS s, p_partkey % 3 AS g FROM part)
SELECT p_partkey FROM x WHERE s = 0 AND g = 2 OR s = 2 AND g IN (1, 2) OR s = 4 OR s = 5 AND g IN (0, 2)""")
def feature_selection(spark, sf):
    kinds = (("building", "yes"), ("building", "no"), ("highway", "residential"), ("highway", "footway"), ("amenity", "clinic"), ("place", "village"))
    tags = F.get(F.array(*[F.create_map(F.lit(k), F.lit(v)) for k, v in kinds]), F.col("p_size") % 6)
    geom = F.get(F.array(*map(F.lit, ("Point", "LineString", "Polygon"))), (F.col("p_partkey") % 3).cast("int"))
    parts = table(spark, sf, "part").withColumns({"tags": tags, "geom_type": geom})
    return features.select_features(parts, ["building", "highway", "amenity", "place"]).select("p_partkey")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return features.count_rows(spark, f"{sf}/lineitem.parquet")


@query("""
WITH b AS (SELECT o_orderkey % 5 AS k, count(*) AS bt, count(*) FILTER (o_orderpriority LIKE '1%') AS ba, count(*) FILTER (o_orderpriority LIKE '2%') AS bp, count(*) FILTER (o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%') AS bu FROM orders GROUP BY 1),
r AS (SELECT l_orderkey % 4 AS k, count(*) AS rt, count(*) FILTER (l_discount >= 0.08) AS ra, round(sum(l_quantity), 4) AS km, round(sum(CASE WHEN l_discount >= 0.08 THEN l_quantity ELSE 0 END), 4) AS kma FROM lineitem GROUP BY 1),
g AS (SELECT p_partkey % 3 AS k, count(*) AS gt, count(*) FILTER (p_size % 4 = 0) AS gi, count(*) FILTER (p_size % 2 = 1) AS gr FROM part GROUP BY 1)
SELECT b.k, bt AS buildings_total, ba AS buildings_affected, bp AS buildings_possibly_affected, bu AS buildings_unaffected, coalesce(rt, 0) AS roads_total, coalesce(ra, 0) AS roads_affected, coalesce(km, 0) AS road_km_total, coalesce(kma, 0) AS road_km_affected,
  coalesce(gt, 0) AS bridges_total, coalesce(gi, 0) AS bridges_possibly_impacted, coalesce(gt - gi, 0) AS bridges_unaffected, coalesce(gr, 0) AS bridges_road_total, coalesce(gt - gr, 0) AS bridges_non_road_total
FROM b LEFT JOIN r ON b.k = r.k LEFT JOIN g ON b.k = g.k""")
def damage_counts_all_layers(spark, sf):
    label = lambda one, two: F.when(one, "affected").when(two, "possibly_affected").otherwise("unaffected").alias("status")
    p, size = F.col("o_orderpriority"), F.col("p_size")
    b = table(spark, sf, "orders").select((F.col("o_orderkey") % 5).alias("aoi_id"), label(p.startswith("1"), p.startswith("2")))
    q = F.col("l_quantity")
    r = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 4).alias("aoi_id"), label(F.col("l_discount") >= 0.08, F.lit(False)), q.alias("length_km"), q.alias("flooded_length_km"))
    g = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("aoi_id"), F.when(size % 4 == 0, "possibly_impacted").otherwise("unaffected").alias("status"), F.when(size % 2 == 1, "road_bridge").otherwise("other_bridge").alias("structure"))
    return facts.damage_counts(b, r, g).drop("roads_possibly_affected", "road_km_flooded").withColumnRenamed("aoi_id", "k")


@query("""
WITH s AS (SELECT s_nationkey AS k, s_suppkey % 3 AS c, s_suppkey % 6 = 0 AS off, s_suppkey % 10 AS b, s_suppkey % 17 / 4.0::DOUBLE AS x FROM supplier),
t AS (SELECT k, count(*) AS n, count(*) FILTER (c = 0) AS cut, count(*) FILTER (c = 1) AS still, count(*) FILTER (c = 2) AS none, count(*) FILTER (off) AS off, sum(b) AS b, round(max(x), 4) AS x FROM s GROUP BY 1)
SELECT CAST(n_nationkey AS INT) AS k, coalesce(n, 0) AS settlements_total, coalesce(cut, 0) AS settlements_newly_cut_off, coalesce(still, 0) AS settlements_still_connected, coalesce(none, 0) AS settlements_no_pre_event_access, coalesce(off, 0) AS settlements_unsnapped,
  CAST(coalesce(b, 0) AS BIGINT) AS buildings_affected_in_settlements, coalesce(x, 0) AS max_extra_distance_km, CAST(n_regionkey AS INT) AS roads_severed_edges, round(n_nationkey * 123.25::DOUBLE / 1000, 4) AS road_km_severed FROM nation LEFT JOIN t ON n_nationkey = t.k""")
def isolation_counts(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("int").alias("aoi_id"), F.get(F.array(*map(F.lit, graph.CLASSES)), (k % 3).cast("int")).alias("class"), F.when(k % 6 != 0, k).alias("node_id"), (k % 10).alias("buildings_affected"), (k % 17 / 4.0).alias("extra_distance_km")
    )
    n = F.col("n_nationkey")
    summary = table(spark, sf, "nation").select(n.cast("int").alias("aoi_id"), F.lit("OK").alias("status"), F.lit(1).alias("destinations_total"), F.lit(1).alias("destinations_snapped"), F.col("n_regionkey").cast("int").alias("severed_edges"), (n * 123.25).alias("severed_m"))
    return facts.isolation_counts(s, summary).drop("status", "destinations_total", "destinations_snapped").withColumnRenamed("aoi_id", "k")


@query("""
WITH e AS (SELECT event_type AS k, value FROM events UNION ALL SELECT 'user-' || user_id, 7.0 FROM events),
x AS (SELECT k, min(value) AS mn, max(value) AS mx FROM e GROUP BY 1),
h AS (SELECT e.k, mn, (mx - mn) / 64 AS w, least(CAST(floor((value - mn) / ((mx - mn) / 64)) AS INT), 63) AS bin, count(*) AS c FROM e JOIN x ON e.k = x.k WHERE mx > mn GROUP BY ALL),
s AS (SELECT *, mn + (bin + 0.5) * w AS x, sum(c) OVER (PARTITION BY k ORDER BY bin) AS w0, sum(c * (mn + (bin + 0.5) * w)) OVER (PARTITION BY k ORDER BY bin) AS s0, sum(c) OVER (PARTITION BY k) AS wt, sum(c * (mn + (bin + 0.5) * w)) OVER (PARTITION BY k) AS st FROM h),
b AS (SELECT *, round(CAST(w0 AS DOUBLE) * (wt - w0) * (s0 / w0 - (st - s0) / (wt - w0)) * (s0 / w0 - (st - s0) / (wt - w0)), 6) AS v FROM s WHERE wt > w0),
o AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY v DESC, bin) AS n FROM b)
SELECT x.k, round(CASE WHEN o.k IS NULL THEN 12.0 ELSE greatest(4.0, least(20.0, o.x)) END, 4) AS threshold, CASE WHEN o.k IS NULL THEN 'fallback_no_data' WHEN o.x < 4 OR o.x > 20 THEN 'otsu_fallback' ELSE 'otsu' END AS method FROM x LEFT JOIN o ON x.k = o.k AND n = 1""")
def otsu_fallbacks(spark, sf):
    e = table(spark, sf, "events")
    cells = e.select(F.col("event_type").alias("aoi_id"), "value").union(e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.lit(7.0)))
    return raster.otsu(cells, "value", bins=64, low=4.0, high=20.0).select(F.col("aoi_id").alias("k"), F.round("threshold", 4).alias("threshold"), "method")


@query(f"""
WITH RECURSIVE {_GRID}, s(dr, dc, o) AS (VALUES (-1,-1,0),(-1,0,1),(-1,1,2),(0,-1,3),(0,1,4),(1,-1,5),(1,0,6),(1,1,7)),
f AS (SELECT a.r, a.c, b.r AS tr, b.c AS tc, o, (a.z - b.z) / sqrt(CAST(dc * 30 AS DOUBLE) ** 2 + CAST(dr * 30 AS DOUBLE) ** 2) AS fall FROM g a JOIN s ON true JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc),
t AS (SELECT r, c, tr, tc FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY fall DESC, o) AS n FROM f WHERE fall > 0) WHERE n = 1),
p AS (SELECT r, c FROM g UNION ALL SELECT t.tr, t.tc FROM p JOIN t ON p.r = t.r AND p.c = t.c)
SELECT r AS row, c AS col, count(*) AS accumulation FROM p GROUP BY ALL""")
def flow_accumulation(spark, sf):
    return terrain.accumulation(_grid_cells(spark, sf), 30.0, 30.0, side=64).select("row", "col", "accumulation")


@query(f"WITH {_EDGES} SELECT round(sum(m), 3) AS length_m, round(sum(f), 3) AS flooded_m, round(sum(m * p), 3) AS weighted FROM e")
def contracted_totals(spark, sf):
    """Contraction merges edges, but keeps their length, flooded length and length-weighted probability."""
    edges = stage(_edges(spark, sf))
    nodes = edges.select("aoi_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    merged = graph.contract(nodes, edges)[1]
    return merged.agg(F.round(F.sum("length_m"), 3).alias("length_m"), F.round(F.sum("flooded_length_m"), 3).alias("flooded_m"), F.round(F.sum(F.col("length_m") * F.col("flood_probability")), 3).alias("weighted"))


@query(f"""
WITH RECURSIVE {_GRID}, m AS (SELECT r, c, r * 1000 + c AS id FROM g WHERE z > 120),
l AS (SELECT id AS a, id AS b FROM m UNION SELECT l.a, y.id FROM l JOIN m x ON l.b = x.id JOIN m y ON abs(y.r - x.r) <= 1 AND abs(y.c - x.c) <= 1),
k AS (SELECT b AS id, min(a) AS top FROM l GROUP BY 1),
n AS (SELECT top, row_number() OVER (ORDER BY top) AS component, count(*) AS n FROM k GROUP BY top)
SELECT CAST(component AS INT) AS component, n AS pixel_count, CAST(n AS DOUBLE) AS area FROM n WHERE n >= 3""")
def polygon_areas(spark, sf):
    """The area that the outlines of a component enclose, holes taken off, is its number of cells."""
    labelled = components.label_components(_grid_cells(spark, sf).where("z > 120").select("aoi_id", "row", "col"))
    grid = spark.sql("SELECT 0 AS aoi_id, 0D AS origin_x, 0D AS origin_y, 1D AS px_w, -1D AS px_h")
    found = components.polygons(components.large_components(labelled, 3).drop("pixel_count"), grid)
    rings = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")

    def enclosed(ring):
        sides = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: ring[i][0] * ring[i + 1][1] - ring[i + 1][0] * ring[i][1])
        return F.abs(F.aggregate(sides, F.lit(0.0), lambda a, x: a + x)) / 2

    area = F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, enclosed(r)).otherwise(-enclosed(r))), F.lit(0.0), lambda a, x: a + x)
    return found.groupBy("component", "pixel_count").agg(F.sum(area).alias("area"))


@query("SELECT o_custkey % 10 AS k, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 1e5) AS warned, count(*) FILTER (o_orderstatus = 'P' AND o_custkey % 10 < 5) AS failed, count(*) FILTER (o_orderstatus <> 'F') - warned - failed AS skipped, failed = 0 AS ok FROM orders GROUP BY 1")
def status_rollup(spark, sf):
    s, k = F.col("o_orderstatus"), F.col("o_custkey") % 10
    status = F.when(s == "F", "PASS").when((s == "O") & (F.col("o_totalprice") > 1e5), "WARN").when((s == "P") & (k < 5), "FAIL").otherwise("SKIP")
    return facts.rollup(table(spark, sf, "orders").select(k.alias("k"), status.alias("status")), "k")


@query("SELECT c_nationkey AS k, min(c_acctbal) AS min_x, min(c_custkey) AS min_y, max(c_acctbal) AS max_x, max(c_custkey) AS max_y FROM customer GROUP BY 1")
def layer_extent(spark, sf):
    return facts.extent(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("y")), "k")


@query(f"""
WITH RECURSIVE {_GRID}, s(dr, dc, o) AS (VALUES (-1,-1,0),(-1,0,1),(-1,1,2),(0,-1,3),(0,1,4),(1,-1,5),(1,0,6),(1,1,7)),
f AS (SELECT a.r, a.c, b.r AS tr, b.c AS tc, o, (a.z - b.z) / sqrt(CAST(dc * 30 AS DOUBLE) ** 2 + CAST(dr * 30 AS DOUBLE) ** 2) AS fall FROM g a JOIN s ON true JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc),
t AS (SELECT r, c, tr, tc FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY fall DESC, o) AS n FROM f WHERE fall > 0) WHERE n = 1),
p AS (SELECT r, c, r AS sr, c AS sc, 0 AS step FROM g WHERE c = 50 UNION ALL SELECT t.r, t.c, sr, sc, step + 1 FROM p JOIN t ON p.r = t.tr AND p.c = t.tc)
SELECT r AS row, c AS col, sr AS start_row, sc AS start_col, step FROM p""")
def upstream_trace(spark, sf):
    """From a column of the grid, all cells that drain through each of its cells."""
    cells = _grid_cells(spark, sf)
    return terrain.trace_upstream(terrain.receivers(cells, 30.0, 30.0), cells.where("col = 50")).select("row", "col", "start_row", "start_col", "step")

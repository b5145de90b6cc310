"""The operators on the driver's tables, each with SQL for the same rows.

The tables hold no rasters or maps, so keys stand in for them: events are cells of a grid of 100 columns
(event_id numbers them row by row), orders are scenes, lines of an order are vertices or samples of a line,
and customers, suppliers and parts are points or boxes placed by their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, geo, text, wkb
from ..operators import components, facts, graph, lines, raster, scenes, spatial, terrain
from ..operators.tables import connected_components, stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _grid_cells(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.lit(0).alias("aoi_id"), F.floor(e / 100).cast("int").alias("row"), (e % 100).cast("int").alias("col"), F.col("value").alias("z"), *more)


_GRID = "g AS (SELECT CAST(event_id // 100 AS INT) AS r, CAST(event_id % 100 AS INT) AS c, value AS z FROM events)"
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query("SELECT user_id, event_type, CAST(CAST(median(value) AS FLOAT) AS DOUBLE) AS v FROM events GROUP BY ALL")
def median_composite(spark, sf):
    found = raster.median_composite(table(spark, sf, "events"), ("value",), ("user_id", "event_type"))
    return found.select("user_id", "event_type", F.col("value").cast("double").alias("v"))


@query(f"WITH {_GRID} SELECT a.r AS row, a.c AS col, CAST(CAST(median(b.z) AS FLOAT) AS DOUBLE) AS z FROM g a JOIN g b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY ALL")
def speckle_median3(spark, sf):
    return raster.speckle_filter(_grid_cells(spark, sf), "z", 3).select("row", "col", F.col("z").cast("double").alias("z"))


@query("""
WITH b AS (SELECT event_id // 2 AS cell, event_id % 2 AS s, CAST(ln(value + 1) AS FLOAT) AS vv, CAST(ln(value + 2) AS FLOAT) AS vh FROM events)
SELECT p.cell, round(CAST(CAST((0.25::DOUBLE * (p.vv - q.vv) + 0.75::DOUBLE * (p.vh - q.vh)) AS FLOAT) AS DOUBLE), 4) AS ratio FROM b p JOIN b q ON p.cell = q.cell WHERE p.s = 0 AND q.s = 1""")
def log_ratio_combine(spark, sf):
    b = table(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("cell"), (F.col("event_id") % 2).alias("s"), F.log(F.col("value") + 1).cast("float").alias("vv"), F.log(F.col("value") + 2).cast("float").alias("vh"))
    both = b.where("s = 0").alias("p").join(b.where("s = 1").alias("q"), "cell")
    ratio = classify.combine(classify.log_ratio(F.col("p.vv"), F.col("q.vv")), classify.log_ratio(F.col("p.vh"), F.col("q.vh")), 0.25, 0.75)
    return both.select("cell", F.round(ratio.cast("double"), 4).alias("ratio"))


@query("SELECT event_id, round(1 / (1 + exp(greatest(-60.0::DOUBLE, least(60.0::DOUBLE, (ln(value + 1) - 4) / 1.5)))), 6) AS p FROM events")
def logistic_probability(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(classify.probability(F.log(F.col("value") + 1), 4.0, 1.5), 6).alias("p"))


@query("""
WITH x AS (SELECT event_type AS k, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1),
h AS (SELECT k, mn, (mx - mn) / 64 AS w, least(CAST(floor((value - mn) / ((mx - mn) / 64)) AS INT), 63) AS bin, count(*) AS c FROM events JOIN x ON event_type = k GROUP BY ALL),
s AS (SELECT *, mn + (bin + 0.5) * w AS x, sum(c) OVER (PARTITION BY k ORDER BY bin) AS w0, sum(c * (mn + (bin + 0.5) * w)) OVER (PARTITION BY k ORDER BY bin) AS s0, sum(c) OVER (PARTITION BY k) AS wt, sum(c * (mn + (bin + 0.5) * w)) OVER (PARTITION BY k) AS st FROM h),
b AS (SELECT *, round(CAST(w0 AS DOUBLE) * (wt - w0) * (s0 / w0 - (st - s0) / (wt - w0)) * (s0 / w0 - (st - s0) / (wt - w0)), 6) AS v FROM s WHERE wt > w0),
o AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY v DESC, bin) AS n FROM b)
SELECT k AS event_type, round(x, 4) AS threshold, 'otsu' AS method FROM o WHERE n = 1""")
def otsu_histogram(spark, sf):
    found = raster.otsu(table(spark, sf, "events").select(F.col("event_type").alias("aoi_id"), "value"), "value", bins=64, low=-1e9, high=1e9)
    return found.select(F.col("aoi_id").alias("event_type"), F.round("threshold", 4).alias("threshold"), "method")


@query("""SELECT event_type, CASE WHEN value < 5 THEN 'water' WHEN user_id % 7 = 0 THEN 'slope' WHEN value > 200 THEN 'shadow' WHEN user_id % 5 = 0 THEN 'hand' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY ALL""")
def exclusion_waterfall(spark, sf):
    u, v = F.col("user_id"), F.col("value")
    reasons = {"water": v < 5, "slope": u % 7 == 0, "shadow": v > 200, "hand": u % 5 == 0}
    return raster.exclusion_waterfall(table(spark, sf, "events"), reasons, "event_type")


_GRADIENT = f"""{_GRID}, d AS (SELECT r, c, z,
  coalesce((lead(z) OVER x - lag(z) OVER x) / 2, lead(z) OVER x - z, z - lag(z) OVER x) / 30 AS ge,
  coalesce((lead(z) OVER y - lag(z) OVER y) / 2, lead(z) OVER y - z, z - lag(z) OVER y) / 20 AS gs
  FROM g WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r))"""


@query(f"WITH {_GRADIENT} SELECT r AS row, c AS col, round(degrees(atan(sqrt(ge * ge + gs * gs))), 6) AS slope FROM d")
def slope_gradient(spark, sf):
    return terrain.slope_degrees(_grid_cells(spark, sf), 30.0, 20.0).select("row", "col", F.round("slope", 6).alias("slope"))


@query(f"WITH {_GRADIENT} SELECT r AS row, CAST(count(*) FILTER (abs(ge * sin(radians(100)) - gs * cos(radians(100))) > tan(radians(52))) AS BIGINT) AS n FROM d GROUP BY 1")
def shadow_mask_count(spark, sf):
    found = terrain.gradient(_grid_cells(spark, sf), 30.0, 20.0)
    return found.groupBy("row").agg(F.count_if(terrain.radar_shadow(100.0)).alias("n"))


@query(f"""
WITH {_GRID}, s(dr, dc, o) AS (VALUES (-1,-1,0),(-1,0,1),(-1,1,2),(0,-1,3),(0,1,4),(1,-1,5),(1,0,6),(1,1,7)),
f AS (SELECT a.r, a.c, b.r AS tr, b.c AS tc, o, (a.z - b.z) / sqrt(CAST(dc * 30 AS DOUBLE) ** 2 + CAST(dr * 30 AS DOUBLE) ** 2) AS fall FROM g a JOIN s ON true JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc),
t AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY fall DESC, o) AS n FROM f WHERE fall > 0)
SELECT g.r AS row, g.c AS col, tr AS to_row, tc AS to_col FROM g LEFT JOIN t ON g.r = t.r AND g.c = t.c AND n = 1""")
def d8_receiver(spark, sf):
    return terrain.receivers(_grid_cells(spark, sf), 30.0, 30.0).select("row", "col", "to_row", "to_col")


@query(f"""
WITH RECURSIVE {_GRID}, m AS (SELECT r, c, r * 1000 + c AS id FROM g WHERE z > 120),
l AS (SELECT id AS a, id AS b FROM m UNION SELECT l.a, y.id FROM l JOIN m x ON l.b = x.id JOIN m y ON y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1),
k AS (SELECT b AS id, min(a) AS top FROM l GROUP BY 1),
n AS (SELECT top, row_number() OVER (ORDER BY top) AS component, count(*) AS pixel_count FROM k GROUP BY top)
SELECT m.r AS row, m.c AS col, CAST(component AS INT) AS component, pixel_count FROM m JOIN k ON m.id = k.id JOIN n ON k.top = n.top WHERE pixel_count >= 3""")
def components_min_size(spark, sf):
    labelled = components.label_components(_grid_cells(spark, sf).where("z > 120").select("aoi_id", "row", "col"))
    return components.large_components(labelled, 3).select("row", "col", "component", "pixel_count")


_HEIGHT = "k AS (SELECT max(event_id) // 100 + 1 AS height FROM events)"


def _whole_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid that the events fill: one row."""
    height = (F.floor(F.max("event_id") / 100) + 1).cast("int")
    return table(spark, sf, "events").agg(height.alias("height")).select(F.lit(0).alias("aoi_id"), F.lit(0.0).alias("origin_x"), F.lit(0.0).alias("origin_y"), F.lit(1.0).alias("px_w"), F.lit(-1.0).alias("px_h"), "height", F.lit(100).alias("width"))


@query(f"WITH {_GRID}, {_HEIGHT} SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, z FROM (SELECT unnest(range(CAST(ceil(height / 2.5) AS BIGINT) + 2)) AS i FROM k), range(44) b(j) LEFT JOIN g ON g.r = floor((i + 0.5) * 2.5) AND g.c = floor((j + 0.5) * 2.5)")
def grid_resample_nearest(spark, sf):
    grid = _whole_grid(spark, sf)
    coarse = grid.withColumns({"px_w": F.lit(2.5), "px_h": F.lit(-2.5), "height": (F.ceil(F.col("height") / 2.5) + 2).cast("int"), "width": F.lit(44)})
    return raster.resample_nearest(_grid_cells(spark, sf), grid, coarse, "z").select("row", "col", "z")


@query(f"WITH {_GRID}, {_HEIGHT}, p AS (SELECT c_custkey AS k, (c_custkey * 37 % 1200) / 10.0::DOUBLE AS x, -((c_custkey * 9173 % (10 * height + 100)) / 10.0::DOUBLE) AS y FROM customer, k) SELECT k, z FROM p LEFT JOIN g ON g.c = floor(x) AND g.r = floor(-y)")
def raster_point_lookup(spark, sf):
    k, grid = F.col("c_custkey"), _whole_grid(spark, sf)
    points = table(spark, sf, "customer").crossJoin(F.broadcast(grid.select("height")))  # the grid is one row
    points = points.select(F.lit(0).alias("aoi_id"), k.alias("k"), (k * 37 % 1200 / 10.0).alias("x"), (-(k * 9173 % (10 * F.col("height") + 100) / 10.0)).alias("y"))
    return raster.point_lookup(points, _grid_cells(spark, sf), grid, "z").select("k", "z")


def _shape_stats(spark: SparkSession, sf: str, kind: str, rings) -> DataFrame:
    """Cells of a shape for each part; rings(x0, y0) are lists of corners, y0 counted down from the top of the whole grid."""
    grid, k = _whole_grid(spark, sf), F.col("p_partkey")
    at = lambda p: F.struct(p[0].cast("double").alias("x"), (-p[1]).cast("double").alias("y"))
    placed = table(spark, sf, "part").crossJoin(F.broadcast(grid.select("height")))  # the grid is one row
    x0, y0 = k * 37 % 92 + F.lit(0.2), k * 9173 % (F.col("height") - 8) + F.lit(0.2)
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.lit(i).alias("ring"), F.array(*map(at, ring), at(ring[0])).alias("points")) for n, i, ring in rings(x0, y0)])
    shapes = placed.select(F.lit(0).alias("aoi_id"), k.alias("shape_id"), F.lit(kind).alias("kind"), parts.alias("parts"))
    cells = _grid_cells(spark, sf).withColumnRenamed("z", "probability")
    found = spatial.footprints(shapes, cells, grid, 50.0)
    return found.select(F.col("shape_id").alias("k"), "pixel_count", F.round("flooded_fraction", 6).alias("flooded_fraction"), F.round("mean_probability", 8).alias("mean_probability"), "sampled_centroid")


_PLACED = "p_partkey AS k, p_partkey * 37 % 92 + 0.2::DOUBLE AS x0, p_partkey * 9173 % (height - 8) + 0.2::DOUBLE AS y0"


@query(f"""
WITH {_GRID}, {_HEIGHT}, b AS (SELECT {_PLACED}, p_size % 5 + 0.6::DOUBLE AS s FROM part, k),
h AS (SELECT k, count(z) AS n, count(*) FILTER (z >= 50) AS f, sum(z) AS t FROM b JOIN g ON g.c + 0.5 > x0 AND g.c + 0.5 < x0 + s AND g.r + 0.5 > y0 AND g.r + 0.5 < y0 + s GROUP BY 1)
SELECT b.k, coalesce(n, 0) AS pixel_count, round(CASE WHEN n > 0 THEN CAST(f AS DOUBLE) / n WHEN coalesce(g.z, 0) >= 50 THEN 1.0 ELSE 0.0 END, 6) AS flooded_fraction,
  round(CASE WHEN n > 0 THEN t / n ELSE coalesce(g.z, 0) END, 8) AS mean_probability, n IS NULL AS sampled_centroid
FROM b LEFT JOIN h ON b.k = h.k LEFT JOIN g ON h.k IS NULL AND g.c = floor(x0 + s / 2) AND g.r = floor(y0 + s / 2)""")
def bbox_pixel_stats(spark, sf):
    s = F.col("p_size") % 5 + F.lit(0.6)
    return _shape_stats(spark, sf, "Polygon", lambda x, y: [(0, 0, [(x, y), (x + s, y), (x + s, y + s), (x, y + s)])])


@query(f"""
WITH {_GRID}, {_HEIGHT}, b AS (SELECT {_PLACED} FROM part, k),
c AS (SELECT k, z, g.c + 0.5 - x0 AS x, g.r + 0.5 - y0 AS y FROM b JOIN g ON g.c + 0.5 > x0 AND g.c + 0.5 < x0 + 7 AND g.r + 0.5 > y0 AND g.r + 0.5 < y0 + 7)
SELECT k, count(*) AS pixel_count, round(CAST(count(*) FILTER (z >= 50) AS DOUBLE) / count(*), 6) AS flooded_fraction, round(avg(z), 8) AS mean_probability, false AS sampled_centroid
FROM c WHERE NOT (x > 3 AND x < 5 AND y < 4) AND NOT (x > 1 AND x < 3 AND y > 1 AND y < 3) AND NOT (y > 4 AND x - 4.1::DOUBLE > (y - 4) * 2.9::DOUBLE / 3) GROUP BY 1""")
def concave_pixel_stats(spark, sf):
    """Shapes with a bay, a slanted side and a hole."""
    outer = [(0, 0), (3, 0), (3, 4), (5, 4), (5, 0), (7, 0), (7, 4), (4.1, 4), (7, 7), (0, 7)]
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]
    moved = lambda ring, x, y: [(x + a, y + b) for a, b in ring]
    return _shape_stats(spark, sf, "Polygon", lambda x, y: [(0, 0, moved(outer, x, y)), (0, 1, moved(hole, x, y))])


@query(f"""
WITH {_GRID}, {_HEIGHT}, b AS (SELECT s_suppkey AS k, s_suppkey * 37 % 88 + 0.3::DOUBLE AS x1, -(s_suppkey * 9173 % (height - 12) + 0.4::DOUBLE) AS y1, 2.0::DOUBLE + s_suppkey % 7 AS dx, -(1.0::DOUBLE + s_suppkey % 9) AS dy FROM supplier, k),
c AS (SELECT k, z, x1, y1, dx, dy, g.c + 0.5::DOUBLE AS x, -(g.r + 0.5::DOUBLE) AS y FROM b JOIN g ON g.c BETWEEN x1 - 3 AND x1 + dx + 3 AND g.r BETWEEN -y1 - 3 AND -(y1 + dy) + 3),
t AS (SELECT *, greatest(0, least(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS t FROM c)
SELECT k, count(*) AS pixel_count, round(sum(z), 6) AS total FROM t WHERE (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2 < 1.7::DOUBLE ** 2 GROUP BY 1""")
def buffer_cells(spark, sf):
    """Cells whose centre lies within a distance of a line."""
    grid, k = _whole_grid(spark, sf), F.col("s_suppkey")
    lines_ = table(spark, sf, "supplier").crossJoin(F.broadcast(grid.select("height")))  # the grid is one row
    x1, y1 = k * 37 % 88 + F.lit(0.3), -(k * 9173 % (F.col("height") - 12) + F.lit(0.4))
    dx, dy = k % 7 + F.lit(2.0), -(k % 9 + F.lit(1.0))  # x2 - x1 is rounded, and cells may lie just at the distance
    x2, y2 = x1 + dx, y1 + dy
    side = F.struct(x1.alias("x1"), y1.alias("y1"), dx.alias("dx"), dy.alias("dy"))
    box = F.struct(x1.alias("min_x"), y2.alias("min_y"), x2.alias("max_x"), y1.alias("max_y"))
    shapes = lines_.select(F.lit(0).alias("aoi_id"), k.alias("shape_id"), box.alias("box"), F.array(side).alias("edges"))
    hits = spatial.covered_cells(shapes, grid, lambda x, y: wkb.distance_squared(F.col("edges"), x, y, lambda e: (e["dx"], e["dy"])) < 1.7**2, 1.7)
    found = hits.join(_grid_cells(spark, sf).select("row", "col", "z"), ["row", "col"])
    return found.groupBy(F.col("shape_id").alias("k")).agg(F.count("*").alias("pixel_count"), F.round(F.sum("z"), 6).alias("total"))


@query("""
WITH w AS (SELECT l_orderkey, CASE WHEN l_discount = 0.03 THEN NULL ELSE l_discount END AS v, CASE WHEN l_quantity > 10 THEN l_quantity - 10 ELSE 1.0 END AS w FROM lineitem)
SELECT l_orderkey, round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 9) AS mean_p, max(v) AS max_p, round(CAST(count(*) FILTER (v >= 0.05) AS DOUBLE) / count(*), 6) AS share FROM w GROUP BY 1""")
def edge_flood_aggregate(spark, sf):
    d = F.col("l_discount")
    samples = table(spark, sf, "lineitem").select("l_orderkey", F.when(d != 0.03, d).alias("probability"), F.greatest(F.col("l_quantity") - 10, F.lit(0.0)).alias("spacing"))
    found = lines.edge_probability(samples, ["l_orderkey"], threshold=0.05)
    return found.select("l_orderkey", F.round("mean_probability", 9).alias("mean_p"), F.col("max_probability").alias("max_p"), F.round("flooded_fraction", 6).alias("share"))


@query("""
WITH f AS (SELECT l_orderkey, round(max(l_discount) * 5, 4) AS f, min(l_linenumber) = 1 AS c FROM lineitem GROUP BY 1),
t AS (SELECT *, CASE WHEN f = 0 OR least(abs(f - 0.05), abs(f - 0.25)) >= 0.2 THEN 'high' WHEN least(abs(f - 0.05), abs(f - 0.25)) >= 0.05 THEN 'medium' ELSE 'low' END AS t FROM f)
SELECT l_orderkey, CASE WHEN f >= 0.25 THEN 'affected' WHEN f >= 0.05 THEN 'possibly_affected' ELSE 'unaffected' END AS status, CASE WHEN c AND t = 'high' THEN 'medium' ELSE t END AS confidence, CASE WHEN f >= 0.05 THEN 'possibly_impacted' ELSE 'unaffected' END AS bridge FROM t""")
def status_confidence(spark, sf):
    f = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.max("l_discount") * 5, 4).alias("f"), (F.min("l_linenumber") == 1).alias("c"))
    return f.select("l_orderkey", classify.status(F.col("f")).alias("status"), classify.confidence(F.col("f"), F.col("c")).alias("confidence"), classify.bridge_status(F.col("f")).alias("bridge"))


_EDGES = "e AS (SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, sum(l_quantity) AS m, sum(l_discount * l_quantity) / sum(l_quantity) AS p, max(l_discount) AS x, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) AS f FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    d, q = F.col("l_discount"), F.col("l_quantity")
    segs = table(spark, sf, "lineitem").select(F.lit(0).alias("aoi_id"), F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), q.alias("length_m"), d.alias("flood_probability"), d.alias("max_probability"), F.when(d >= 0.05, q).otherwise(0.0).alias("flooded_length_m"))
    return lines.merge_edges(segs)


@query(f"WITH {_EDGES} SELECT u, v, round(m, 4) AS length_m, round(p, 9) AS p, x AS max_p, round(f, 4) AS flooded_m FROM e")
def duplicate_edge_merge(spark, sf):
    return _edges(spark, sf).select("u", "v", F.round("length_m", 4).alias("length_m"), F.round("flood_probability", 9).alias("p"), F.col("max_probability").alias("max_p"), F.round("flooded_length_m", 4).alias("flooded_m"))


@query(f"WITH {_EDGES}, k AS (SELECT * FROM e WHERE p < 0.05), n AS (SELECT u AS node FROM e UNION SELECT v FROM e), r AS (SELECT u AS node FROM k UNION SELECT v FROM k) SELECT node, node IN (SELECT node FROM r) AS reached FROM n")
def severed_edges(spark, sf):
    edges = _edges(spark, sf)
    ends = lambda e: e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    left = ends(edges.where("flood_probability < 0.05")).withColumn("reached", F.lit(True))
    return ends(edges).join(left, "node", "left").select("node", F.coalesce("reached", F.lit(False)).alias("reached"))


@query(f"WITH {_EDGES}, n AS (SELECT u AS node FROM e UNION ALL SELECT v FROM e) SELECT node AS node_id, count(*) AS degree FROM n GROUP BY 1")
def node_degree(spark, sf):
    return graph.degrees(_edges(spark, sf)).select("node_id", "degree")


_SEGMENTS = f"""s AS (SELECT l_orderkey AS k, row_number() OVER w AS i, l_extendedprice AS x, l_quantity AS y, lead(l_extendedprice) OVER w AS x2, lead(l_quantity) OVER w AS y2
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}, l_quantity)),
d AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len FROM s WHERE x2 IS NOT NULL)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "lineitem").withColumns({"x": F.col("l_extendedprice"), "y": F.col("l_quantity")})
    return lines.segments(points, ["l_orderkey"], [*_LINE_ORDER, "l_quantity"])


@query(f"WITH {_SEGMENTS} SELECT k, round(x, 2) AS x, round(x2, 2) AS x2, round(len, 4) AS length, round(sum(len) OVER (PARTITION BY k ORDER BY i), 4) AS upto FROM d")
def polyline_segments(spark, sf):
    return _segments(spark, sf).select(F.col("l_orderkey").alias("k"), F.round("x", 2).alias("x"), F.round("x2", 2).alias("x2"), F.round("length", 4).alias("length"), F.round("end", 4).alias("upto"))


@query(f"WITH {_SEGMENTS}, n AS (SELECT *, greatest(1, CAST(ceil(len / 5000) AS INT)) AS n FROM d) SELECT k, i, round(x + (j + 0.5::DOUBLE) / n * (x2 - x), 7) AS sx, round(y + (j + 0.5::DOUBLE) / n * (y2 - y), 7) AS sy, round(len / n, 6) AS weight FROM (SELECT *, unnest(generate_series(0, n - 1)) AS j FROM n)")
def segment_sampling(spark, sf):
    from pyspark.sql import Window as W

    segs = _segments(spark, sf).withColumn("i", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LINE_ORDER, "l_quantity")).cast("long"))
    return lines.sample_segments(segs, 5000.0).select(F.col("l_orderkey").alias("k"), "i", F.round("sx", 7).alias("sx"), F.round("sy", 7).alias("sy"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_SEGMENTS}, t AS (SELECT k, sum(len) AS t FROM d GROUP BY 1) SELECT k, CAST(greatest(2, ceil(t / 7000) + 1) AS BIGINT) AS stations, round(t, 3) AS total FROM t WHERE t > 0")
def line_stations(spark, sf):
    found = lines.sample_lines(_segments(spark, sf), 7000.0, ["l_orderkey"])
    return found.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("stations"), F.round(F.sum("spacing"), 3).alias("total"))


@query("WITH p AS (SELECT c_custkey, c_nationkey, round_even(c_acctbal / 300 / 0.01, 0) AS x, round_even(c_acctbal / 7 / 0.01, 0) AS y FROM customer) SELECT c_custkey, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY x, y) - 1 AS INT) AS node_id FROM p")
def vertex_keys(spark, sf):
    points = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("aoi_id"), (F.col("c_acctbal") / 300).alias("x"), (F.col("c_acctbal") / 7).alias("y"))
    return lines.vertex_keys(points).select("c_custkey", "node_id")


_POINTS = """c AS (SELECT c_custkey AS k, c_custkey * 37 % 997 AS x, c_custkey * 91 % 991 AS y FROM customer), s AS (SELECT s_suppkey AS k, s_suppkey * 53 % 997 AS x, s_suppkey * 71 % 991 AS y FROM supplier)"""


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    at = lambda k, a, b: (F.lit(0).alias("aoi_id"), F.col(k).alias(k), (F.col(k) * a % 997).cast("double").alias("x"), (F.col(k) * b % 991).cast("double").alias("y"))
    return table(spark, sf, "customer").select(*at("c_custkey", 37, 91)), table(spark, sf, "supplier").select(*at("s_suppkey", 53, 71))


@query(f"WITH {_POINTS}, j AS (SELECT c.k, s.k AS n, (c.x - s.x) ** 2 + (c.y - s.y) ** 2 AS d FROM c JOIN s ON (c.x - s.x) ** 2 + (c.y - s.y) ** 2 <= 10000), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, n) AS o FROM j) SELECT c.k, b.n AS node, round(sqrt(d), 6) AS distance FROM c LEFT JOIN b ON c.k = b.k AND o = 1")
def nearest_snap(spark, sf):
    customers, suppliers = _points(spark, sf)
    found = spatial.nearest(customers, suppliers, 100.0, "c_custkey", "s_suppkey")
    return found.select(F.col("c_custkey").alias("k"), F.col("s_suppkey").alias("node"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_POINTS} SELECT s.k, count(c.k) AS n FROM s LEFT JOIN c ON (c.x - s.x) ** 2 + (c.y - s.y) ** 2 <= 3600 GROUP BY 1")
def radius_count(spark, sf):
    customers, suppliers = _points(spark, sf)
    return spatial.count_within(suppliers, customers, 60.0, "s_suppkey").select(F.col("s_suppkey").alias("k"), "n")


_SCENES = "sc AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS t, o_orderstatus AS d, o_custkey AS orb, o_orderpriority AS pri, o_totalprice AS price FROM orders)"


def _scenes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("scene_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("acquisition_time"), F.col("o_orderstatus").alias("orbit_direction"), F.col("o_custkey").alias("relative_orbit"), F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") % 100, 2).alias("cloud_pct")
    )


@query(f"WITH {_SCENES}, p AS (SELECT a.id AS post_id, b.id AS pre_id, b.t, row_number() OVER (PARTITION BY a.id ORDER BY b.t DESC, b.id) AS n FROM sc a JOIN sc b ON a.orb = b.orb AND a.d = b.d AND b.t < a.t WHERE a.pri LIKE '1%' AND b.pri NOT LIKE '1%') SELECT post_id, pre_id, CAST(n AS INT) AS rank FROM p WHERE n <= 3")
def scene_pairing_topk(spark, sf):
    s = _scenes(spark, sf)
    urgent = F.col("priority").startswith("1")
    return scenes.pair(s.where(urgent), s.where(~urgent), 3).select("post_id", F.col("scene_id").alias("pre_id"), "rank")


@query(f"WITH {_SCENES}, p AS (SELECT *, row_number() OVER (PARTITION BY pri ORDER BY t, id) AS n FROM sc WHERE substr(t, 1, 10) >= '1996-06-01') SELECT pri AS priority, id AS scene_id FROM p WHERE n = 1")
def first_post_scene(spark, sf):
    return scenes.first_post(_scenes(spark, sf), "1996-06-01", ["priority"]).select("priority", "scene_id")


@query(f"WITH {_SCENES}, p AS (SELECT *, row_number() OVER (PARTITION BY orb ORDER BY substr(t, 1, 10) < '1996-06-01', round(price % 100, 2), id) AS n FROM sc) SELECT orb AS customer, id AS scene_id FROM p WHERE n = 1")
def clearest_scene(spark, sf):
    return scenes.clearest(_scenes(spark, sf), "1996-06-01", ["relative_orbit"]).select(F.col("relative_orbit").alias("customer"), "scene_id")


@query("""WITH t AS (SELECT l_returnflag AS k, count(*) AS total, count(*) FILTER (l_linenumber <> 0) AS valid FROM lineitem GROUP BY 1)
SELECT k, CAST(s AS INT) AS scl, count(l_linenumber) AS n, total, round(100.0 * valid / total, 2) AS valid_pct FROM t CROSS JOIN range(12) r(s) LEFT JOIN lineitem ON l_returnflag = k AND l_linenumber = s GROUP BY ALL""")
def scl_histogram(spark, sf):
    found = raster.scl_histogram(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("scl")), "k")
    return found.select("k", "scl", "n", "total", "valid_pct")


@query("SELECT p_brand, round(100.0::DOUBLE * count(*) FILTER (p_size % 12 IN (8, 9, 10)) / nullif(count(*) FILTER (p_size % 12 <> 0), 0), 2) AS cloud_pct FROM part GROUP BY 1")
def cloud_pct(spark, sf):
    return raster.cloud_cover(table(spark, sf, "part").select("p_brand", (F.col("p_size") % 12).alias("scl")), "p_brand")


@query("""
WITH x AS (SELECT event_type AS k, value - 100 AS v, user_id % 4 AS m FROM events)
SELECT k, count(*) AS pixels, round(100.0::DOUBLE * count(*) FILTER (NOT (m > 0 AND v > -60)) / count(*), 4) AS nodata_pct,
  round(quantile_cont(v, 0.01) FILTER (m > 0 AND v > -60), 4) AS p1, round(quantile_cont(v, 0.5) FILTER (m > 0 AND v > -60), 4) AS p50, round(quantile_cont(v, 0.99) FILTER (m > 0 AND v > -60), 4) AS p99,
  round(100.0::DOUBLE * count(*) FILTER (m > 0 AND v > 10) / count(*) FILTER (m > 0 AND v > -60), 4) AS above_pct FROM x GROUP BY 1""")
def band_percentiles(spark, sf):
    cells = table(spark, sf, "events").select(F.col("event_type").alias("k"), (F.col("value") - 100).alias("vv"), (F.col("user_id") % 4).alias("mask"))
    s = raster.band_stats(cells, ("vv",), "mask", "k")
    return s.select("k", "pixels", *[F.round(c, 4).alias(c) for c in ("nodata_pct", "p1", "p50", "p99", "above_pct")])


@query("""
WITH b AS (SELECT event_id // 2 AS cell, event_id % 2 AS s, user_id % 5 AS m, value / 10 - 20 AS v FROM events),
j AS (SELECT p.cell % 10 AS k, p.v - q.v AS d, p.m > 0 AND q.m > 0 AND p.v > -60 AND q.v > -60 AS ok FROM b p JOIN b q ON p.cell = q.cell AND p.s = 0 AND q.s = 1)
SELECT k, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 4) AS overlap_pct, round(quantile_cont(d, 0.5) FILTER (ok), 4) AS p50, round(100.0::DOUBLE * count(*) FILTER (ok AND d < -3) / count(*) FILTER (ok), 4) AS below_drop_pct FROM j GROUP BY 1""")
def log_ratio_quality(spark, sf):
    e = F.col("event_id")
    b = table(spark, sf, "events").select((F.floor(e / 2) % 10).alias("aoi_id"), F.floor(e / 2).alias("row"), F.lit(0).alias("col"), (e % 2).alias("s"), (F.col("user_id") % 5).alias("mask"), (F.col("value") / 10 - 20).alias("vv"))
    s = raster.log_ratio_stats(b.where("s = 0"), b.where("s = 1"), ("vv",))
    return s.select(F.col("aoi_id").alias("k"), *[F.round(c, 4).alias(c) for c in ("overlap_pct", "p50", "below_drop_pct")])


@query("""SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM (SELECT 1000000 + c_custkey AS node, -(n_regionkey + 1) AS component FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 2000000000 + s_suppkey, -(n_regionkey + 1) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_nationkey, -(n_regionkey + 1) FROM nation UNION ALL SELECT DISTINCT -(n_regionkey + 1), -(n_regionkey + 1) FROM nation)""")
def reachability_components(spark, sf):
    n = table(spark, sf, "nation").select((-(F.col("n_regionkey") + 1)).cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") + 1_000_000).alias("b"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") + 2_000_000_000).alias("b"))
    return connected_components(n.union(c).union(s))


_PATHS = """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, 1.0 + n_nationkey % 3 AS w FROM nation)
SELECT CAST(r + 1000 AS INT) AS node_id, 0.0::DOUBLE AS distance FROM n WHERE r < 2 GROUP BY 1 UNION ALL SELECT CAST(k AS INT), CAST(w AS DOUBLE) FROM n WHERE r < 2
UNION ALL SELECT CAST(10000 + c_custkey AS INT), CAST(w + c_custkey % 5 AS DOUBLE) FROM customer JOIN n ON c_nationkey = k WHERE r < 2"""


def _paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf, "nation").select(F.lit(0).alias("aoi_id"), (F.col("n_regionkey") + 1000).cast("int").alias("u"), F.col("n_nationkey").cast("int").alias("v"), (1.0 + F.col("n_nationkey") % 3).alias("length_m"))
    c = table(spark, sf, "customer").select(F.lit(0).alias("aoi_id"), F.col("c_nationkey").cast("int").alias("u"), (F.col("c_custkey") + 10_000).cast("int").alias("v"), (F.col("c_custkey") % 5).cast("double").alias("length_m"))
    return n.union(c), spark.range(1000, 1002).select(F.lit(0).alias("aoi_id"), F.col("id").cast("int").alias("node_id"))


@query(_PATHS)
def shortest_path(spark, sf):
    return graph.distances(*_paths(spark, sf)).select("node_id", "distance")


@query(_PATHS)
def shortest_path_relax(spark, sf):
    return graph.relax(*_paths(spark, sf), 2).select("node_id", "distance")


@query("""
WITH p AS (SELECT s_suppkey AS k, s_nationkey AS a, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'newly_cut_off' WHEN 1 THEN 'still_connected' ELSE 'no_pre_event_access' END AS c, CAST(floor(abs(s_acctbal) / 1000) AS INT) AS b FROM supplier),
q AS (SELECT *, b + 2.0 * CASE c WHEN 'newly_cut_off' THEN 1.0 WHEN 'no_pre_event_access' THEN 0.5 ELSE 0.0 END AS s, CASE c WHEN 'newly_cut_off' THEN 1 WHEN 'still_connected' THEN 2 ELSE 3 END AS o FROM p)
SELECT k, CAST(s AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY a ORDER BY s DESC, o, name, k) AS INT) AS rank FROM q""")
def priority_rank(spark, sf):
    k = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select(k.alias("settlement_id"), F.col("s_nationkey").alias("aoi_id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "newly_cut_off").when(k % 3 == 1, "still_connected").otherwise("no_pre_event_access").alias("class"), F.floor(F.abs("s_acctbal") / 1000).alias("b"))
    p = p.withColumn("priority_score", classify.priority_score(F.col("b"), F.col("class")))
    return graph.priority_rank(p).select(F.col("settlement_id").alias("k"), F.col("priority_score").alias("score"), F.col("priority_rank").alias("rank"))


@query("SELECT 'facility' AS kind, c_custkey AS id, coalesce(nullif(c_name, ''), 'amenity/' || c_mktsegment) AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'place', s_suppkey, s_name FROM supplier")
def destination_union(spark, sf):
    c = table(spark, sf, "customer").withColumn("tags", F.create_map(F.lit("amenity"), "c_mktsegment"))
    c = c.where(classify.has_tag(F.col("tags"), ("amenity",), ("BUILDING", "MACHINERY")))
    name = F.coalesce(F.nullif("c_name", F.lit("")), F.concat(F.lit("amenity/"), F.element_at("tags", F.lit("amenity"))))
    return c.select(F.lit("facility").alias("kind"), F.col("c_custkey").alias("id"), name.alias("name")).union(table(spark, sf, "supplier").select(F.lit("place"), "s_suppkey", "s_name"))


@query("""
WITH c AS (SELECT o_orderpriority AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) AS u FROM orders GROUP BY 1)
SELECT k, 'orders_total' AS id, CAST(n AS VARCHAR) AS value, 'int' AS value_type, 'count' AS unit, 'damage' AS source_stage FROM c UNION ALL SELECT k, 'orders_filled', CAST(f AS VARCHAR), 'int', 'count', 'damage' FROM c UNION ALL SELECT k, 'customers', CAST(u AS VARCHAR), 'int', 'persons', 'damage' FROM c""")
def facts_unpivot(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("orders_total"), F.count_if(F.col("o_orderstatus") == "F").alias("orders_filled"), F.count_distinct("o_custkey").alias("customers"))
    return facts.facts(c, {"orders_total": "count", "orders_filled": "count", "customers": "persons"}, "damage", "k")


_STATUS = "CASE WHEN l_discount >= 0.08 THEN 'affected' WHEN l_discount >= 0.04 THEN 'possibly_affected' ELSE 'unaffected' END"


@query(f"""
WITH x AS (SELECT l_returnflag AS k, {_STATUS} AS s, l_quantity AS q FROM lineitem)
SELECT k, count(*) AS roads_total, count(*) FILTER (s = 'affected') AS roads_affected, count(*) FILTER (s = 'possibly_affected') AS roads_possibly_affected, round(sum(q), 4) AS road_km_total, round(sum(CASE WHEN s = 'affected' THEN q ELSE 0 END), 4) AS road_km_affected, round(sum(q / 2), 4) AS road_km_flooded FROM x GROUP BY 1""")
def damage_counts(spark, sf):
    d = F.col("l_discount")
    status = F.when(d >= 0.08, "affected").when(d >= 0.04, "possibly_affected").otherwise("unaffected")
    roads = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("aoi_id"), status.alias("status"), F.col("l_quantity").alias("length_km"), (F.col("l_quantity") / 2).alias("flooded_length_km"), F.lit("road_bridge").alias("structure"))
    found = facts.damage_counts(roads.limit(0), roads, roads.limit(0))
    return found.select(F.col("aoi_id").alias("k"), "roads_total", "roads_affected", "roads_possibly_affected", "road_km_total", "road_km_affected", "road_km_flooded")


@query("SELECT n_name AS k, c AS class, count(c_custkey) AS n FROM nation CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('NONE')) v(c) LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = c WHERE n_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY ALL")
def class_histogram(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("k"), F.col("c_mktsegment").alias("class"))
    return facts.class_histogram(c, ("BUILDING", "MACHINERY", "NONE"), "k")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IN ('1', '5', '7')")
def props_map_filter(spark, sf):
    e = table(spark, sf, "events").withColumn("tags", F.from_json("props", "map<string,string>"))
    return e.where(classify.has_tag(F.col("tags"), ("k", "none"), ("1", "5", "7"))).select("event_id", F.element_at("tags", F.lit("k")).alias("k"))


@query("SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '०१२३४५६७८९') AS digits FROM orders")
def devanagari_digits(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.devanagari(F.col("o_orderkey").cast("string")).alias("digits"))


@query("SELECT o_orderkey, 'Order ' || o_orderkey || ' of ' || o_custkey || ' is ' || o_orderstatus || ' {other}' AS line FROM orders")
def template_render(spark, sf):
    values = F.create_map(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit("c"), F.col("o_custkey").cast("string"), F.lit("s"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", text.render(F.lit("Order {k} of {c} is {s} {other}"), values).alias("line"))


@query(r"""WITH d AS (SELECT conv_id, turn, coalesce(text, '') || ' {conv} {role} {turn_9}' AS t FROM conversations)
SELECT conv_id, turn, CAST(len(regexp_extract_all(regexp_replace(t, '\{[a-zA-Z0-9_]+\}', '', 'g'), '[0-9]+')) AS INT) AS numerals, list_contains(regexp_extract_all(t, '\{([a-zA-Z0-9_]+)\}', 1), 'turn_9') AS unknown FROM d""")
def draft_validate(spark, sf):
    draft, known = F.concat(F.coalesce("text", F.lit("")), F.lit(" {conv} {role} {turn_9}")), F.array(F.lit("conv"), F.lit("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(text.loose_numerals(draft)).alias("numerals"), F.array_contains(text.unknown_placeholders(draft, known), "turn_9").alias("unknown"))


@query("SELECT conv_id, turn, CASE WHEN lower(text) LIKE '%cut off%' OR lower(text) LIKE '%isolation%' OR text LIKE '%बस्ती%' THEN 'isolation' ELSE 'summary' END AS intent FROM conversations")
def intent_routing(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


@query("""
WITH p AS (SELECT c_custkey AS k, CAST(c_custkey * 37 % 359 - 179 AS DOUBLE) AS lon, CAST(c_custkey * 91 % 159 - 79 AS DOUBLE) AS lat FROM customer)
SELECT k, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(trunc((lon + 180) / 6) AS INT) + 1 AS epsg, round(6371.0::DOUBLE ** 2 * abs(radians(lon + 0.2) - radians(lon)) * abs(sin(radians(lat + 0.2)) - sin(radians(lat))), 2) AS km2 FROM p""")
def utm_zone(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("k"), (k * 37 % 359 - 179).cast("double").alias("lon"), (k * 91 % 159 - 79).cast("double").alias("lat"))
    lon, lat = F.col("lon"), F.col("lat")
    return p.select("k", geo.utm_epsg(lon, lat).alias("epsg"), geo.bbox_area_km2(lon, lat, lon + 0.2, lat + 0.2).alias("km2"))


@query("""
WITH p AS (SELECT c_custkey AS k, c_custkey * 37 % 357 - 179 AS lon, c_custkey * 91 % 157 - 79 AS lat FROM customer)
SELECT k, 'Copernicus_DSM_COG_10_' || CASE WHEN y >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(y) AS VARCHAR), 2, '0') || '_00_' || CASE WHEN x >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(x) AS VARCHAR), 3, '0') || '_00_DEM' AS tile
FROM p, LATERAL (SELECT unnest(generate_series(lat, lat + 1)) AS y), LATERAL (SELECT unnest(generate_series(lon, lon + 1)) AS x)""")
def dem_tiles(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("k"), (k * 37 % 357 - 179 + 0.25).alias("min_lon"), (k * 91 % 157 - 79 + 0.25).alias("min_lat"))
    p = p.withColumns({"max_lon": F.col("min_lon") + 1.5 - 0.5, "max_lat": F.col("min_lat") + 1.0})
    return geo.dem_tiles(p).select("k", F.col("tile_id").alias("tile"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS start, strftime(date_trunc('day', o_orderdate) + INTERVAL 12 DAY + INTERVAL 60 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS later FROM orders")
def iso_dates(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", text.iso_utc(day).alias("start"), text.shifted(day, 12, 60).alias("later"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11' AND lower(p_name || ' ' || p_type) LIKE '%widget%' OR lower(p_name || ' ' || p_type) LIKE '%ring eco%'")
def triage_search(spark, sf):
    body = F.concat_ws(" ", "p_name", "p_type")
    hit = text.matches(F.col("p_brand"), "Brand#11", body, "WIDGET") | text.matches(F.col("p_brand"), "all", body, "Ring Eco")
    return table(spark, sf, "part").where(hit).select("p_partkey", "p_name")


@query("SELECT event_type, count(*) FILTER (value < 10 AND user_id < 60) AS water, count(*) FILTER (value > 15) AS steep, round(sum(CASE WHEN value < 10 AND user_id < 60 OR value > 15 THEN 0 ELSE value END), 2) AS kept FROM events GROUP BY 1")
def mask_counts(spark, sf):
    v, u = F.col("value"), F.col("user_id")
    water, steep = classify.permanent_water(v, u, 9.999999, 59), classify.above(v, 15)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(water).alias("water"), F.count_if(steep).alias("steep"), F.round(F.sum(classify.without(v, water, steep)), 2).alias("kept"))


@query(f"""
WITH RECURSIVE {_GRID}, s(dr, dc, o) AS (VALUES (-1,-1,0),(-1,0,1),(-1,1,2),(0,-1,3),(0,1,4),(1,-1,5),(1,0,6),(1,1,7)),
f AS (SELECT a.r, a.c, b.r AS tr, b.c AS tc, o, (a.z - b.z) / sqrt(CAST(dc * 30 AS DOUBLE) ** 2 + CAST(dr * 30 AS DOUBLE) ** 2) AS fall FROM g a JOIN s ON true JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc),
t AS (SELECT r, c, tr, tc FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY fall DESC, o) AS n FROM f WHERE fall > 0) WHERE n = 1),
p AS (SELECT r, c FROM g UNION ALL SELECT t.tr, t.tc FROM p JOIN t ON p.r = t.r AND p.c = t.c),
n AS (SELECT r, c, count(*) AS accumulation FROM p GROUP BY ALL),
w(r, c, d, src) USING KEY (r, c) AS (
  SELECT r, c, 0 AS d, CAST(r AS BIGINT) * 1000 + c AS src FROM n WHERE accumulation >= 20
  UNION SELECT g.r, g.c, w.d + 1, min(w.src) FROM w JOIN s ON true JOIN g ON g.r = w.r + dr AND g.c = w.c + dc ANTI JOIN recurring.w v ON v.r = g.r AND v.c = g.c GROUP BY g.r, g.c, w.d)
SELECT g.r AS row, g.c AS col, n.accumulation, g.z - b.z AS hand FROM g JOIN n ON n.r = g.r AND n.c = g.c LEFT JOIN w ON w.r = g.r AND w.c = g.c LEFT JOIN g b ON b.r = w.src // 1000 AND b.c = w.src % 1000""")
def drainage_hand(spark, sf):
    return terrain.drainage(_grid_cells(spark, sf), 20, 30.0, 30.0, side=64).select("row", "col", "accumulation", "hand")


@query(None)
def contracted_graph(spark, sf):
    """The graph of parts and suppliers without its nodes of degree two; checked by golden tests."""
    edges = stage(_edges(spark, sf))
    nodes = edges.select("aoi_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return graph.contract(nodes, edges)[1].select("u", "v", F.round("length_m", 4).alias("length_m"), F.round("flood_probability", 6).alias("p"))


@query(None)
def mask_polygons(spark, sf):
    """Outlines of the components of the grid of events; checked by golden tests."""
    labelled = components.label_components(_grid_cells(spark, sf).where("z > 120").select("aoi_id", "row", "col"))
    grid = spark.sql("SELECT 0 AS aoi_id, 0D AS origin_x, 0D AS origin_y, 1D AS px_w, -1D AS px_h")
    return components.polygons(components.large_components(labelled, 3).drop("pixel_count"), grid).select("component", "part", "pixel_count", "geometry")

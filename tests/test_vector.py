import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrograin.functions import wkb
from hydrograin.operators import graph, lines, scenes, spatial
from hydrograin.errors import FloodError
from hydrograin.plans import damage as damage_plan
from hydrograin.plans import isolation as isolation_plan

GRID = "SELECT 'a' AS aoi_id, 85.0D AS origin_x, 27.1D AS origin_y, 0.01D AS px_w, -0.01D AS px_h, 10 AS height, 10 AS width"


def flood(spark, rows, cols):
    return spark.createDataFrame([("a", r, c, 1.0 if r in rows and c in cols else 0.0) for r in range(10) for c in range(10)], "aoi_id string, row int, col int, probability float")


def box(r0, c0, r1, c1, inset=1e-4):
    w, e, n, s = 85 + c0 * 0.01 + inset, 85 + (c1 + 1) * 0.01 - inset, 27.1 - r0 * 0.01 - inset, 27.1 - (r1 + 1) * 0.01 + inset
    return [[[w, s], [e, s], [e, n], [w, n], [w, s]]]


def layers(spark, rows):
    """rows: (feature_type, osm_id, tags, kind, coordinates)."""
    df = spark.createDataFrame([("a", t, i, "way", g, k, bytearray(wkb.encode(k, c)), False) for t, i, g, k, c in rows], "aoi_id string, feature_type string, osm_id long, osm_type string, tags map<string,string>, geom_type string, geom binary, clipped boolean")
    df = df.withColumn("g", wkb.from_wkb(F.col("geom")))
    return df.select("*", F.col("g.kind").alias("kind"), F.col("g.parts").alias("parts")).drop("g", "geom")


def test_footprint_over_flood(spark):
    df = layers(spark, [("building", 1, {"building": "yes"}, "Polygon", box(0, 0, 6, 6)), ("building", 2, {"building": "yes"}, "Polygon", [[[85.02 + 1e-4, 27.08 - 1e-4], [85.021, 27.08 - 1e-4], [85.021, 27.079], [85.02 + 1e-4, 27.079], [85.02 + 1e-4, 27.08 - 1e-4]]]), ("building", 3, {"building": "yes"}, "Polygon", box(8, 8, 8, 8))])
    got = {r.osm_id: r for r in damage_plan.buildings(df, flood(spark, {2, 3, 4}, {2, 3, 4}), spark.sql(GRID)).collect()}
    assert (got[1].pixels, got[1].status, got[1].confidence) == (49, "possibly_affected", "medium") and got[1].flooded_fraction == round(9 / 49, 4)
    assert (got[2].pixels, got[2].sampled, got[2].flooded_fraction, got[2].confidence) == (0, "centroid", 1.0, "medium")
    assert (got[3].pixels, got[3].status, got[3].confidence) == (1, "unaffected", "high")


def test_footprints_against_brute_force(spark):
    rng = np.random.default_rng(7)
    shapes = []
    for k in range(30):
        x, y, s = 85 + rng.random() * 0.09, 27 + rng.random() * 0.09, 0.002 + rng.random() * 0.04
        shapes.append(("building", k, {}, "Polygon", [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]))
    p = rng.random((10, 10)).astype("f4")
    cells = spark.createDataFrame([("a", r, c, float(p[r, c])) for r in range(10) for c in range(10)], "aoi_id string, row int, col int, probability float")
    df = layers(spark, shapes).withColumn("shape_id", F.col("osm_id"))
    got = {r.shape_id: r for r in spatial.footprints(df, cells, spark.sql(GRID)).collect()}
    for _, k, _, _, (ring,) in shapes:
        (x0, y0), (x1, y1) = ring[0], ring[2]
        own = [p[r, c] for r in range(10) for c in range(10) if x0 < 85 + (c + 0.5) * 0.01 < x1 and y0 < 27.1 - (r + 0.5) * 0.01 < y1]
        assert got[k].pixel_count == len(own)
        if own:
            assert got[k].mean_probability == pytest.approx(np.mean(own), abs=1e-6) and got[k].flooded_fraction == pytest.approx(np.mean(np.array(own) >= 0.5))


def test_scan_lines_against_every_centre(spark):
    """Stars with holes, in several parts, some of them beyond the grid or smaller than a cell."""
    rng = np.random.default_rng(11)
    grid = (85.0, 27.1, 0.01, -0.01, 40, 30)
    shapes, rows = [], []
    for k in range(60):
        parts = []
        for _ in range(rng.integers(1, 4)):
            x, y, n = 85 + rng.random() * 0.4 - 0.05, 27.1 - rng.random() * 0.5 + 0.05, int(rng.integers(3, 9))
            turn, size = np.sort(rng.random(n)) * 2 * np.pi, rng.random(n) * (0.002 if k % 7 == 0 else 0.12)
            star = [[x + np.cos(a) * d, y + np.sin(a) * d] for a, d in zip(turn, size)]
            if k % 5 == 0:
                star = [[round(a, 2) + 0.005, round(b, 2) + 0.005] for a, b in star]  # corners on centres
            hole = [[x + (a - x) * 0.4, y + (b - y) * 0.4] for a, b in star]
            parts.append([[*star, star[0]], [*hole, hole[0]]])
        shapes.append(parts)
        rows.append(("building", k, {}, "MultiPolygon", parts))
    df = layers(spark, rows).withColumn("shape_id", F.col("osm_id"))
    g = spark.sql("SELECT 'a' AS aoi_id, 85.0D AS origin_x, 27.1D AS origin_y, 0.01D AS px_w, -0.01D AS px_h, 40 AS height, 30 AS width")
    got = {}
    for r in spatial.polygon_cells(df, g).collect():
        got.setdefault(r.shape_id, []).append((r.row, r.col))
    total = 0
    for k, parts in enumerate(shapes):
        sides = [(*a, *b) for part in parts for ring in part for a, b in zip(ring, ring[1:])]
        own = []
        for r in range(grid[4]):
            y = grid[1] + (r + 0.5) * grid[3]
            for c in range(grid[5]):
                x = grid[0] + (c + 0.5) * grid[2]
                if sum((b > y) != (d > y) and x < a + (y - b) * (e - a) / (d - b) for a, b, e, d in sides) % 2:
                    own.append((r, c))
        assert sorted(got.get(k, [])) == own
        total += len(own)
    assert total > 1000
    assert spatial.polygon_cells(df.where("false"), g).count() == 0


def test_edge_probability(spark):
    df = spark.createDataFrame([(0, 0.0, 10.0), (0, 1.0, 10.0), (0, 1.0, 0.0), (1, None, 5.0)], "owner int, probability double, spacing double")
    got = {r.owner: r for r in lines.edge_probability(df, ["owner"]).collect()}
    assert got[0].mean_probability == pytest.approx(11 / 21) and got[0].max_probability == 1.0 and got[0].flooded_fraction == pytest.approx(2 / 3)
    assert got[1].mean_probability is None and got[1].max_probability is None and got[1].flooded_fraction == 0.0


def points(spark, *ways):
    return spark.createDataFrame([("a", k, 0, i, float(x), float(y), 45) for k, way in enumerate(ways) for i, (x, y) in enumerate(way)], "aoi_id string, osm_id long, part int, idx int, x double, y double, zone int")


def build(spark, *ways):
    return graph.build(points(spark, *ways), 20.0, lambda s: s.withColumn("probability", F.lit(0.0)), 0.5)


def test_sampling(spark):
    segs = lines.segments(points(spark, [(0, 0), (30, 0), (100, 0)]), ["aoi_id", "osm_id", "part"], ["idx"])
    assert [r.length for r in segs.orderBy("idx").collect()] == [30.0, 70.0]
    got = lines.sample_lines(segs, 20.0, ["aoi_id", "osm_id"]).orderBy("station").collect()
    assert [r.sx for r in got] == [0, 20, 40, 60, 80, 100] and [r.spacing for r in got] == [20] * 5 + [0]
    mid = lines.sample_segments(segs, 20.0).orderBy("sx").collect()
    assert [r.weight for r in mid] == [15, 15] + [17.5] * 4 and mid[0].sx == 7.5


def test_graph_t_junction(spark):
    nodes, edges, _ = build(spark, [(0, 0), (50, 0), (100, 0), (200, 0)], [(100, 0), (100, 50), (100, 100)])
    degree = sorted(r.degree for r in graph.degrees(edges).collect())
    assert nodes.count() == 4 and degree == [1, 1, 1, 3] and edges.agg(F.sum("length_m")).first()[0] == pytest.approx(300)


def test_graph_parallel_chains(spark):
    nodes, edges, _ = build(spark, [(-50, 0), (0, 0)], [(0, 0), (50, 50), (100, 0)], [(0, 0), (50, -50), (100, 0)], [(100, 0), (150, 0)])
    rows = sorted(r.length_m for r in edges.collect())
    assert nodes.count() == 4 and len(rows) == 3 and rows[2] == pytest.approx(4 * 50 * 2**0.5)
    assert {r.node_id for r in nodes.collect()} == {0, 1, 2, 3}


def test_graph_ring(spark):
    nodes, edges, closed = build(spark, [(0, 0), (100, 0), (50, 80), (0, 0)])
    assert nodes.count() == 3 and edges.count() == 3 and closed.first().cycle_segments == 3


def test_nearest(spark):
    p = spark.createDataFrame([("a", 1, 10.0, 0.0), ("a", 2, 5000.0, 0.0)], "aoi_id string, p int, x double, y double")
    n = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 1000.0, 0.0), ("a", 2, 20.0, 0.0)], "aoi_id string, node_id int, x double, y double")
    got = {r.p: (r.node_id, r.distance) for r in spatial.nearest(p, n, 500.0, "p", "node_id").collect()}
    assert got == {1: (0, 10.0), 2: (None, None)}
    assert [r.n for r in spatial.count_within(p, n, 10.0, "p").orderBy("p").collect()] == [2, 0]


def solve(spark, edges, sources, homes):
    nodes = spark.createDataFrame([("a", k, 1000.0 * k, 0.0) for k in range(5)], "aoi_id string, node_id int, x double, y double")
    e = spark.createDataFrame([("a", *x) for x in edges], "aoi_id string, u int, v int, length_m double, flood_probability double") if edges else spark.createDataFrame([], "aoi_id string, u int, v int, length_m double, flood_probability double")
    d = spark.createDataFrame([("a", k, x, 0.0) for k, x in enumerate(sources)], "aoi_id string, destination_id int, x double, y double")
    s = spark.createDataFrame([("a", k, f"s{k}", x, 0.0, 0) for k, x in enumerate(homes)], "aoi_id string, settlement_id int, name string, x double, y double, buildings_affected int")
    return graph.solve(nodes, e, d, s)


def test_isolation_bridge(spark):
    base = [(0, 1, 100.0, 0.0), (1, 2, 50.0, 0.9), (2, 3, 100.0, 0.0)]
    found, summary = solve(spark, base, [0.0], [1000.0, 3000.0, 9000.0])
    got = {r.settlement_id: r for r in found.collect()}
    assert [got[k]["class"] for k in range(3)] == ["still_connected", "newly_cut_off", "no_pre_event_access"]
    assert summary.first().severed_edges == 1 and summary.first().status == "OK"
    assert [r.settlement_id for r in graph.priority_rank(found).orderBy("priority_rank").collect()] == [1, 2, 0]
    found, _ = solve(spark, [*base, (0, 3, 1000.0, 0.0)], [0.0], [3000.0])
    assert found.first()["class"] == "still_connected" and found.first().extra_distance_km == pytest.approx(0.75)


def test_isolation_typed_states(spark):
    assert solve(spark, [], [0.0], [0.0])[1].first().status == "NO_ROAD_GRAPH"
    assert solve(spark, [(0, 1, 1.0, 0.0)], [90_000.0], [0.0])[1].first().status == "NO_DESTINATIONS"


def test_priority_order(spark):
    df = spark.createDataFrame([("a", 0, 2.0, "still_connected", "b"), ("a", 1, 10.0, "still_connected", "a"), ("a", 2, 1.5, "newly_cut_off", "c"), ("b", 0, 1.0, "still_connected", "x"), ("b", 1, 1.0, "newly_cut_off", "z"), ("b", 2, 1.0, "still_connected", "w")], "aoi_id string, settlement_id int, priority_score double, class string, name string")
    order = lambda a: [r.settlement_id for r in graph.priority_rank(df).where(F.col("aoi_id") == a).orderBy("priority_rank").collect()]
    assert order("a") == [1, 0, 2] and order("b") == [1, 2, 0]


def test_pairing(spark):
    post = spark.createDataFrame([("p", "2024-10-02T00:19:42Z", "DESCENDING", 121)], "scene_id string, acquisition_time string, orbit_direction string, relative_orbit int")
    pre = spark.createDataFrame([("a", "2024-09-20T00:25:11Z", "DESCENDING", 121), ("b", "2024-09-08T00:25:11Z", "DESCENDING", 121), ("c", "2024-09-21T00:25:11Z", "ASCENDING", 121), ("d", "2024-10-14T00:25:11Z", "DESCENDING", 121)], post.schema)
    pairs = scenes.pair(post, pre, 1)
    assert [r.scene_id for r in pairs.collect()] == ["a"]
    gap = scenes.repeat_gap(pairs).first()
    assert gap.gap_days == 12 and gap.fits
    with pytest.raises(FloodError):
        scenes.require_pairs(post, scenes.pair(post, pre.where("scene_id = 'c'")))


def test_clearest(spark):
    s = spark.createDataFrame([("pre-clear", "2026-08-11", 13.37), ("post-cloudy", "2026-08-27", 54.29), ("post-clear", "2026-09-02", 21.5), ("none", "2026-09-03", None)], "scene_id string, acquisition_time string, cloud_pct double")
    assert scenes.clearest(s, "2026-08-26").first().scene_id == "post-clear"
    assert scenes.clearest(s.where("scene_id = 'pre-clear'"), "2026-08-26").first().scene_id == "pre-clear"
    assert scenes.clearest(s.limit(0), "2026-08-26").first() is None


def test_damage_and_isolation_stages(spark):
    n1, n2, n3, n4, s2, s3 = (85.005, 27.065), (85.045, 27.065), (85.055, 27.065), (85.095, 27.065), (85.045, 27.055), (85.055, 27.075)
    ways = [(n1, n2), (n2, n3), (n3, n4), (n2, s2), (n3, s3)]
    rows = [("highway", 10 + k, {"highway": "secondary"}, "LineString", [list(a), list(b)]) for k, (a, b) in enumerate(ways)]
    rows += [("bridge", 30, {"bridge": "yes", "highway": "secondary"}, "LineString", [list(n2), list(n3)])]
    rows += [("building", 40, {"building": "yes"}, "Polygon", box(3, 4, 3, 5)), ("building", 41, {"building": "yes"}, "Polygon", box(9, 0, 9, 0))]
    rows += [("amenity", 50, {"amenity": "hospital"}, "Point", list(n1)), ("amenity", 52, {"amenity": "pharmacy"}, "Point", list(n4))]
    rows += [("place", 60 + k, {"place": p, "name": n}, "Point", list(at)) for k, (n, p, at) in enumerate([("west", "village", n2), ("east", "hamlet", n4), ("far", "hamlet", (85.09, 27.01)), ("ignored", "suburb", n1)])]
    df, cells, grid = layers(spark, rows).cache(), flood(spark, {2, 3, 4}, {4, 5}).cache(), spark.sql(GRID)
    d = damage_plan.damage(df, cells, grid)
    assert damage_plan.damage_counts(df, cells, grid).collect() == d.counts.collect()
    c = d.counts.first()
    assert (c.buildings_total, c.buildings_affected, c.roads_total, c.bridges_total, c.bridges_possibly_impacted, c.bridges_road_total) == (2, 1, 5, 1, 1, 1)
    assert {r.id: r.value for r in d.facts.collect()}["buildings_affected"] == "1"
    i = isolation_plan.isolation(df, cells, grid, d.buildings)
    got = {r.name: r for r in i.settlements.collect()}
    assert {k: r["class"] for k, r in got.items()} == {"west": "still_connected", "east": "newly_cut_off", "far": "no_pre_event_access"}
    assert sorted(r.priority_rank for r in got.values()) == [1, 2, 3] and got["east"].priority_rank == 1
    total = i.counts.first()
    assert total.settlements_total == 3 and total.settlements_newly_cut_off == 1 and total.road_km_severed > 0.9
    with pytest.raises(ValueError):
        damage_plan.damage(df, cells, grid, ["building"])


def test_dense_places_meet_by_bins(spark, monkeypatch):
    """Thousands of points and nodes within one radius: tried pairs stay few, results are those of brute force."""
    rng = np.random.default_rng(5)
    place = lambda n: np.concatenate([rng.integers(-40, 41, (n, 2)), np.round(rng.normal(300, 2, (n, 2)), 1), [[900, 900]]]).astype(float)
    a, b = place(1500), place(1500)
    frame = lambda xy, name: spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(1, -1, None, 0.0), (1, -2, float("nan"), 0.0)], f"aoi_id int, {name} int, x double, y double")
    p, n = frame(a, "p"), frame(b, "n")
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    tried = []
    met = spatial._meet

    def counted(*args):
        pairs, whole = met(*args)
        tried.append((args[0], args[1], pairs))
        return pairs, whole

    monkeypatch.setattr(spatial, "_meet", counted)
    got = {r.p: (r.n, r.distance) for r in spatial.nearest(p, n, 100.0, "p", "n").collect()}
    assert got == {-1: (None, None), -2: (None, None), **{i: (int(row.argmin()), pytest.approx(float(np.sqrt(row.min())))) if row.min() <= 100**2 else (None, None) for i, row in enumerate(d)}}
    assert {r.p: r.n for r in spatial.count_within(p, n, 100.0, "p").collect()} == {-1: 0, -2: 0, **{i: int(k) for i, k in enumerate((d <= 100**2).sum(axis=1))}}
    for at, to, pairs in tried:
        rows = at.join(pairs, ["aoi_id", "_bx", "_by"]).join(to.select("aoi_id", F.col("_bx").alias("_cx"), F.col("_by").alias("_cy")), ["aoi_id", "_cx", "_cy"]).count()
        assert rows < 0.2 * (d <= 100**2).sum()


def test_contraction_touches_only_edges_at_chains(spark, monkeypatch):
    """A dense core passes as it is; a chain between two of its nodes adds to their edge, and kept nodes are numbered in order."""
    core = [(u, v, 1.0, 0.25, 0.5, 0.0) for u in range(0, 12, 2) for v in range(u + 2, 12, 2)]
    chain = [(0, 1, 1.0, 1.0, 1.0, 1.0), (1, 2, 2.0, 1.0, 1.0, 2.0), (4, 20, 1.0, 0.0, 0.0, 0.0), (20, 21, 1.0, 0.0, 0.0, 0.0), (21, 30, 2.0, 1.0, 1.0, 2.0)]
    edges = spark.createDataFrame([(7, *e) for e in core + chain], "aoi_id int, u int, v int, length_m double, flood_probability double, max_probability double, flooded_length_m double")
    nodes = edges.select("aoi_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    merge, seen = lines.merge_edges, []
    monkeypatch.setattr(lines, "merge_edges", lambda rows, *more: (seen.append(rows.count()), merge(rows, *more))[1])
    kept, got, closed = graph.contract(nodes, edges)
    number = {r: n for n, r in enumerate((0, 2, 4, 6, 8, 10, 30))}
    want = {(number[u], number[v]): (1.0, 0.25, 0.5, 0.0) for u, v, *_ in core} | {(0, 1): (4.0, 3.25 / 4, 1.0, 3.0), (2, 6): (4.0, 0.5, 1.0, 2.0)}
    assert {(r.u, r.v): (r.length_m, r.flood_probability, r.max_probability, r.flooded_length_m) for r in got.collect()} == want
    assert sorted(r.node_id for r in kept.collect()) == list(range(7)) and closed.count() == 0
    assert seen == [len(chain) + 1]


def test_a_last_segment_lost_in_rounding_makes_no_station_twice(spark):
    """Without a table of all stations to find repeated ones: a segment that starts at the end of its line makes none."""
    segs = lines.segments(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1e9, 0.0), (1, 2, 1e9, 1e-9)], "l int, i int, x double, y double"), ["l"], ["i"])
    found = lines.sample_lines(segs, 5e8, ["l"])
    assert sorted((r.station, r.spacing) for r in found.collect()) == [(0, 5e8), (1, 5e8), (2, 0.0)]
    assert "first(" not in found._jdf.queryExecution().optimizedPlan().toString()

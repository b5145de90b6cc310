import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrograin.config import Config
from hydrograin.errors import FloodError
from hydrograin.operators import facts, scenes
from hydrograin.plans import flood as flood_plan
from hydrograin.plans import queries, service
from hydrograin.sources import cache, connectors, dem, features, sinks, tiff
from hydrograin.functions import wkb

GRID = "SELECT 'a' AS aoi_id, 85.0D AS origin_x, 27.1D AS origin_y, 0.0002D AS px_w, -0.0002D AS px_h, 40 AS height, 40 AS width"


def scene(spark, vv, vh, name=None):
    h, w = vv.shape
    rows = [("a", r, c, float(vv[r, c]), float(vh[r, c]), 1.0) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "aoi_id string, row int, col int, vv float, vh float, mask double")
    return df if name is None else df.withColumn("scene_id", F.lit(name))


def test_flood_map_patch(spark):
    pre_vv, pre_vh = np.full((40, 40), -10.0), np.full((40, 40), -16.0)
    post_vv, post_vh = pre_vv.copy(), pre_vh.copy()
    truth = np.zeros((40, 40), bool)
    truth[8:14, 8:16] = True
    post_vv[truth] -= 8
    post_vh[truth] -= 9
    m = flood_plan.flood_map(scene(spark, post_vv, post_vh), scene(spark, pre_vv, pre_vh, "s1"), spark.sql(GRID))
    hit = np.zeros((40, 40), bool)
    for r in m.cells.where("probability > 0").collect():
        hit[r.row, r.col] = True
    assert (hit & truth).sum() / (hit | truth).sum() > 0.8
    c = m.counts.first()
    assert c.candidate - c.excluded_water - c.excluded_slope - c.excluded_shadow - c.excluded_hand - c.excluded_small == c.final == hit.sum()
    assert m.polygons.count() == 1 and m.area.first().flooded_area_km2 > 0


def test_flood_map_lake_and_empty(spark):
    vv, vh = np.full((20, 20), -10.0), np.full((20, 20), -16.0)
    vv[5:8], vh[5:8] = -18, -24
    post_vv, post_vh = vv - 8, vh - 9
    post_vv[12:], post_vh[12:] = vv[12:], vh[12:]
    m = flood_plan.flood_map(scene(spark, post_vv, post_vh), scene(spark, vv, vh, "s"), spark.sql(GRID), config=Config.of({"flood": {"speckle_filter_size": 1}}))
    c = m.counts.first()
    assert c.excluded_water == 60 and m.cells.where("row BETWEEN 5 AND 7 AND probability > 0").count() == 0
    gone = np.full((5, 5), np.nan)
    m = flood_plan.flood_map(scene(spark, gone, gone), scene(spark, gone, gone, "s"), spark.sql(GRID))
    assert m.counts.first().final == 0 and m.area.first().flooded_area_km2 == 0 and m.polygons.count() == 0


def test_flood_map_refuses_other_grids_and_too_many_scenes(spark):
    one = np.full((5, 5), -10.0)
    pres = [scene(spark, one, one, f"s{i}") for i in range(4)]
    with pytest.raises(ValueError, match="do not share the grid"):
        flood_plan.flood_map(scene(spark, one, one), pres[0].where("row < 4"), spark.sql(GRID))
    many = pres[0]
    for p in pres[1:]:
        many = many.union(p)
    with pytest.raises(ValueError, match="4 pre scenes, 1 to 3"):
        flood_plan.flood_map(scene(spark, one, one), many, spark.sql(GRID))
    with pytest.raises(ValueError, match="0 pre scenes"):
        flood_plan.flood_map(scene(spark, one, one), pres[0].limit(0), spark.sql(GRID))


def test_pixel_area(spark):
    g = spark.sql("SELECT 'a' AS aoi_id, 85.15D AS origin_x, 28.05D AS origin_y, 0.0002D AS px_w, -0.2D / 1115 AS px_h, 1115 AS height, 1000 AS width")
    assert 3.5 < g.select(flood_plan.pixel_area(F.lit(10_000))).first()[0] < 4.3


def test_tiff_round_trip(spark, tmp_path):
    a = np.stack([np.arange(12, dtype="f4").reshape(3, 4), np.full((3, 4), np.nan, "f4"), np.ones((3, 4), "f4")])
    path = tmp_path / "x.tif"
    path.write_bytes(tiff.encode(a, (85.0, 28.0), (0.5, 0.25)))
    (tmp_path / "y.txt").write_bytes(b"no")
    files = tiff.read(spark, str(tmp_path))
    g = tiff.grids(files).first()
    assert (g.height, g.width, g.origin_x, g.px_h, g.crs, g.max_lon, g.min_lat) == (3, 4, 85.0, -0.25, "EPSG:4326", 87.0, 27.25)
    rows = tiff.cells(files).orderBy("row", "col").collect()
    assert [r.vv for r in rows] == list(range(12)) and all(r.vh is None and r.mask == 1 for r in rows)
    with pytest.raises(ValueError):
        tiff.decode(b"none at all")
    bands, mask = tiff.radar_bands(np.zeros((5, 6, 3)))
    assert len(bands) == 2 and mask.shape == (5, 6) and len(tiff.radar_bands(np.zeros((5, 6)))[0]) == 1


def test_dem_window(spark):
    tiles = spark.createDataFrame([(t, r, c, float(k * 100 + r * 4 + c)) for k, t in enumerate(["Copernicus_DSM_COG_10_N27_00_E085_00_DEM", "Copernicus_DSM_COG_10_N27_00_E086_00_DEM"]) for r in range(4) for c in range(4)], "tile_id string, row int, col int, z double")
    box = spark.createDataFrame([("a", 85.5, 27.25, 86.5, 27.75)], "aoi_id string, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {(r.row, r.col): r.z for r in dem.window(tiles, box, 4).collect()}
    assert got == {(0, 0): 6, (0, 1): 7, (0, 2): 104, (0, 3): 105, (1, 0): 10, (1, 1): 11, (1, 2): 108, (1, 3): 109}
    g = dem.window_grid(box, 4).first()
    assert (g.origin_x, g.origin_y, g.height, g.width) == (85.5, 27.75, 2, 4)


def test_terrain_layers(spark):
    rows = [("a", r, c, 10.0 * r) for r in range(10) for c in range(5)]
    z = spark.createDataFrame(rows, "aoi_id string, row int, col int, z double")
    g = spark.sql("SELECT 'a' AS aoi_id, 85D AS origin_x, 28D AS origin_y, 0.0003D AS px_w, -0.0003D AS px_h, 10 AS height, 5 AS width")
    fine = g.withColumns({"px_w": F.lit(0.00015), "px_h": F.lit(-0.00015), "height": F.lit(20), "width": F.lit(12)})
    got = flood_plan.terrain_layers(z, g, fine, "DESCENDING", 5)
    assert got.count() == 240 and got.where("col >= 10 AND slope IS NOT NULL").count() == 0
    assert got.where("row = 12 AND col = 0").first().hand == 10.0


def test_feature_layers(spark, tmp_path):
    rows = [("way", 1, {"building": "yes"}, "Polygon", bytearray(wkb.encode("Polygon", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]])), False), ("way", 2, {}, "Polygon", None, False)]
    df = spark.createDataFrame(rows, "osm_type string, osm_id long, tags map<string,string>, geom_type string, geom binary, clipped boolean").withColumn("edit_timestamp", F.to_timestamp(F.lit("2026-03-09T23:59:23Z")))
    df.write.parquet(str(tmp_path / "b"))
    layer = features.scan(spark, str(tmp_path / "b"))
    assert features.dropped(layer).first().dropped == 1 and features.usable(layer).count() == 1
    found, missing = features.scan_layers(spark, {"building": str(tmp_path / "b"), "bridge": str(tmp_path / "none")})
    assert found.count() == 1 and missing == ["bridge"]
    assert features.newest_edit(spark, str(tmp_path / "b")).first().newest == "2026-03-09T23:59:23Z"
    assert features.count_rows(spark, str(tmp_path / "b")).first().n == 2
    features.write_partitioned(found, str(tmp_path / "p"))
    assert features.restrict(spark.read.parquet(str(tmp_path / "p")), ("building",)).count() == 1
    geometry = json.loads(found.select(sinks.coordinates(F.col("kind"), F.col("parts"))).first()[0])
    assert geometry == {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]}
    feature = sinks.feature(("osm_id", "clipped", "none"), sinks.coordinates(F.col("kind"), F.col("parts")), found.columns)
    whole = json.loads(sinks.collection(found.select("aoi_id", feature.alias("feature"))).first().geojson)
    assert whole["features"][0]["properties"] == {"osm_id": 1, "clipped": False}
    with pytest.raises(ValueError):
        features.check_snapshot("2024-09-28", "2024-09-28")
    assert 'way["building"](27,85,28,86);' in features.attic_query((85, 27, 86, 28), "2024-09-25", ["building"])


def test_geotiff_sink(spark):
    cells = spark.createDataFrame([("a", 0, 1, 0.5), ("a", 1, 0, None)], "aoi_id string, row int, col int, probability double")
    g = spark.sql("SELECT 'a' AS aoi_id, 85D AS origin_x, 28D AS origin_y, 1D AS px_w, -1D AS px_h, 2 AS height, 2 AS width")
    a, grid = tiff.decode(bytes(sinks.geotiff(cells, g, "probability").first().content))
    assert a.tolist() == [[[0.0, 0.5], [0.0, 0.0]]] and grid["origin_y"] == 28


def test_catalogue_items(spark):
    item = lambda i, t, **p: (json.dumps({"id": i, "properties": {"datetime": t, **p}}),)
    df = spark.createDataFrame([item("b", "2024-10-02T00:00:00Z", **{"sat:orbit_state": "descending", "sat:relative_orbit": 121}), item("a", "2024-09-20T00:00:00Z"), item(None, "x")], "item string")
    rows = scenes.normalised_s1(df).collect()
    assert [r.scene_id for r in rows] == ["a", "b"] and rows[1].orbit_direction == "DESCENDING" and rows[1].relative_orbit == 121
    df = spark.createDataFrame([item("c", "2024-09-20T00:00:00Z", **{"eo:cloud_cover": 12.5}), item("d", "2024-09-21T00:00:00Z", **{"eo:cloud_cover": 80})], "item string")
    assert [r.cloud_pct for r in scenes.normalised_s2(df, 20).collect()] == [12.5]


def test_connectors(tmp_path):
    calls = []

    def transport(method, url, headers, body):
        calls.append(url)
        if "token" in url:
            return 200, b'{"access_token": "t", "expires_in": 600}'
        if "search" in url:
            return 200, b'{"features": [{"id": "x"}]}'
        return 200, b"II*\0data"

    client = connectors.CopernicusClient("id", "secret", str(tmp_path), transport=transport, clock=lambda: 0.0)
    assert client.search("s1", (85, 27, 86, 28), "a", "b") == ['{"id": "x"}']
    s = {"scene_id": "x", "acquisition_time": "2024-10-02T00:19:42Z", "orbit_direction": "descending"}
    assert not client.clip("radar", (85.0, 27.0, 85.1, 27.1), s)[1] and client.clip("radar", (85.0, 27.0, 85.1, 27.1), s)[1]
    assert sum("token" in c for c in calls) == 1
    body = connectors.process_request("classes", (85, 27, 86, 28), "2024-10-02T00:00:00Z", (10, 10))
    assert body["input"]["data"][0]["dataFilter"]["timeRange"]["to"] == "2024-10-02T00:30:00Z"
    tries = []
    with pytest.raises(FloodError):
        connectors.retried(lambda: tries.append(1) or (_ for _ in ()).throw(connectors.ServiceError(503, "", True)), "CDSE_UNAVAILABLE", sleep=lambda s: None)
    assert len(tries) == 3
    with pytest.raises(FloodError):
        connectors.retried(lambda: tries.append(1) or (_ for _ in ()).throw(connectors.ServiceError(401, "", False)), "CDSE_UNAVAILABLE")
    assert len(tries) == 4


def test_map_client_falls_back_to_a_day(tmp_path):
    bodies = []

    def transport(method, url, headers, body):
        bodies.append(json.loads(body))
        t = bodies[-1]["time"]
        return (422, b"range") if t["start"] == t["end"] else (200, b"PAR1")

    client = connectors.MapClient(root=str(tmp_path), transport=transport)
    found = client.extract((85, 27, 86, 28), "2024-09-27", "2024-09-28", ["place"])
    assert found["place"].read_bytes() == b"PAR1" and bodies[-1]["time"] == {"start": "2024-09-27T00:00:00Z", "end": "2024-09-28T00:00:00Z"}
    assert cache.load_window(found["place"]) == bodies[-1]["time"]
    with pytest.raises(ValueError):
        client.extract((85, 27, 86, 28), "2024-09-28", "2024-09-28")
    with pytest.raises(ValueError):
        connectors.map_filter(["river"])


def test_cache(tmp_path):
    k = cache.clip_key((85.0000001, 27, 86, 28), kind="x")
    assert k == cache.clip_key((85.0, 27, 86, 28), kind="x") and len(k) == 24
    p = cache.store(cache.place(str(tmp_path), k, ".bin"), b"abc")
    assert p.parent.name == k[:2] and cache.load(p) == b"abc" and cache.load(tmp_path / "no") is None


def test_service(spark, tmp_path):
    with pytest.raises(ValueError):
        service.Request((86, 27, 85, 28), "2024-09-28")
    with pytest.raises(ValueError):
        service.Request((85, 27, 86, 28), "2024-09-28", "2024-09-28")
    r = service.preflight(spark, service.Request((80.0, 20.0, 90.0, 30.0), "2024-09-28"))
    assert not r["ok"] and r["error"]["code"] == "AOI_TOO_LARGE"
    s1 = spark.createDataFrame([("pre", "2024-09-20T00:25:11Z", "DESCENDING", 121), ("post", "2024-10-02T00:19:42Z", "DESCENDING", 121)], "scene_id string, acquisition_time string, orbit_direction string, relative_orbit int")
    r = service.preflight(spark, service.Request((85.15, 27.85, 85.35, 28.05), "2024-09-28"), s1)
    assert r["ok"] and r["pair_found"] and r["warnings"] == []
    jobs = service.Jobs(str(tmp_path))
    job = jobs.create(service.Request((85.0, 27.0, 85.1, 27.1), "2024-09-28"))
    assert jobs.run(spark, job, {"facts": lambda f: {"n": spark.range(3).count()}})["n"] == 3 and job.status == "succeeded" and job.progress == 1.0
    bad = jobs.create(service.Request((85.0, 27.0, 85.1, 27.1), "2024-09-28"))
    with pytest.raises(ZeroDivisionError):
        jobs.run(spark, bad, {"osm": lambda f: 1 / 0})
    assert bad.error["code"] == "INTERNAL"
    left = jobs.create(service.Request((85.0, 27.0, 85.1, 27.1), "2024-09-28"))
    again = service.Jobs(str(tmp_path))
    assert again.get(left.job_id).status == "failed" and again.get(job.job_id).status == "succeeded"
    f = spark.createDataFrame([("settlements_newly_cut_off", "7")], "id string, value string")
    assert service.answer(spark, "Who is cut off?", f, "ne").startswith("७ settlements")


def test_facts_document(spark):
    c = spark.createDataFrame([("a", 3, 1.5)], "aoi_id string, n int, km double")
    f = facts.facts(c, {"n": "count", "km": "km"}, "damage")
    assert {r.id: (r.value, r.value_type) for r in f.collect()} == {"n": ("3", "int"), "km": ("1.5", "float")}
    s = spark.createDataFrame([("a", 1, "x", "newly_cut_off", 2, None)], "aoi_id string, priority_rank int, name string, class string, buildings_affected int, extra_distance_km double")
    meta = spark.createDataFrame([("a", "j", [85.0, 27.0, 86.0, 28.0], "2024-09-28")], "aoi_id string, job_id string, bbox array<double>, event_date string")
    doc = json.loads(facts.document(f, s, meta).first().facts_json)
    assert doc["meta"]["job_id"] == "j" and len(doc["facts"]) == 2 and doc["tables"]["cutoff_settlements"][0]["name"] == "x"
    t = spark.createDataFrame([("en", "<p>{{ n }} of {{ km }}</p>")], "lang string, html string")
    assert facts.report_html(f, t, "ne").first().html == "<p>3 of 1.5</p>"


def test_scene_stream(spark, tmp_path):
    from hydrograin.streaming import scenes as stream

    known = spark.createDataFrame([("pre", "2024-09-20T00:25:11Z", "DESCENDING", 121)], stream.SCHEMA)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"scene_id": "post", "acquisition_time": "2024-10-02T00:19:42Z", "orbit_direction": "DESCENDING", "relative_orbit": 121}\n')
    stream.pair_arrivals(stream.arriving(spark, str(tmp_path / "in")), known, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [r.scene_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["pre"]


def test_every_query_has_sql_or_a_reason():
    assert all(name in queries.ORACLES or f.__doc__ for name, f in queries.QUERIES.items())

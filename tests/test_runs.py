"""A whole run over made-up services: to facts and report, on again after a stop, and its files and layers."""

import io
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from hydrograin.config import Config
from hydrograin.errors import FloodError
from hydrograin.functions import wkb
from hydrograin.operators import tables
from hydrograin.plans import isolation as isolation_plan
from hydrograin.plans import runs, service
from hydrograin.sources import connectors, elevation, tiff

BOX = (85.0, 27.0, 85.02, 27.02)
PIXELS = 720
CONFIG = Config.of({"upstream": {"accumulation_threshold": 4}, "terrain": {"hand_cutoff_m": 400.0}})


def clip(size, flooded):
    w, h = size
    vv, vh = np.full((h, w), -9.0, "f4"), np.full((h, w), -15.0, "f4")
    rng = np.random.default_rng(4)
    vv += rng.normal(0, 0.1, vv.shape).astype("f4")
    vh += rng.normal(0, 0.1, vh.shape).astype("f4")
    if flooded:
        vv[h // 4 : h // 2, w // 4 : 3 * w // 4] -= 8
        vh[h // 4 : h // 2, w // 4 : 3 * w // 4] -= 9
    return tiff.encode(np.stack([vv, vh, np.ones((h, w), "f4")]), (BOX[0], BOX[3]), ((BOX[2] - BOX[0]) / w, (BOX[3] - BOX[1]) / h))


def at(x, y):
    """A place in the box, from 0 to 1 from west and north."""
    return [BOX[0] + x * (BOX[2] - BOX[0]), BOX[3] - y * (BOX[3] - BOX[1])]


def square(x, y, s=0.03):
    return [[at(x, y), at(x + s, y), at(x + s, y + s), at(x, y + s), at(x, y)]]


FEATURES = {
    "building": [(1, {"building": "yes"}, "Polygon", square(0.4, 0.35)), (2, {"building": "yes"}, "Polygon", square(0.8, 0.8))],
    "highway": [(10, {"highway": "primary", "name": "A"}, "LineString", [at(0.1, 0.38), at(0.9, 0.38)]), (11, {"highway": "track"}, "LineString", [at(0.1, 0.38), at(0.1, 0.9)]), (12, {"highway": "track"}, "LineString", [at(0.1, 0.38), at(0.1, 0.3)])],
    "bridge": [(20, {"bridge": "yes", "highway": "primary"}, "LineString", [at(0.45, 0.4), at(0.5, 0.4)])],
    "amenity": [(30, {"amenity": "hospital", "name": "Clinic"}, "Point", at(0.1, 0.38))],
    "place": [(40, {"place": "village", "name": "East"}, "Point", at(0.9, 0.38)), (41, {"place": "hamlet", "name": "South"}, "Point", at(0.1, 0.88))],
}


def extract(kind):
    rows = FEATURES[kind]
    table = pa.table(
        {
            "osm_type": pa.array(["way"] * len(rows)), "osm_id": pa.array([r[0] for r in rows], pa.int64()),
            "tags": pa.array([list(r[1].items()) for r in rows], pa.map_(pa.string(), pa.string())), "geom_type": pa.array([r[2] for r in rows]),
            "geom": pa.array([wkb.encode(r[2], r[3]) for r in rows], pa.binary()), "clipped": pa.array([False] * len(rows)),
        }
    )
    out = io.BytesIO()
    pq.write_table(table, out)
    return out.getvalue()


@pytest.fixture
def services(tmp_path):
    calls = []
    item = lambda name, t, orbit=121: {"id": name, "properties": {"datetime": t, "sat:orbit_state": "descending", "sat:relative_orbit": orbit}}
    items = [item("post", "2024-10-02T00:19:42Z"), item("pre1", "2024-09-20T00:19:42Z"), item("pre2", "2024-09-08T00:19:42Z"), item("other", "2024-09-21T00:19:42Z", 19), item("late", "2024-10-04T00:19:42Z")]

    def copernicus(method, url, headers, body):
        calls.append(url.rpartition("/")[2])
        if "token" in url:
            return 200, b'{"access_token": "t", "expires_in": 600}'
        if "search" in url:
            return 200, json.dumps({"features": items}).encode()
        asked = json.loads(body)
        post = "2024-10" in asked["input"]["data"][0]["dataFilter"]["timeRange"]["from"]
        return 200, clip((asked["output"]["width"], asked["output"]["height"]), post)

    def maps(method, url, headers, body):
        kind = next(k for k, f in connectors.MAP_FILTERS.items() if f in json.loads(body)["filter"])
        calls.append(kind)
        return 200, extract(kind)

    folder = tmp_path / "tiles"
    name = elevation.tile_name(27, 85)
    (folder / name).mkdir(parents=True)
    r, c = np.mgrid[0:PIXELS, 0:PIXELS].astype("f4")
    (folder / name / f"{name}.tif").write_bytes(tiff.encode((100 + 0.2 * c + 0.1 * r)[None].astype("f4"), (85.0, 28.0), (1 / PIXELS, 1 / PIXELS)))
    found = runs.Services(
        connectors.CopernicusClient("id", "secret", str(tmp_path / "clips"), CONFIG, copernicus, lambda: 0.0), connectors.MapClient(root=str(tmp_path / "maps"), config=CONFIG, transport=maps),
        elevation_base=f"file://{folder}", elevation_pixels=PIXELS, templates=[("en", "<p>{{ buildings_affected }} of {{ buildings_total }}</p>")],
    )
    return found, calls


REQUEST = service.Request(BOX, "2024-09-28", "2024-09-25")


def test_a_run_goes_on_where_it_stopped(spark, tmp_path, services, monkeypatch):
    found, calls = services
    root = f"file://{tmp_path}/runs"
    whole = isolation_plan.isolation

    def stopped(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(isolation_plan, "isolation", stopped)
    first = runs.FloodRun(spark, root, REQUEST, found, CONFIG)
    with pytest.raises(KeyboardInterrupt):
        first.go()
    assert list(first.manifest["stages"]) == ["pairing", "fetch", "terrain", "flood", "osm", "damage"]
    assert [s["scene_id"] for s in first.value("pairing", "pre")] == ["pre1", "pre2"] and first.value("pairing", "post")["scene_id"] == "post"
    asked = len(calls)
    monkeypatch.setattr(isolation_plan, "isolation", whole)
    # What a killed attempt has written is not in the manifest, and goes.
    half = tmp_path / "runs" / first.key / "isolation" / "half"
    half.mkdir(parents=True)
    run = runs.FloodRun(spark, root, REQUEST, found, CONFIG)
    assert run.go() == ["isolation", "facts", "report"] and len(calls) == asked
    assert "isolation/half" in run.clean() and run.done("isolation") and run.table("isolation", "settlements").count() == 2
    assert runs.FloodRun(spark, root, REQUEST, found, CONFIG).go() == []
    assert runs.FloodRun(spark, root, service.Request(BOX, "2024-09-29", "2024-09-25"), found, CONFIG).key != run.key

    damage = run.table("damage", "counts").first()
    assert (damage.buildings_total, damage.buildings_affected, damage.bridges_possibly_impacted, damage.roads_total) == (2, 1, 1, 3)
    classes = {r.name: r["class"] for r in run.table("isolation", "settlements").collect()}
    assert classes == {"East": "newly_cut_off", "South": "still_connected"}
    doc = json.loads(run.table("facts", "document").first().facts_json)
    values = {f["id"]: f["value"] for f in doc["facts"]}
    assert values["buildings_affected"] == "1" and values["settlements_newly_cut_off"] == "1" and float(values["flooded_area_km2"]) > 0.1
    assert doc["meta"]["job_id"] == run.key and [s["name"] for s in doc["tables"]["cutoff_settlements"]] == ["East", "South"]
    assert run.table("report", "html").first().html == "<p>1 of 2</p>" and "buildings_affected=1" in run.value("report", "line")

    files = {p.rpartition("/")[2]: p.removeprefix("file://") for p in run.artifacts()}
    assert len(files) == 10
    mask, grid = tiff.decode(open(files["aoi_flood_mask.tif"], "rb").read())
    share, _ = tiff.decode(open(files["aoi_flood_probability.tif"], "rb").read())
    assert mask.sum() == run.table("flood", "counts").first().final > 500 and ((share > 0) == (mask > 0)).all()
    assert grid["origin_y"] == BOX[3] and mask.shape == share.shape
    layer = json.load(open(files["aoi_damage_buildings.geojson"]))
    assert sorted(f["properties"]["status"] for f in layer["features"]) == ["affected", "unaffected"]
    assert [f["properties"]["name"] for f in json.load(open(files["aoi_isolation_settlements.geojson"]))["features"]] == ["East", "South"]
    assert json.load(open(files["aoi_flood_polygons.geojson"]))["features"][0]["geometry"]["type"] == "Polygon"
    assert json.load(open(files["aoi_damage_counts.json"]))["buildings_total"] == 2
    with pytest.raises(KeyError):
        run.layer("rivers")


def test_intermediate_tables_are_deleted(spark, tmp_path):
    run = runs.Run(spark, f"file://{tmp_path}", {"a": 1})
    seen = []

    def make():
        one = tables.stage(spark.range(5))
        seen.append(one.inputFiles()[0].removeprefix("file://"))
        return {"n": one.selectExpr("id + 1 AS id"), "size": 5}

    assert run.stage("x", make) and not run.stage("x", make)
    import os

    assert len(seen) == 1 and not os.path.exists(seen[0]) and run.table("x", "n").count() == run.value("x", "size") == 5
    with pytest.raises(KeyError):
        run.table("x", "none")


def test_no_pair_and_another_grid(spark, tmp_path, services):
    found, _ = services
    search = found.copernicus.search
    found.copernicus.search = lambda *a, **k: [x for x in search(*a, **k) if "pre" not in x]
    with pytest.raises(FloodError, match="NO_VALID_ORBIT_PAIR"):
        runs.FloodRun(spark, f"file://{tmp_path}/r", REQUEST, found, CONFIG).go()
    found.copernicus.search = lambda *a, **k: [x for x in search(*a, **k) if re.search('"pre', x)]
    with pytest.raises(FloodError, match="NO_POST_EVENT_SCENE"):
        runs.FloodRun(spark, f"file://{tmp_path}/s", REQUEST, found, CONFIG).go()
    found.copernicus.search = search
    run = runs.FloodRun(spark, f"file://{tmp_path}/t", REQUEST, found, CONFIG)
    run.stage("pairing", run.pairing)
    moved = found.copernicus.clip("radar", BOX, run.value("pairing", "pre")[0])[0]
    bands, grid = tiff.decode(moved.read_bytes())
    moved.write_bytes(tiff.encode(bands, (grid["origin_x"] + 1e-4, grid["origin_y"]), (grid["px_w"], -grid["px_h"])))
    with pytest.raises(ValueError, match="does not share the grid"):
        run.stage("fetch", run.fetch)


def test_steps_of_a_job(spark, tmp_path, services):
    found, _ = services
    jobs = service.Jobs(str(tmp_path / "jobs"), CONFIG)
    job = jobs.create(REQUEST)
    out = jobs.run(spark, job, runs.steps(spark, f"file://{tmp_path}/runs", found, CONFIG))
    assert job.status == "succeeded" and job.progress == 1.0 and out["run"].done("report") and out["excluded"]["final"] > 500


def test_large_raster_by_strips(spark, tmp_path):
    from hydrograin.sources import sinks

    cells = spark.range(300 * 200).selectExpr("IF(id % 2 = 0, 'a', 'b c') AS aoi_id", "CAST(id div 200 AS INT) AS row", "CAST(id % 200 AS INT) AS col", "IF(id % 7 = 0, NULL, CAST(id AS DOUBLE)) AS v")
    grid = spark.sql("SELECT a AS aoi_id, 85D AS origin_x, 28D AS origin_y, 0.01D AS px_w, -0.01D AS px_h, 310 AS height, 205 AS width FROM VALUES ('a'), ('b c') t(a)")
    rows = sinks.write_geotiffs(cells, grid, "v", f"file://{tmp_path}/out", ".tif", "f4", -1.0, 16).collect()
    ids = np.arange(300 * 200)
    for r in rows:
        a, g = tiff.decode(open(r.path.removeprefix("file://"), "rb").read())
        expected = np.full((310, 205), -1.0, "f4")
        own = ids[(ids % 2 == (r.aoi_id != "a")) & (ids % 7 != 0)]
        expected[own // 200, own % 200] = own
        assert (a[0] == expected).all() and g["height"] == 310
    assert len(rows) == 2 and {r.path.rpartition("/")[2] for r in rows} >= {"a.tif"}


def test_selftest(spark, tmp_path):
    found = service.selftest(spark, str(tmp_path))
    assert found["status"] == "passed" and set(found["checks"]) == {"query", "python", "shared_folder", "cache_folder", "config"}
    (tmp_path / "file").write_text("x")
    assert "failed" in service.selftest(spark, str(tmp_path / "file" / "no"))["checks"]["cache_folder"]

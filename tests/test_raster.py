import json
import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrograin.operators import components, raster, terrain


def cells(spark, array, name="z", **more):
    a = np.asarray(array, dtype=float)
    rows = [(0, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"aoi_id int, row int, col int, {name} double")


def grid_of(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", name).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def test_speckle_filter(spark):
    a = np.full((7, 7), -12.0)
    a[3, 3], a[0, 0] = 20, np.nan
    df = cells(spark, a)
    got = grid_of(raster.speckle_filter(df, "z", 3), "z", a.shape)
    assert got[3, 3] == -12 and np.isnan(got[0, 0])
    assert np.array_equal(grid_of(raster.speckle_filter(df, "z", 2), "z", a.shape), got, equal_nan=True)
    assert raster.speckle_filter(df, "z", 1) is df


def test_speckle_filter_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(9, 11))
    a[rng.random(a.shape) < 0.2] = np.nan
    p = np.pad(a, 2, constant_values=np.nan)
    want = np.where(np.isnan(a), np.nan, [[np.nanmedian(p[r : r + 5, c : c + 5]) for c in range(11)] for r in range(9)])
    got = grid_of(raster.speckle_filter(cells(spark, a), "z", 5), "z", a.shape)
    assert np.allclose(got, want.astype("f4"), equal_nan=True)


def test_median_composite(spark):
    df = spark.createDataFrame([(0, 0, 0, -10.0), (0, 0, 0, -12.0), (0, 0, 0, 40.0), (0, 0, 1, -10.0), (0, 0, 1, None), (0, 0, 1, -12.0)], "aoi_id int, row int, col int, v double")
    assert sorted(r.v for r in raster.median_composite(df, ("v",)).collect()) == [-11.0, -10.0]


def test_otsu(spark):
    two = spark.createDataFrame([(0, 0.0)] * 500 + [(0, -12.0)] * 20, "aoi_id int, v double")
    r = raster.otsu(two, "v").first()
    assert (r.threshold, r.method) == (-6.0, "otsu_fallback")
    for rows in ([(0, None)], [(0, -2.0)], [(0, float("nan"))] * 3):
        r = raster.otsu(spark.createDataFrame(rows, "aoi_id int, v double"), "v").first()
        assert (r.threshold, r.method) == (-3.5, "fallback_no_data")
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(0, 0.5, 4000), rng.normal(-5, 0.7, 800)])
    h, e = np.histogram(v, 256)
    x = (e[:-1] + e[1:]) / 2
    w0, s0 = np.cumsum(h), np.cumsum(h * x)
    w1 = w0[-1] - w0
    with np.errstate(all="ignore"):
        between = np.where(w1 > 0, w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, -1)
    r = raster.otsu(spark.createDataFrame([(0, float(q)) for q in v], "aoi_id int, v double"), "v").first()
    assert r.method == "otsu" and r.threshold == pytest.approx(x[np.argmax(between)], abs=1e-6)


def test_waterfall_adds_up(spark):
    df = spark.range(100).select(F.lit(0).alias("aoi_id"), "id")
    got = {r.reason: r.n for r in raster.exclusion_waterfall(df, {"a": F.col("id") < 30, "b": F.col("id") < 50, "c": F.lit(None).cast("boolean")}).collect()}
    assert got == {"a": 30, "b": 20, "kept": 50}


def test_resample(spark):
    src = cells(spark, [[1, 2], [3, 4]])
    s = spark.sql("SELECT 0 AS aoi_id, 0D AS origin_x, 2D AS origin_y, 1D AS px_w, -1D AS px_h")
    t = spark.sql("SELECT 0 AS aoi_id, 0D AS origin_x, 2D AS origin_y, 0.5D AS px_w, -0.5D AS px_h, 4 AS height, 5 AS width")
    got = grid_of(raster.resample_nearest(src, s, t, "z"), "z", (4, 5))
    assert got[0, 0] == 1 and got[3, 3] == 4 and np.isnan(got[:, 4]).all()


def test_slope(spark):
    ramp = np.tile(np.arange(20.0), (5, 1))
    got = grid_of(terrain.slope_degrees(cells(spark, ramp), 1.0, 1.0), "slope", ramp.shape)
    assert got[2, 10] == pytest.approx(45.0)
    rng = np.random.default_rng(1)
    z = rng.normal(size=(6, 8)) * 10
    gy, gx = np.gradient(z, 20, 30)
    got = grid_of(terrain.slope_degrees(cells(spark, z), 30.0, 20.0), "slope", z.shape)
    assert np.allclose(got, np.degrees(np.arctan(np.hypot(gx, gy))))


def test_radar_shadow(spark):
    steep = cells(spark, 2.0 * np.tile(19 - np.arange(20.0), (5, 1)))
    g = terrain.gradient(steep, 1.0, 1.0)
    assert g.where(terrain.radar_shadow(90.0)).count() == 100
    assert g.where(terrain.radar_shadow(0.0)).count() == 0


def test_drainage_plane(spark):
    z = np.repeat(10.0 * np.arange(10)[:, None], 5, axis=1)
    df = terrain.drainage(cells(spark, z), 5, 30.0, 30.0)
    acc, hand = grid_of(df, "accumulation", z.shape), grid_of(df, "hand", z.shape)
    assert (acc[0, 0], acc[9, 0], acc[5, 0]) == (10, 1, 5)
    assert (hand[5, 0], hand[6, 0], hand[9, 0]) == (0, 10, 40)
    assert np.isnan(grid_of(terrain.drainage(cells(spark, z), 1000, 30.0, 30.0), "hand", z.shape)).all()


def test_receivers_agree_with_accumulation(spark):
    rng = np.random.default_rng(5)
    z = rng.random((8, 8))
    to = {(r.row, r.col): (r.to_row, r.to_col) for r in terrain.receivers(cells(spark, z), 30.0, 30.0).collect()}
    count = {}
    for at in to:
        while at[0] is not None:
            count[at] = count.get(at, 0) + 1
            at = to[at]
    acc = terrain.accumulate(z, 30.0, 30.0)
    assert all(acc[k] == v for k, v in count.items())
    start = max(to, key=lambda k: z[k])
    path = terrain.trace_downstream(terrain.receivers(cells(spark, z), 30.0, 30.0), spark.createDataFrame([(0, *start)], "aoi_id int, row int, col int"))
    last = path.orderBy(F.desc("step")).first()
    assert to[(last.row, last.col)] == (None, None)


def blob(spark, mask):
    return spark.createDataFrame([(0, int(r), int(c)) for r, c in np.argwhere(np.asarray(mask))], "aoi_id int, row int, col int")


def test_components(spark):
    m = np.zeros((8, 8), bool)
    m[0:3, 0:3] = True
    m[6, 6] = True
    labelled = components.label_components(blob(spark, m))
    assert labelled.select("component").distinct().count() == 2
    assert components.large_components(labelled, 9).count() == 9
    assert {r.component for r in labelled.where("row = 0").collect()} == {1}
    diagonal = np.eye(4, dtype=bool)
    assert components.label_components(blob(spark, diagonal)).select("component").distinct().count() == 1
    assert components.label_components(blob(spark, diagonal), 4).select("component").distinct().count() == 4
    assert components.label_components(blob(spark, diagonal).limit(0)).count() == 0


def test_polygons(spark):
    import json

    m = np.zeros((6, 6), bool)
    m[0:4, 0:4] = True
    m[1:3, 1:3] = False
    m[4, 4] = True
    labelled = components.label_components(blob(spark, m))
    g = spark.sql("SELECT 0 AS aoi_id, 10D AS origin_x, 20D AS origin_y, 0.5D AS px_w, -0.5D AS px_h")
    rows = components.polygons(labelled, g).collect()
    assert len(rows) == 2 and {r.pixel_count for r in rows} == {13} and {r.component for r in rows} == {1}
    ring = json.loads(next(r for r in rows if r.part == 1).geometry)["coordinates"]
    assert len(ring) == 2 and sorted(map(tuple, ring[0][:-1])) == [(10.0, 18.0), (10.0, 20.0), (12.0, 18.0), (12.0, 20.0)]


def test_scl(spark):
    df = spark.createDataFrame([(k, v) for k, a in {"a": [8, 9, 4, 6, 10, 4, 6, 6], "b": [0, 0, 8, 3], "c": [0] * 9}.items() for v in a], "scene_id string, scl int")
    assert {r.scene_id: r.cloud_pct for r in raster.cloud_cover(df).collect()} == {"a": 37.5, "b": 50.0, "c": None}
    h = spark.createDataFrame([("x", v) for v in (0, 0, 1, 8, 9, 10, 4, 4)], "scene_id string, scl int")
    rows = raster.scl_histogram(h).collect()
    assert len(rows) == 12 and rows[0].total == 8 and rows[0].valid == 6 and rows[0].valid_pct == 75.0 and {r.scl: r.n for r in rows}[4] == 2


def test_band_quality(spark):
    rows = [(0, k, -10.0 - k, 1.0) for k in range(13)] + [(0, 13, None, 1.0), (0, 14, -60.0, 1.0), (0, 15, -12.0, 0.0)]
    df = spark.createDataFrame(rows, "scene_id int, i int, vv double, mask double")
    r = raster.band_stats(df, ("vv",)).first()
    assert r.nodata_pct == 100 * 3 / 16 and r.nonfinite_pct == 100 / 16 and r.p50 == -16.0
    assert raster.band_warnings(raster.band_stats(df, ("vv",))).first().reason.startswith("VV nodata=18.8%>5%")


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(6)
    groups = {"many": rng.normal(size=5000), "ties": np.repeat([-60.0, -60.0, 1.5], 400), "far": np.append(rng.random(999), 1e12), "one": np.array([3.25]), "two": np.array([1.0, 2.0]), "none": np.array([])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(k, None) for k in groups]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p for r in raster.percentiles(df, ["k"], "v", (0.0, 0.01, 0.5, 0.99, 1.0), 64).collect()}
    for k, v in groups.items():
        assert got[k] is None if k == "none" else got[k] == pytest.approx(np.percentile(v, [0, 1, 50, 99, 100]), rel=1e-12)
    assert got.keys() == groups.keys()


def test_outlines_are_traced_many_in_a_task_across_batches(spark):
    """Two components that touch only by labels, parts that spread over several batches; no Python call for each part."""
    rows = [(a, 1, r, c) for a in ("x", "y") for r in range(4) for c in range(4)] + [("x", 2, r, c) for r in range(4) for c in (4, 5)] + [("x", 2, 5, 6), ("x", 2, 4, 8)]
    labelled = spark.createDataFrame(rows, "aoi_id string, component int, row int, col int")
    grid = spark.sql("SELECT explode(array('x', 'y')) AS aoi_id, 0D AS origin_x, 0D AS origin_y, 1D AS px_w, -1D AS px_h")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = components.polygons(labelled, grid)
        got = sorted((r.aoi_id, r.component, r.part, r.pixel_count, json.loads(r.geometry)["coordinates"][0][2]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [("x", 1, 1, 16, [4.0, -4.0]), ("x", 2, 1, 10, [6.0, -4.0]), ("x", 2, 2, 10, [9.0, -5.0]), ("x", 2, 3, 10, [7.0, -6.0]), ("y", 1, 1, 16, [4.0, -4.0])]
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()

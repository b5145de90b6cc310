import math

import pytest
from pyspark.sql import functions as F

from hydrograin.config import Config, digest
from hydrograin.errors import FloodError
from hydrograin.functions import classify, geo, text, wkb


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lits(*values):
    return [F.lit(v) for v in values]


def test_log_ratio_and_combine(spark):
    r = one(spark, a=classify.log_ratio(F.lit(0.0), F.lit(-5.0)), b=classify.log_ratio(F.lit(-12.0), F.lit(-2.0)), c=classify.combine(F.lit(-4.0), F.lit(-8.0), 0.5, 0.5), d=classify.combine(F.lit(-4.0), F.lit(-8.0), 1, 0), e=classify.combine(F.lit(None).cast("double"), F.lit(-8.0)))
    assert (r.a, r.b, r.c, r.d, r.e) == (5.0, -10.0, -6.0, -4.0, None)
    with pytest.raises(ValueError):
        classify.combine(F.lit(1), F.lit(1), 0, 0)


def test_probability(spark):
    r = one(spark, a=classify.probability(F.lit(-3.0), -3.0, 1.0), b=classify.probability(F.lit(-4.0), -3.0, 1.0), c=classify.probability(F.lit(1e9), 0.0, 1.0))
    assert r.a == 0.5 and r.b == pytest.approx(1 / (1 + math.exp(-1))) and 0 < r.c < 1e-25
    with pytest.raises(ValueError):
        classify.probability(F.lit(0.0), 0.0, 0.0)


def test_status_and_confidence(spark):
    df = spark.createDataFrame([(0.0,), (0.04,), (0.05,), (0.24,), (0.25,), (1.0,)], "f double")
    assert [r[0] for r in df.select(classify.status_code(F.col("f"))).collect()] == [0, 0, 1, 1, 2, 2]
    tiers = spark.createDataFrame([(0.0,), (0.5,), (0.10,), (0.22,)], "f double")
    assert [r[0] for r in tiers.select(classify.confidence(F.col("f"))).collect()] == ["high", "high", "medium", "low"]
    assert one(spark, t=classify.confidence(F.lit(0.5), F.lit(True))).t == "medium"


def test_usable_pixels(spark):
    df = spark.createDataFrame([(-12.0, 1), (float("nan"), 1), (-60.0, 1), (-12.0, 0), (float("inf"), 1), (None, 1)], "v double, m int")
    assert [r[0] for r in df.select(classify.usable(F.col("v"), F.col("m"))).collect()] == [True, False, False, False, False, False]


def test_geo(spark):
    r = one(spark, epsg=geo.utm_epsg(F.lit(85.25), F.lit(27.95)), south=geo.utm_epsg(F.lit(85.25), F.lit(-27.95)), km2=geo.bbox_area_km2(*lits(85.15, 27.85, 85.35, 28.05)), urn=geo.crs_urn(F.lit("EPSG:32645")), az=geo.look_azimuth(F.lit("descending")))
    assert (r.epsg, r.south, r.km2, r.urn, r.az) == (32645, 32745, 436.88, "urn:ogc:def:crs:EPSG::32645", 270.0)
    assert geo.output_size((85.15, 27.85, 85.35, 28.05), 20) == (983, 1113)
    wide = geo.output_size((85.0, 27.0, 87.0, 28.0), 20)
    assert max(wide) == 2500


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(lon, lat) for lon in (81.1, 84.0, 86.9) for lat in (-60.0, -0.1, 27.9, 70.0)], "lon double, lat double")
    zone = F.lit(45)
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), zone)
    back = df.select("lon", "lat", e.alias("e"), n.alias("n"))
    lon, lat = geo.from_utm(F.col("e"), F.col("n"), zone)
    for r in back.withColumns({"x": lon, "y": lat}).collect():
        assert abs(r.x - r.lon) < 1e-9 and abs(r.y - r.lat) < 1e-9


def test_dem_tiles(spark):
    r = one(spark, a=geo.dem_tile_id(F.lit(27.9), F.lit(85.2)), b=geo.dem_tile_id(F.lit(-1.2), F.lit(-178.5)))
    assert r.a.endswith("N27_00_E085_00_DEM") and r.b.endswith("S02_00_W179_00_DEM")
    c = one(spark, s=geo.dem_tile_corner(F.lit(r.b))[0], w=geo.dem_tile_corner(F.lit(r.b))[1], bad=geo.dem_tile_corner(F.lit("x"))[0])
    assert (c.s, c.w, c.bad) == (-2, -179, None)
    w = geo.tile_window(F.lit(27), F.lit(85), *lits(85.15, 27.85, 85.2, 28.0), 3600)
    assert tuple(one(spark, a=w[0], b=w[1], c=w[2], d=w[3])) == (0, 540, 540, 720)
    box = spark.createDataFrame([(84.9, 27.9, 85.1, 28.1)], "min_lon double, min_lat double, max_lon double, max_lat double")
    assert geo.dem_tiles(box).count() == 4


def test_text(spark):
    values = F.create_map(F.lit("a"), F.lit("14.2"))
    r = one(spark, d=text.devanagari(F.lit("14.2")), en=text.render(F.lit("{a} of {b}"), values), ne=text.render(F.lit("{a}"), values, "ne"), i=text.intent(F.lit("who is CUT OFF?")), s=text.shifted(F.lit("2024-09-28"), 1, 60))
    assert (r.d, r.en, r.ne, r.i, r.s) == ("१४.२", "14.2 of {b}", "१४.२", "isolation", "2024-09-29T00:01:00Z")
    known = F.array(F.lit("a"))
    r = one(spark, ok=text.draft_valid(F.lit("{a} km"), known), unknown=text.unknown_placeholders(F.lit("{b} {a} {b}"), known), loose=text.loose_numerals(F.lit("12 of {a_1}")))
    assert r.ok and r.unknown == ["b"] and r.loose == ["12"]


def test_config():
    assert Config.of({"flood": {"tile_size": 256}}).flood.tile_size == 256
    with pytest.raises(ValueError):
        Config.of({"flood": {"tile": 1}})
    with pytest.raises(ValueError):
        Config.of({"other": {}})
    assert len(Config().hash()) == 16 and Config().hash() != Config.of({"flood": {"tile_size": 1}}).hash()
    assert digest({"b": 1, "a": 2}) == digest({"a": 2, "b": 1})
    assert FloodError("BUSY").payload()["error"]["message_key"] == "errors.busy"
    with pytest.raises(ValueError):
        FloodError("NONE")


def test_wkb_round_trip():
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
    for kind, c, n in (("Point", [1.0, 2.0], 1), ("LineString", ring, 1), ("Polygon", [ring, ring], 2), ("MultiPolygon", [[ring], [ring, ring]], 3), ("MultiLineString", [ring, ring], 2)):
        got = wkb.decode(wkb.encode(kind, c))
        assert got["kind"] == kind and len(got["parts"]) == n
    assert wkb.decode(None) is None and wkb.decode(b"\x01\x03") is None and wkb.decode(b"") is None
    assert wkb.decode(wkb.encode("LineString", [])) is None


def test_predicates(spark):
    outer = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    hole = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]
    df = spark.createDataFrame([(bytearray(wkb.encode("Polygon", [outer, hole])),)], "g binary").select(wkb.from_wkb(F.col("g")).alias("g"))
    e = wkb.sides(F.col("g.parts"))
    r = df.select(wkb.contains(e, F.lit(1.0), F.lit(1.0)).alias("a"), wkb.contains(e, F.lit(5.0), F.lit(5.0)).alias("b"), wkb.contains(e, F.lit(11.0), F.lit(5.0)).alias("c"), wkb.distance_squared(e, F.lit(13.0), F.lit(14.0)).alias("d"), wkb.representative_point(F.col("g.kind"), F.col("g.parts")).alias("p"), wkb.bounds(F.col("g.parts")).alias("b4")).first()
    assert (r.a, r.b, r.c, r.d) == (True, False, False, 25.0)
    assert tuple(r.p) in ((2.0, 5.0), (8.0, 5.0)) and tuple(r.b4) == (0, 0, 10, 10)


def test_feature_filter(spark):
    df = spark.createDataFrame([({"building": "yes"}, "Polygon"), ({"building": "no"}, "Polygon"), ({"highway": "footway"}, "LineString"), ({"highway": "track"}, "LineString"), ({"healthcare": "clinic"}, "Point"), (None, "Point")], "tags map<string,string>, k string")
    f = lambda *t: [bool(r[0]) for r in df.select(classify.feature_filter(list(t), F.col("tags"), F.col("k"))).collect()]
    assert f("building") == [True, False, False, False, False, False]
    assert f("highway", "amenity") == [False, False, False, True, True, False]
    with pytest.raises(ValueError):
        classify.feature_filter(["river"], F.col("tags"), F.col("k"))


def test_half_even_agrees_with_exact_rounding(spark):
    import random

    from hydrograin.functions.numbers import half_even

    rng = random.Random(9)
    values = [2.675, 0.5, 1.5, 2.5, 0.125, 0.375, -2.675, -0.125, 1.005, 0.00005, 0.0, 1e300, -1e17, 4503599627370497.5, 0.1 + 0.2, 1 / 3]
    values += [rng.randrange(10**6) / 10**rng.randrange(1, 7) for _ in range(3000)] + [rng.uniform(-1e3, 1e3) for _ in range(2000)] + [rng.randrange(-400, 400) / 2 ** rng.randrange(1, 8) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for digits in (0, 2, 4, 6, 9):
        got = df.select("v", half_even(F.col("v"), digits).alias("r")).collect()
        for r in got:
            assert r.r is None if r.v is None else r.r == round(r.v, digits)


def test_geometries_of_a_batch(spark):
    """All at once, as one by one: plain ones, others, and what cannot be read."""
    import random
    import struct
    import time

    import pyarrow as pa

    rng = random.Random(3)
    pt = lambda: [rng.uniform(-180, 180), rng.uniform(-90, 90)]
    ring = lambda n: (lambda r: [*r, r[0]])([pt() for _ in range(n)])
    rows = [None, b"", b"\x01\x03", b"x" * 40, wkb.encode("LineString", []), wkb.encode("Point", [float("nan"), float("nan")]), wkb.encode("Polygon", [])]
    for _ in range(400):
        rows.append(
            rng.choice(
                [
                    wkb.encode("Point", pt()), wkb.encode("LineString", [pt() for _ in range(rng.randrange(1, 9))]), wkb.encode("Polygon", [ring(rng.randrange(3, 9))]),
                    wkb.encode("Polygon", [ring(4), ring(3)]), wkb.encode("MultiPolygon", [[ring(3)], [ring(5), ring(3)]]), wkb.encode("MultiLineString", [[pt(), pt()], [pt(), pt(), pt()]]),
                    wkb.encode("LineString", [pt(), pt()])[:-3], struct.pack(">BIdd", 0, 1, *pt()), struct.pack("<BIddd", 1, 1001, *pt(), 7.0), None,
                ]
            )
        )
    for a in (pa.array(rows, pa.binary()), pa.array([b"zz", *rows], pa.binary()).slice(1)):
        got = wkb.decode_batch(a).to_pylist()
        for raw, g in zip(rows, got):
            one = wkb.decode(raw)
            assert g == (one or {"kind": None, "parts": None})
    assert len(wkb.decode_batch(pa.array([], pa.binary()))) == 0
    many = pa.array([wkb.encode("Polygon", [ring(5)]) for _ in range(60_000)], pa.binary())
    began = time.perf_counter()
    assert len(wkb.decode_batch(many)) == 60_000
    print(f"60,000 footprints in {time.perf_counter() - began:.2f} s")
    df = spark.createDataFrame([(bytearray(r) if r is not None else None,) for r in rows], "g binary").select(wkb.from_wkb(F.col("g")).alias("g"))
    assert sum(r.g.parts is not None for r in df.collect()) == sum(wkb.decode(r) is not None for r in rows)


def test_representative_points_of_a_batch(spark):
    """Inside the widest run of any polygon, also where a neighbour in the batch is not closed or has no vertex."""
    rings = {
        0: ("Polygon", [[[0.0, 0.0], [10.0, 0.0], [10.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [4.0, 1.0], [4.0, 3.0], [1.0, 3.0], [1.0, 1.0]]]),
        1: ("Polygon", [[[0.0, 0.0], [3.0, 0.0], [3.0, 2.0]]]),  # open
        2: ("Polygon", [[[5.0, 0.0], [7.0, 0.0], [7.0, 2.0], [5.0, 2.0], [5.0, 0.0]]]),
        3: ("LineString", [[0.0, 0.0], [1.0, 5.0], [2.0, 0.0]]),
        4: ("Point", [8.0, 9.0]),
        5: ("LineString", []),
    }
    df = spark.createDataFrame([(k, bytearray(wkb.encode(*g))) for k, g in rings.items()], "k int, g binary").coalesce(1)
    found = df.select("k", wkb.from_wkb(F.col("g")).alias("g")).select("k", wkb.representative_point(F.col("g.kind"), F.col("g.parts")).alias("p"))
    got = {r.k: (r.p.x, r.p.y) for r in found.collect()}
    assert got[0] == (7.0, 2.0) and got[2] == (6.0, 1.0) and got[3] == (1.0, 5.0) and got[4] == (8.0, 9.0) and got[5] == (None, None) and got[1][0] is not None

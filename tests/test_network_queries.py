"""Registered queries against their SQL on the driver's smallest tables, and terrain of several areas at once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrograin.operators import graph, terrain
from hydrograin.plans import flood, network_queries, queries

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", sorted(n for n, f in queries.QUERIES.items() if f.__module__ == network_queries.__name__))
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_terrain_of_areas_at_different_latitudes(spark):
    rng = np.random.default_rng(3)
    z = {a: rng.random((8, 8)) * 50 for a in (1, 2)}
    cells = lambda *areas: spark.createDataFrame([(a, r, c, float(z[a][r, c])) for a in areas for r in range(8) for c in range(8)], "aoi_id int, row int, col int, z double")
    places = {1: (0.5, "ASCENDING"), 2: (60.5, "DESCENDING")}
    grid = lambda *areas: spark.createDataFrame([(a, 10.0, places[a][0], 0.01, -0.01, 8, 8, places[a][1]) for a in areas], "aoi_id int, origin_x double, origin_y double, px_w double, px_h double, height int, width int, direction string")
    both = sorted(tuple(r) for r in flood.terrain_layers(cells(1, 2), grid(1, 2), grid(1, 2), F.col("direction"), 4).collect())
    single = [tuple(r) for a in (1, 2) for r in flood.terrain_layers(cells(a), grid(a), grid(a), places[a][1], 4).collect()]
    assert both == sorted(single) and len(both) == 128


def test_walks_against_plain_loops():
    from collections import deque

    rng = np.random.default_rng(9)
    for _ in range(5):
        z = np.where(rng.random((12, 15)) < 0.1, np.nan, rng.integers(0, 30, (12, 15)).astype(float))
        total = terrain.accumulate(z, 30.0, 20.0)
        source = (total >= 4) & ~np.isnan(z)
        base, queue = np.full(z.shape, np.nan), deque(map(tuple, np.argwhere(source)))
        for at in queue:
            base[at] = z[at]
        while queue:
            r, c = queue.popleft()
            for a, b in terrain.STEPS:
                at = r + a, c + b
                if 0 <= at[0] < 12 and 0 <= at[1] < 15 and np.isnan(base[at]) and not np.isnan(z[at]):
                    base[at] = base[r, c]
                    queue.append(at)
        np.testing.assert_array_equal(terrain.above_source(z, source), z - base)


def test_relax_goes_on_until_nothing_changes(spark):
    edges = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(9)] + [(0, 0, 9, 100.0)], "aoi_id int, u int, v int, length_m double")
    start = spark.createDataFrame([(0, 0)], "aoi_id int, node_id int")
    assert {r.node_id: r.distance for r in graph.relax(edges, start).collect()} == {i: float(i) for i in range(10)}
    assert {r.node_id: r.distance for r in graph.relax(edges, start, 1).collect()} == {0: 0.0, 1: 1.0, 9: 100.0}


def test_cells_just_at_the_distance_of_a_line(spark, tmp_path):
    """Supplier 5884 has cells at 1.7 from its line, but for rounding; its SQL takes the line's extent as it is given."""
    import duckdb

    spark.range(600_000).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(5884,), (57,), (120,)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("events", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(tuple(r) for r in queries.QUERIES["buffer_cells"](spark, str(tmp_path)).collect()) == sorted(con.execute(queries.ORACLES["buffer_cells"]).fetchall())


def test_receivers_are_found_once_for_all_steps_of_a_trace(spark, tmp_path):
    def marked(batches):
        (tmp_path / os.urandom(8).hex()).touch()
        yield from batches

    received = spark.range(1, 30).selectExpr("0 AS aoi_id", "0 AS row", "CAST(id AS INT) AS col", "0 AS to_row", "CAST(id - 1 AS INT) AS to_col").coalesce(1)
    received = received.mapInArrow(marked, received.schema)
    got = terrain.trace_upstream(received, spark.createDataFrame([(0, 0, 0)], "aoi_id int, row int, col int"))
    assert sorted((r.col, r.step) for r in got.collect()) == [(n, n) for n in range(30)]
    assert len(list(tmp_path.iterdir())) == 1

"""Distances over parts against one heap for the whole graph."""

import random

from hydrograin.operators import graph, paths


def test_against_the_whole_graph(spark):
    rng, edges, sources, expected = random.Random(2), [], [], {}
    for k in range(25):
        n = rng.randrange(1, 60)
        own = {(min(e), max(e)): rng.choice([0.0, 1.0, rng.random() * 9]) for e in ((rng.randrange(n), min(n - 1, abs(rng.randrange(n)))) for _ in range(rng.randrange(2 * n))) if e[0] != e[1]}
        if k == 0:  # one way through every part and back
            n, own = 60, {(i, i + 7): 1.0 for i in range(50)} | {(50, 59): 0.5}
        starts = rng.sample(range(n), min(n, rng.randrange(4)))
        edges += [(f"a{k}", u, v, w) for (u, v), w in own.items()]
        sources += [(f"a{k}", s) for s in starts]
        expected |= {(f"a{k}", node): d for node, d in graph.shortest([(u, v, w) for (u, v), w in own.items()], starts).items()}
    e = spark.createDataFrame(edges, "aoi_id string, u int, v int, length_m double")
    s = spark.createDataFrame(sources + sources[:3], "aoi_id string, node_id int")
    for part in (5, 1000):
        rows = paths.distances(e, s, part=part).collect()
        assert {(r.aoi_id, r.node_id): r.distance for r in rows} == expected and len(rows) == len(expected)
    assert paths.distances(e.where("false"), s.where("false")).count() == 0


def test_a_long_way_through_many_parts(spark):
    e = spark.range(0, 400).selectExpr("'a' AS aoi_id", "CAST(id AS INT) AS u", "CAST(id + 1 AS INT) AS v", "0.1D AS length_m")
    s = spark.createDataFrame([("a", 0)], "aoi_id string, node_id int")
    found = {r.node_id: r.distance for r in paths.distances(e, s, part=50).collect()}
    assert found == graph.shortest([(i, i + 1, 0.1) for i in range(400)], [0])

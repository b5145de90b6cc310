"""Drainage over tiles against the walks over whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrograin.operators import terrain, tiled


def table(spark, grids):
    rows = [(name, r + dr, c + dc, None if np.isnan(z[r, c]) else float(z[r, c]), x, y) for name, (z, (dr, dc), x, y) in grids.items() for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "aoi_id string, row int, col int, z double, x double, y double")


def made(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 30, 2)
    kind = seed % 5
    z = rng.random((h, w))
    if kind == 1:
        z = rng.integers(0, 4, (h, w)).astype(float)  # many ties
    elif kind == 2:
        z = z * 0.3 + np.add.outer(np.arange(h), 2.0 * np.arange(w))  # long rivers
    elif kind == 3:
        z[rng.random((h, w)) < 0.25] = np.nan
    elif kind == 4:
        z = np.cumsum(z, axis=0)
        z[:, w // 2] = np.nan
    return z, tuple(int(v) for v in rng.integers(-9, 40, 2)), float(rng.integers(10, 40)), float(rng.integers(10, 40))


@pytest.mark.parametrize("threshold", [3, 12])
def test_against_whole_arrays(spark, threshold):
    grids = {f"g{k}": made(k) for k in range(50)}
    got = tiled.drainage(table(spark, grids), threshold, F.col("x"), F.col("y"), side=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.aoi_id, []).append(r)
    reached = 0
    for name, (z, (dr, dc), x, y) in grids.items():
        total = terrain.accumulate(z, x, y)
        source = (total >= threshold) & ~np.isnan(z)
        hand = terrain.above_source(z, source)
        own = by[name]
        assert len(own) == z.size
        for r in own:
            p, q = r.row - dr, r.col - dc
            assert r.accumulation == total[p, q]
            assert (r.hand is None and np.isnan(hand[p, q])) or r.hand == hand[p, q]
            reached += r.hand is not None
    assert reached > 3000


def test_a_river_through_many_tiles(spark):
    # Water winds through every row, so that each tile is entered and left many times.
    h = w = 40
    z, level = np.full((h, w), 1e6), float(h * w)
    for r in range(0, h, 2):
        for c in range(w) if r % 4 == 0 else range(w - 1, -1, -1):
            z[r, c] = level = level - 1
        if r + 2 < h:
            z[r + 1, w - 1 if r % 4 == 0 else 0] = level = level - 1
    got = tiled.drainage(table(spark, {"a": (z, (0, 0), 1.0, 1.0)}), 400, F.col("x"), F.col("y"), side=8).collect()
    total, grid = terrain.accumulate(z, 1.0, 1.0), np.zeros((h, w))
    for r in got:
        grid[r.row, r.col] = r.accumulation
    assert (grid == total).all() and total.max() > 1000


def test_empty_and_missing(spark):
    none = table(spark, {"a": (np.full((3, 3), np.nan), (0, 0), 1.0, 1.0)})
    assert [(r.accumulation, r.hand) for r in tiled.drainage(none, 1, 1.0, 1.0, side=2).collect()] == [(0, None)] * 9
    assert tiled.drainage(none.where("false"), 1, 1.0, 1.0).count() == 0
    gaps = table(spark, {"a": (np.arange(9.0).reshape(3, 3), (0, 0), 1.0, 1.0)}).where("row != 1")
    assert sorted((r.row, r.col) for r in tiled.drainage(gaps, 1, 1.0, 1.0, side=2).collect()) == [(r, c) for r in (0, 2) for c in range(3)]


def flood_fill(mask, connectivity):
    """Numbers of components by first cell in row-major order, one cell at a time."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not a or not b)]
    number, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if not number[r, c]:
            n += 1
            number[r, c], todo = n, [(r, c)]
            while todo:
                p, q = todo.pop()
                for a, b in near:
                    if 0 <= p + a < mask.shape[0] and 0 <= q + b < mask.shape[1] and mask[p + a, q + b] and not number[p + a, q + b]:
                        number[p + a, q + b] = n
                        todo.append((p + a, q + b))
    return number


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_over_tiles(spark, connectivity):
    from hydrograin.operators import components

    rng, rows, expected = np.random.default_rng(connectivity), [], {}
    for k in range(12):
        mask = rng.random((rng.integers(1, 60), rng.integers(1, 60))) < (0.4, 0.55, 0.7)[k % 3]
        if k == 0:  # one spiral through all tiles
            mask = np.ones((41, 41), bool)
            for d in range(1, 21, 2):
                mask[d, d : 41 - d] = mask[40 - d, d : 41 - d] = mask[d : 41 - d, d] = mask[d : 41 - d, 40 - d] = False
                mask[d + 1, d] = True
        number, (dr, dc) = flood_fill(mask, connectivity), rng.integers(-40, 40, 2)
        for r, c in zip(*np.nonzero(mask)):
            rows.append((f"a{k}", int(r + dr), int(c + dc), f"{r}"))
            expected[f"a{k}", r + dr, c + dc] = number[r, c]
    df = spark.createDataFrame(rows + rows[:5], "aoi_id string, row int, col int, `x.y` string")
    got = components.label_components(df, connectivity, side=8).collect()
    assert len(got) == len(rows) + 5 and {(r.aoi_id, r.row, r.col): r.component for r in got} == expected and got[0]["x.y"] is not None
    assert components.label_components(df.where("false")).count() == 0

"""Drainage of rasters cut into tiles: no task holds more than one tile, whatever the size of an area.

Flow accumulates inside each tile first. Where water leaves a tile, its cell becomes a node of a forest: it hands its
total to the node by which that water leaves the next tile. The forest is solved by doubling, in as many rounds as the
logarithm of the tiles that the longest river crosses; what enters each tile then flows through it once more.

Height above drainage belongs to the nearest source by steps, and among equally near ones to the first in row-major
order, which is what a queue of cells gives: it serves those of the first source first. So each cell keeps the least
(steps, source), and tiles exchange these along their borders until none gets less.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import release, stage

#: Steps to the eight neighbours in the order that breaks ties: NW, N, NE, W, E, SW, S, SE.
STEPS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
#: Rows and columns of a tile.
SIDE = 512
#: A cell's number in its area, in row-major order: row times WIDE plus column, both moved to be positive.
WIDE, MIDDLE = 1 << 31, 1 << 30
_FAR = np.iinfo(np.int32).max
_LABEL = np.dtype([("cell", "<i8"), ("steps", "<i4"), ("source", "<i8"), ("z", "<f8")])


def targets(padded: np.ndarray, x_m: float, y_m: float) -> np.ndarray:
    """For each cell within the one-cell frame the number of the step of steepest descent; -1 for sinks and missing cells."""
    h, w = padded.shape[0] - 2, padded.shape[1] - 2
    z = padded[1:-1, 1:-1]
    falls = np.stack([(z - padded[1 + a : 1 + a + h, 1 + b : 1 + b + w]) / np.hypot(b * x_m, a * y_m) for a, b in STEPS])
    falls = np.nan_to_num(falls, nan=-1.0)
    return np.where(falls.max(axis=0) > 0, falls.argmax(axis=0), -1)


def inside(step: np.ndarray) -> np.ndarray:
    """Flat places that cells drain to, by the numbers of their steps; -1 for sinks and for what leaves the array."""
    h, w = step.shape
    r, c = np.mgrid[0:h, 0:w]
    to_r, to_c = r + np.array([a for a, _ in STEPS])[step], c + np.array([b for _, b in STEPS])[step]
    stays = (step >= 0) & (to_r >= 0) & (to_r < h) & (to_c >= 0) & (to_c < w)
    return np.where(stays, to_r * w + to_c, -1).ravel()


def drained(to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of all places that drain through each, itself included."""
    total = weight.copy()
    # All places whose inflow is complete hand on their total at once.
    waits = np.bincount(to[to >= 0], minlength=len(to))
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        ready = ready[to[ready] >= 0]
        below = to[ready]
        np.add.at(total, below, total[ready])
        np.subtract.at(waits, below, 1)
        below = np.unique(below)
        ready = below[waits[below] == 0]
    return total


def ends(to: np.ndarray) -> np.ndarray:
    """The last place on the way from each."""
    end = np.where(to >= 0, to, np.arange(len(to)))
    while True:
        on = end[end]
        if (on == end).all():
            return end
        end = on


def nearest_source(z: np.ndarray, steps: np.ndarray, source: np.ndarray, base: np.ndarray) -> None:
    """Spread labels (steps, source, base) over the cells of z, framed by one cell of the tiles around; in place.

    Labelled cells keep what they have unless a cell next to them gives less; the frame gives, but gets nothing.
    Missing cells are barriers. steps is _FAR where a cell has no label.
    """
    wide = z.shape[1]
    step = np.array([a * wide + b for a, b in STEPS])
    open_ = ~np.isnan(z)
    open_[[0, -1]] = open_[:, [0, -1]] = False
    flat, steps, source, base = open_.ravel(), steps.ravel(), source.ravel(), base.ravel()
    r, c = np.divmod(np.arange(z.size), wide)
    frame = (r == 0) | (r == z.shape[0] - 1) | (c == 0) | (c == wide - 1)
    level = int(steps.min(initial=_FAR))
    while level < _FAR:
        front = np.flatnonzero(steps == level)
        edge = frame[front]
        to, by = [(front[~edge][:, None] + step).ravel()], [np.repeat(front[~edge], 8)]
        for a, b in STEPS:  # the frame's cells have neighbours on one side only
            own = front[edge]
            ok = (r[own] + a >= 0) & (r[own] + a < z.shape[0]) & (c[own] + b >= 0) & (c[own] + b < wide)
            to.append(own[ok] + a * wide + b)
            by.append(own[ok])
        to, by = np.concatenate(to), np.concatenate(by)
        better = flat[to] & ((steps[to] > level + 1) | ((steps[to] == level + 1) & (source[by] < source[to])))
        to, by = to[better], by[better]
        order = np.lexsort((source[by], to))
        to, first = np.unique(to[order], return_index=True)
        by = by[order][first]
        steps[to], source[to], base[to] = level + 1, source[by], base[by]
        rest = steps[steps > level]
        level = int(rest.min(initial=_FAR))


def packed(cells: DataFrame, x_m: Column, y_m: Column, z: str, key: str, side: int) -> DataFrame:
    """(aoi_id, ti, tj, x_m, y_m, z, here): a row for each tile with cells: heights, framed by one cell of the tiles around, and which cells there are."""
    number = lambda c, d: F.floor((F.col(c) + d) / side).cast("int")
    near = lambda c: F.array_distinct(F.array(*[number(c, d) for d in (-1, 0, 1)]))
    sent = cells.select(key, "row", "col", F.col(z).cast("double").alias("z"), x_m.cast("double").alias("x_m"), y_m.cast("double").alias("y_m"), F.explode(near("row")).alias("ti"))
    sent = sent.withColumn("tj", F.explode(near("col")))
    kind = dict(cells.dtypes)[key]

    def pack(rows: pa.Table) -> pa.Table:
        area, ti, tj, x_m, y_m = (rows.column(c)[0].as_py() for c in (key, "ti", "tj", "x_m", "y_m"))
        kinds = pa.schema([(key, rows.schema.field(key).type), ("ti", pa.int32()), ("tj", pa.int32()), ("x_m", pa.float64()), ("y_m", pa.float64()), ("z", pa.binary()), ("here", pa.binary())])
        r, c = rows.column("row").to_numpy() - ti * side + 1, rows.column("col").to_numpy() - tj * side + 1
        own = (r > 0) & (r <= side) & (c > 0) & (c <= side)
        if not own.any():
            return kinds.empty_table()
        a, here = np.full((side + 2, side + 2), np.nan), np.zeros((side, side), bool)
        a[r, c] = rows.column("z").to_numpy()
        here[r[own] - 1, c[own] - 1] = True
        found = (area, ti, tj, x_m, y_m, zlib.compress(a.tobytes(), 1), zlib.compress(np.packbits(here).tobytes(), 1))
        return pa.table([[x] for x in found], schema=kinds)

    return sent.groupBy(key, "ti", "tj").applyInArrow(pack, f"{key} {kind}, ti int, tj int, x_m double, y_m double, z binary, here binary")


def _heights(blob: bytes, side: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=float).reshape(side + 2, side + 2)


def _numbers(ti: int, tj: int, side: int, frame: int = 0) -> np.ndarray:
    """Numbers of a tile's cells in its area, with a frame of so many cells around."""
    r, c = np.mgrid[ti * side - frame : ti * side + side + frame, tj * side - frame : tj * side + side + frame]
    return (r + MIDDLE) * WIDE + (c + MIDDLE)


def _border(side: int) -> np.ndarray:
    """Flat places of a tile's outermost cells."""
    edge = np.ones((side, side), bool)
    edge[1:-1, 1:-1] = False
    return np.flatnonzero(edge)


def _inflow(tiles: DataFrame, key: str, side: int) -> DataFrame:
    """(aoi_id, ti, tj, cell, n): cells that water enters a tile by, and how much of it."""
    kind = dict(tiles.dtypes)[key]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = _border(side)
        for b in batches:
            for area, ti, tj, x_m, y_m, blob in zip(*(b.column(k).to_pylist() for k in range(6))):
                padded = _heights(blob, side)
                step = targets(padded, x_m, y_m)
                to, number = inside(step), _numbers(ti, tj, side).ravel()
                total = drained(to, (~np.isnan(padded[1:-1, 1:-1])).astype(np.int64).ravel())
                flat = step.ravel()
                leaves = (flat >= 0) & (to < 0)
                shift = np.array([a * WIDE + d for a, d in STEPS])
                end = ends(to)[edge]
                some = ~np.isnan(padded[1:-1, 1:-1].ravel()[edge])
                cell, end = edge[some], end[some]
                out = leaves[cell]
                n = len(cell)
                columns = [
                    pa.array([area] * n, b.column(0).type), pa.array([ti] * n, pa.int32()), pa.array([tj] * n, pa.int32()), pa.array(number[cell]), pa.array(number[end], mask=~leaves[end]),
                    pa.array(np.where(out, total[cell], 0)), pa.array(number[cell] + shift[flat[cell]], mask=~out),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "ti", "tj", "cell", "exit", "n", "into"])

    schema = f"{key} {kind}, ti int, tj int, cell long, exit long, n long, into long"
    border = stage(tiles.select(key, "ti", "tj", "x_m", "y_m", "z").mapInArrow(local, schema))
    enters = border.select(key, F.col("cell").alias("into"), F.col("exit").alias("next"))
    # Nodes: cells that water leaves a tile by; the next node is where it leaves the tile that it enters.
    now = stage(border.where("into IS NOT NULL").select(key, "cell", "n", "into").join(enters, [key, "into"]).select(key, "cell", "n", "next", "into"))
    crossings = now.select(key, "cell", "into")
    while not now.where("next IS NOT NULL").isEmpty():
        # n: all that flows in over less than 2**k nodes, next: the node 2**k further down.
        more = now.where("next IS NOT NULL").groupBy(key, F.col("next").alias("cell")).agg(F.sum("n").alias("more"))
        further = now.select(key, F.col("cell").alias("next"), F.col("next").alias("after"))
        on = now.select(key, "cell", "n", "next").join(more, [key, "cell"], "left").join(further, [key, "next"], "left")
        after = stage(on.select(key, "cell", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("after").alias("next")))
        if "into" not in now.columns:
            release(now)
        now = after
    sums = now.select(key, "cell", "n").join(crossings, [key, "cell"])
    row, col = F.floor(F.col("into") / F.lit(WIDE)) - MIDDLE, F.col("into") % WIDE - MIDDLE
    found = sums.groupBy(key, "into").agg(F.sum("n").alias("n"))
    found = stage(found.select(key, F.floor(row / side).cast("int").alias("ti"), F.floor(col / side).cast("int").alias("tj"), F.col("into").alias("cell"), "n"))
    release(border)
    return found


def _flowing(tiles: DataFrame, inflow: DataFrame, key: str, side: int) -> DataFrame:
    """tiles with `total`, the accumulated flow of their cells, deflated."""
    own = inflow.groupBy(key, "ti", "tj").agg(F.collect_list(F.struct("cell", "n")).alias("enters"))
    joined = tiles.join(own, [key, "ti", "tj"], "left").select(*tiles.columns, "enters")
    at, names = {c: k for k, c in enumerate(joined.columns)}, [*tiles.columns, "total"]

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for ti, tj, x_m, y_m, blob, enters in zip(*(b.column(at[c]).to_pylist() for c in ("ti", "tj", "x_m", "y_m", "z", "enters"))):
                padded = _heights(blob, side)
                weight = (~np.isnan(padded[1:-1, 1:-1])).astype(np.int64).ravel()
                for e in enters or ():
                    r, c = e["cell"] // WIDE - MIDDLE - ti * side, e["cell"] % WIDE - MIDDLE - tj * side
                    weight[r * side + c] += e["n"]
                made.append(zlib.compress(drained(inside(targets(padded, x_m, y_m)), weight).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], names)

    return joined.mapInArrow(flow, joined.drop("enters").withColumn("total", F.lit(None).cast("binary")).schema)


def _solved(z: np.ndarray, total: np.ndarray, threshold: int, ti: int, tj: int, side: int, around: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, source, base) of a tile with its frame, from its own sources and the labels around."""
    number = _numbers(ti, tj, side, 1)
    steps, source, base = np.full(z.shape, _FAR, np.int32), np.full(z.shape, np.iinfo(np.int64).max), np.full(z.shape, np.nan)
    own = np.zeros(z.shape, bool)
    own[1:-1, 1:-1] = (total >= threshold) & ~np.isnan(z[1:-1, 1:-1])
    steps[own], source[own], base[own] = 0, number[own], z[own]
    for blob in around:
        x = np.frombuffer(blob, _LABEL)
        r, c = x["cell"] // WIDE - MIDDLE - ti * side + 1, x["cell"] % WIDE - MIDDLE - tj * side + 1
        near = (r >= 0) & (r < side + 2) & (c >= 0) & (c < side + 2)
        r, c, x = r[near], c[near], x[near]
        steps[r, c], source[r, c], base[r, c] = x["steps"], x["source"], x["z"]
    nearest_source(z, steps, source, base)
    return steps, source, base


def _around(labels: DataFrame, key: str) -> DataFrame:
    """(aoi_id, ti, tj, around): the border labels of the up to eight tiles around each."""
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS])).alias("s")
    sent = labels.where("length(labels) > 0").select(key, "ti", "tj", "labels", sides)
    return sent.groupBy(key, (F.col("ti") + F.col("s.a")).alias("ti"), (F.col("tj") + F.col("s.b")).alias("tj")).agg(F.collect_list("labels").alias("around"))


def _exchanged(tiles: DataFrame, threshold: int, key: str, side: int) -> DataFrame:
    """(aoi_id, ti, tj, labels): the border labels of all tiles, once no tile gives another a lesser one."""
    kind = dict(tiles.dtypes)[key]
    schema = f"{key} {kind}, ti int, tj int, labels binary"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = _border(side)
        for b in batches:
            made = []
            for ti, tj, blob, total, around in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
                z = _heights(blob, side)
                steps, source, base = (a[1:-1, 1:-1].ravel()[edge] for a in _solved(z, np.frombuffer(zlib.decompress(total), np.int64).reshape(side, side), threshold, ti, tj, side, around or []))
                some = steps < _FAR
                out = np.zeros(some.sum(), _LABEL)
                out["cell"], out["steps"], out["source"], out["z"] = _numbers(ti, tj, side).ravel()[edge][some], steps[some], source[some], base[some]
                made.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.binary())], [key, "ti", "tj", "labels"])

    def run(some: DataFrame, labels: DataFrame | None) -> DataFrame:
        rows = some.join(_around(labels, key), [key, "ti", "tj"], "left") if labels is not None else some.withColumn("around", F.lit(None).cast("array<binary>"))
        return stage(rows.select(key, "ti", "tj", "z", "total", "around").mapInArrow(solve, schema))

    labels = run(tiles, None)
    news = labels.where("length(labels) > 0")
    while True:
        shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS])).alias("s")
        asked = news.select(key, "ti", "tj", shift).select(key, (F.col("ti") + F.col("s.a")).alias("ti"), (F.col("tj") + F.col("s.b")).alias("tj")).distinct()
        again = run(tiles.join(asked, [key, "ti", "tj"], "left_semi"), labels)
        before = labels.withColumnRenamed("labels", "old")
        changed = stage(again.join(before, [key, "ti", "tj"]).where("labels != old").select(key, "ti", "tj", "labels"))
        release(again)
        if changed.isEmpty():
            return labels
        merged = stage(labels.join(changed.select(key, "ti", "tj"), [key, "ti", "tj"], "left_anti").unionByName(changed))
        release(labels)
        labels, news = merged, changed


def _unpacked(kind: str, key: str, side: int, tiles: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(aoi_id, row, col, values) of tiles (aoi_id, ti, tj, z, total, here, around): `accumulation`, and `hand` if asked for."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for area, ti, tj, blob, total, here, around, threshold in zip(*(b.column(k).to_pylist() for k in range(8))):
                total = np.frombuffer(zlib.decompress(total), np.int64).reshape(side, side)
                if "hand" in values:
                    heights = _heights(blob, side)
                    hand = (heights - _solved(heights, total, threshold, ti, tj, side, around or [])[2])[1:-1, 1:-1]
                r, c = np.nonzero(np.unpackbits(np.frombuffer(zlib.decompress(here), np.uint8), count=side * side).reshape(side, side))
                for at in range(0, len(r), 65_536):
                    p, q = r[at : at + 65_536], c[at : at + 65_536]
                    found = [pa.array([area] * len(p), b.column(0).type), pa.array((p + ti * side).astype(np.int32)), pa.array((q + tj * side).astype(np.int32)), pa.array(total[p, q])]
                    if "hand" in values:
                        found.append(pa.array(hand[p, q], mask=np.isnan(hand[p, q])))
                    yield pa.RecordBatch.from_arrays(found, [key, "row", "col", *values])

    schema = f"{key} {kind}, row int, col int, accumulation long" + (", hand double" if "hand" in values else "")
    return tiles.select(key, "ti", "tj", "z", "total", "here", "around", "threshold").mapInArrow(unpack, schema)


def _tiles(cells: DataFrame, x_m: Column | float, y_m: Column | float, z: str, key: str, side: int) -> DataFrame:
    x_m, y_m = (F.lit(float(m)) if isinstance(m, (int, float)) else m for m in (x_m, y_m))
    tiles = stage(packed(cells, x_m, y_m, z, key, side))
    flowing = stage(_flowing(tiles, _inflow(tiles, key, side), key, side))
    release(tiles)
    return flowing


def accumulation(cells: DataFrame, x_m: Column | float, y_m: Column | float, z: str = "z", key: str = "aoi_id", side: int = SIDE) -> DataFrame:
    """cells' (aoi_id, row, col) with `accumulation`, the number of cells that drain through each, itself included."""
    tiles = _tiles(cells, x_m, y_m, z, key, side).withColumns({"around": F.lit(None).cast("array<binary>"), "threshold": F.lit(0)})
    return _unpacked(dict(cells.dtypes)[key], key, side, tiles, ("accumulation",))


def drainage(cells: DataFrame, threshold: int, x_m: Column | float, y_m: Column | float, z: str = "z", key: str = "aoi_id", side: int = SIDE) -> DataFrame:
    """cells' (aoi_id, row, col) with flow accumulation and hand, the height above the nearest drainage.

    Drainage is where the accumulation reaches the threshold; without any, hand is null, and so it is where missing
    cells bar the way. x_m and y_m are the sides of an area's cells: numbers, or columns of cells.
    """
    tiles = _tiles(cells, x_m, y_m, z, key, side)
    around = _around(_exchanged(tiles, threshold, key, side), key)
    tiles = tiles.join(around, [key, "ti", "tj"], "left").withColumn("threshold", F.lit(threshold))
    return _unpacked(dict(cells.dtypes)[key], key, side, tiles, ("accumulation", "hand"))

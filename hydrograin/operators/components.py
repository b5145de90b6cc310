"""Connected components of masks, and their outlines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import DEFAULT
from .tables import connected_components, stage

#: Steps to the neighbours that come later in row-major order.
_LATER = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, -1), (1, 0), (1, 1))}


#: Rows and columns of a tile that one task labels by itself, and rows whose components are numbered together.
SIDE, BAND = 512, 256


def local_roots(row: np.ndarray, col: np.ndarray, connectivity: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Number (row << 31 + col) of the first cell, in row-major order, of the component of each cell; cells may repeat.

    Only cells with the same `whole`, one for each cell, are neighbours.
    """
    number, first, at = np.unique(row.astype(np.int64) * (1 << 31) + col, return_index=True, return_inverse=True)
    pairs = []
    for dr, dc in _LATER[connectivity]:
        to = number + (dr * (1 << 31) + dc)
        place = np.minimum(np.searchsorted(number, to), len(number) - 1)
        hit = np.flatnonzero(number[place] == to)
        if whole is not None:
            hit = hit[whole[first[hit]] == whole[first[place[hit]]]]
        pairs.append((hit, place[hit]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    root = np.arange(len(number))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return number[root][at]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def label_components(mask: DataFrame, connectivity: int = 8, key: str = "aoi_id", side: int = SIDE, within: str | None = None) -> DataFrame:
    """mask's cells (aoi_id, row, col, ...) with `component`, numbered from 1 by first pixel in row-major order.

    A task labels one tile. Only cells on the borders of tiles meet their neighbours by a join, and only components
    that reach a border go through the star steps. Numbers count within bands of rows, and bands add up, so no area
    has to fit into one task. Cells may repeat; row and col must not be null. With `within`, a column of numbers, only
    cells that are equal in it are neighbours.
    """
    home = lambda c: F.floor(F.col(c) / side).cast("int")
    # Other columns travel in a struct: their names may be anything.
    at = mask.select(key, "row", "col", F.struct("*").alias("_all"), home("row").alias("_ti"), home("col").alias("_tj"), (F.col(within) if within else F.lit(0)).cast("long").alias("_whole"))

    def label(rows: pa.Table) -> pa.Table:
        whole = rows.column("_whole").to_numpy() if within else None
        found = local_roots(rows.column("row").to_numpy(), rows.column("col").to_numpy(), connectivity, whole)
        return rows.select([key, "row", "col", "_all", "_whole"]).append_column("_root", pa.array(found))

    cells = stage(at.groupBy(key, "_ti", "_tj").applyInArrow(label, StructType([*at.schema.fields[:4], at.schema["_whole"], StructField("_root", LongType())])))
    edge = lambda c: F.pmod(F.col(c), F.lit(side)).isin(0, side - 1)
    border = cells.where(edge("row") | edge("col")).select(key, "row", "col", "_root", "_whole")
    ahead = border.select("*", F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in _LATER[connectivity]])).alias("s"))
    away = ahead.select(key, "_whole", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.struct(F.col(key).alias("k"), F.col("_root").alias("n")).alias("a"))
    met = away.join(border.select(key, "_whole", "row", "col", F.struct(F.col(key).alias("k"), F.col("_root").alias("n")).alias("b")), [key, "_whole", "row", "col"])
    joined = connected_components(met.where("a != b").select("a", "b").distinct())
    joined = joined.select(F.col("node.k").alias(key), F.col("node.n").alias("_root"), F.col("component.n").alias("_first"))
    roots = cells.select(key, "_root").distinct().join(joined, [key, "_root"], "left").select(key, "_root", F.coalesce("_first", "_root").alias("_first"))
    roots = stage(roots.withColumn("_band", F.floor(F.shiftright("_first", 31) / BAND)))
    firsts = roots.where("_root = _first")
    before = firsts.groupBy(key, "_band").agg(F.count("*").alias("n")).select(key, "_band", (F.sum("n").over(W.partitionBy(key).orderBy("_band")) - F.col("n")).alias("_before"))
    number = firsts.select(key, "_band", "_first", F.row_number().over(W.partitionBy(key, "_band").orderBy("_first")).alias("_n")).join(before, [key, "_band"])
    number = number.select(key, "_first", (F.col("_n") + F.col("_before")).cast("int").alias("component"))
    numbered = roots.join(number, [key, "_first"]).select(key, "_root", "component")
    return cells.join(numbered, [key, "_root"]).select("_all.*", "component")


def large_components(labelled: DataFrame, least: int = DEFAULT.flood.min_component_size_px, key: str = "aoi_id") -> DataFrame:
    """Cells of components of at least `least` pixels, with pixel_count."""
    size = labelled.groupBy(key, "component").agg(F.count("*").alias("pixel_count")).where(F.col("pixel_count") >= least)
    return labelled.join(size, [key, "component"])


def outline(rows: np.ndarray, cols: np.ndarray) -> list[list[tuple[int, int]]]:
    """Rings of a 4-connected set of cells as corner points (col, row): the outer ring first, then holes.

    Every cell side without a cell behind it is an edge, with the cell on its right; edges are chained, turning
    right where two rings touch, and straight runs become one edge.
    """
    cells = set(zip(rows.tolist(), cols.tolist()))
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if (r + dr, c + dc) not in cells:
                edges.setdefault(a, []).append(b)
    rings = []
    while edges:
        start = min(edges)
        ring, at, heading = [start], start, None
        while True:
            ahead = edges[at]
            if len(ahead) > 1 and heading is not None:
                right = (at[0] - heading[1], at[1] + heading[0])
                to = right if right in ahead else ahead[0]
            else:
                to = ahead[0]
            ahead.remove(to)
            if not ahead:
                del edges[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step == heading:
                ring[-1] = to
            else:
                ring.append(to)
            at, heading = to, step
            if at == start:
                break
        rings.append(ring)
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    return sorted(rings, key=lambda ring: -abs(area(ring)))


def polygons(labelled: DataFrame, grid: DataFrame, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, component, part, pixel_count, geometry): a GeoJSON polygon per 4-connected part of each component.

    pixel_count is that of the whole component. Parts are numbered from 1 by first pixel within their component. A task
    traces many parts, one after the other, and holds one of them.
    """
    size = labelled.groupBy(key, "component").agg(F.count("*").alias("pixel_count"))
    split = stage(label_components(labelled.select(key, F.col("component").alias("_whole_of"), "row", "col"), 4, key, within="_whole_of").withColumnRenamed("component", "_part"))
    part = F.row_number().over(W.partitionBy(key, "_whole_of").orderBy("_part")).cast("int").alias("part")
    part = split.select(key, "_whole_of", "_part").distinct().select(key, "_whole_of", "_part", part)
    placed = split.join(part, [key, "_whole_of", "_part"]).join(grid.select(key, "origin_x", "origin_y", "px_w", "px_h"), key)
    placed = placed.select(key, F.col("_whole_of").alias("component"), "part", "row", "col", "origin_x", "origin_y", "px_w", "px_h")
    placed = placed.repartition(key, "component", "part").sortWithinPartitions(key, "component", "part")
    kind = dict(labelled.dtypes)[key]
    names = [key, "component", "part", "geometry"]

    def traced_one(rows: pa.Table) -> str:
        x0, y0, w, h = (rows.column(c)[0].as_py() for c in ("origin_x", "origin_y", "px_w", "px_h"))
        rings = [[[round(float(x0 + x * w), 9), round(float(y0 + y * h), 9)] for x, y in ring] for ring in outline(rows.column("row").to_numpy(), rows.column("col").to_numpy())]
        return json.dumps({"type": "Polygon", "coordinates": rings})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.Table]) -> pa.RecordBatch:
            first = pa.concat_tables([p.slice(0, 1) for p in parts])
            return pa.RecordBatch.from_arrays([*(first.column(c).combine_chunks() for c in names[:3]), pa.array([traced_one(p) for p in parts], pa.string())], names)

        open_: list[pa.Table] = []  # the pieces of the part that the next batch may go on with
        last = None
        for b in batches:
            t = pa.Table.from_batches([b])
            number = [t.column(c).combine_chunks() for c in ("component", "part")]
            cut = np.zeros(max(t.num_rows - 1, 0), bool)
            for c in (*number, t.column(key).combine_chunks()):
                v = c.to_numpy(zero_copy_only=False)
                cut |= v[1:] != v[:-1]
            starts = [0, *(np.flatnonzero(cut) + 1).tolist(), t.num_rows] if t.num_rows else []
            found = []
            for i, j in zip(starts, starts[1:]):
                own = tuple(t.column(c)[i].as_py() for c in names[:3])
                if open_ and own != last:
                    found.append(pa.concat_tables(open_))
                    open_ = []
                open_.append(t.slice(i, j - i))
                last = own
            if found:
                yield done(found)
        if open_:
            yield done([pa.concat_tables(open_)])

    traced = placed.mapInArrow(trace, f"{key} {kind}, component int, part int, geometry string")
    return traced.join(size, [key, "component"])

"""Geometry columns: WKB bytes to vertices and back, and predicates on vertices as Column expressions.

A decoded geometry is a struct of its kind and of its parts: an array of (part, ring, points), where a
point geometry has one part of one point, a line string one part per line, a polygon one entry per ring.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<kind:string,parts:array<struct<part:int,ring:int,points:array<{POINT}>>>>"
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def decode(raw: bytes | None) -> dict | None:
    """One geometry; None for null, empty, cut off or unknown bytes."""
    if not raw:
        return None
    parts: list[dict] = []

    def header(at: int) -> tuple[str, int, int, int]:
        order = "<" if raw[at] == 1 else ">"
        (code,) = struct.unpack_from(f"{order}I", raw, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}.get((code & 0xFFFF) // 1000, 0)
        return order, (code & 0xFFFF) % 1000, dims, at

    def points(order: str, dims: int, n: int, at: int) -> tuple[list[dict], int]:
        xy = np.frombuffer(raw, f"{order}f8", n * dims, at).reshape(n, dims)
        return [{"x": float(p[0]), "y": float(p[1])} for p in xy], at + 8 * n * dims

    def read(at: int, part: int) -> tuple[int, int]:
        order, kind, dims, at = header(at)
        if kind == 1:
            found, at = points(order, dims, 1, at)
            if found[0]["x"] == found[0]["x"]:
                parts.append({"part": part, "ring": 0, "points": found})
            return at, kind
        (n,) = struct.unpack_from(f"{order}I", raw, at)
        at += 4
        if kind == 2:
            found, at = points(order, dims, n, at)
            if n:
                parts.append({"part": part, "ring": 0, "points": found})
        elif kind == 3:
            for ring in range(n):
                (m,) = struct.unpack_from(f"{order}I", raw, at)
                found, at = points(order, dims, m, at + 4)
                parts.append({"part": part, "ring": ring, "points": found})
        elif kind in (4, 5, 6):
            for k in range(n):
                at, _ = read(at, k)
        else:
            raise ValueError(kind)
        return at, kind

    try:
        _, kind = read(0, 0)
    except (ValueError, struct.error, IndexError):
        return None
    return {"kind": KINDS[kind], "parts": parts} if parts else None


_XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PART = pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("points", pa.list_(_XY))])


def _u32(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Little-endian numbers at places of a buffer."""
    return data[at[:, None] + np.arange(4)].astype(np.int64) @ (1 << np.array([0, 8, 16, 24]))


def decode_batch(raw: pa.BinaryArray) -> pa.StructArray:
    """(kind, parts) of each geometry, see decode(). Plain points, lines and polygons of one ring are read from the batch's
    buffer at once; all others go one by one."""
    n = len(raw)
    offsets = np.frombuffer(raw.buffers()[1], np.int32 if pa.types.is_binary(raw.type) else np.int64)[raw.offset : raw.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    plain = ~raw.is_null().to_numpy(zero_copy_only=False) & (size >= 21)
    plain[plain] = data[start[plain]] == 1
    kind, count, first = np.zeros(n, np.int64), np.ones(n, np.int64), start + 5
    kind[plain] = _u32(data, start[plain] + 1)
    for code, skip in ((2, 9), (3, 13)):
        own = plain & (kind == code)
        if code == 3:
            own[own] = _u32(data, start[own] + 5) == 1
        count[own], first[own] = _u32(data, start[own] + skip - 4), start[own] + skip
        plain &= own | (kind != code)
    plain &= (kind >= 1) & (kind <= 3) & (count >= 1) & (size == first - start + 16 * count)
    at = np.flatnonzero(plain)
    n_points = count[at]
    point_of = np.repeat(first[at], n_points) + 16 * (np.arange(n_points.sum()) - np.repeat(np.cumsum(n_points) - n_points, n_points))
    xy = data[point_of[:, None] + np.arange(16)].view("<f8").reshape(-1, 2)
    hollow = at[kind[at] == 1]
    hollow = hollow[np.isnan(xy[(np.cumsum(n_points) - n_points)[kind[at] == 1], 0])]  # an empty point
    names: list[str | None] = [None] * n
    for i, k in zip(at.tolist(), kind[at].tolist()):
        names[i] = KINDS[k]
    # Parts of all rows, in order: (row, part, ring, number of points, first point among xy and then others).
    rows, part, ring, sizes, begin, more = [at], [np.zeros(len(at), int)], [np.zeros(len(at), int)], [n_points], [np.cumsum(n_points) - n_points], [xy]
    used = len(xy)
    for i in np.flatnonzero(~plain).tolist():
        if (g := decode(raw[i].as_py())) is not None:
            names[i] = g["kind"]
            for p in g["parts"]:
                m = len(p["points"])
                for to, value in ((rows, i), (part, p["part"]), (ring, p["ring"]), (sizes, m), (begin, used)):
                    to.append(np.array([value]))
                more.append(np.array([(q["x"], q["y"]) for q in p["points"]], float).reshape(-1, 2))
                used += m
    rows, part, ring, sizes, begin = (np.concatenate(x).astype(np.int64) for x in (rows, part, ring, sizes, begin))
    if len(hollow):
        keep = ~np.isin(rows, hollow)
        rows, part, ring, sizes, begin = rows[keep], part[keep], ring[keep], sizes[keep], begin[keep]
        for i in hollow.tolist():
            names[i] = None
    order = np.argsort(rows, kind="stable")
    sizes, every = sizes[order], np.concatenate(more)
    every = every[np.repeat(begin[order], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, k])) for k in (0, 1)], fields=list(_XY))
    upto = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
    lists = pa.ListArray.from_arrays(upto(sizes), points, type=pa.list_(_XY))
    parts = pa.StructArray.from_arrays([pa.array(part[order], pa.int32()), pa.array(ring[order], pa.int32()), lists], fields=list(_PART))
    none = pa.array([x is None for x in names], pa.bool_())
    whole = pa.ListArray.from_arrays(upto(np.bincount(rows, minlength=n)), parts, type=pa.list_(_PART), mask=none)
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), whole], names=["kind", "parts"])


def from_wkb(raw: Column) -> Column:
    """GEOMETRY of WKB bytes, in Arrow batches; both fields are null for what can't be read."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield decode_batch(b)

    return F.arrow_udf(of, GEOMETRY)(raw)


def encode(kind: str, coordinates: list) -> bytes:
    """WKB of Point [x, y], LineString [[x, y]...], Polygon [ring...] or the Multi kinds of these."""
    code = {v: k for k, v in KINDS.items()}[kind]
    head = struct.pack("<BI", 1, code)
    line = lambda p: struct.pack("<I", len(p)) + b"".join(struct.pack("<2d", *q) for q in p)
    if kind == "Point":
        return head + struct.pack("<2d", *coordinates)
    if kind == "LineString":
        return head + line(coordinates)
    if kind == "Polygon":
        return head + struct.pack("<I", len(coordinates)) + b"".join(map(line, coordinates))
    return head + struct.pack("<I", len(coordinates)) + b"".join(encode(kind.removeprefix("Multi"), c) for c in coordinates)


def sides(parts: Column) -> Column:
    """All sides of the rings or lines as (x1, y1, x2, y2)."""
    one = lambda p: F.zip_with(
        F.slice(p["points"], 1, F.greatest(F.size(p["points"]) - 1, F.lit(0))), F.slice(p["points"], 2, F.greatest(F.size(p["points"]) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    return F.flatten(F.transform(parts, one))


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside rings: an odd number of sides to its right. Holes and several parts are one rule."""

    def crosses(e: Column) -> Column:
        astride = (e["y1"] > y) != (e["y2"] > y)
        return F.when(astride, x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])).otherwise(F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def distance_squared(edges: Column, x: Column, y: Column, way=None) -> Column:
    """Square of the distance from a point to the nearest side; null without sides.

    way(side) gives its extent (dx, dy) where that is known better than by the difference of its ends.
    """

    def one(e: Column) -> Column:
        dx, dy = way(e) if way else (e["x2"] - e["x1"], e["y2"] - e["y1"])
        t = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.pow(x - e["x1"] - t * dx, F.lit(2)) + F.pow(y - e["y1"] - t * dy, F.lit(2))

    return F.array_min(F.transform(edges, one))


def bounds(parts: Column) -> Column:
    """(min_x, min_y, max_x, max_y) of all points."""
    flat = lambda c: F.flatten(F.transform(parts, lambda p: F.transform(p["points"], lambda q: q[c])))
    return F.struct(F.array_min(flat("x")).alias("min_x"), F.array_min(flat("y")).alias("min_y"), F.array_max(flat("x")).alias("max_x"), F.array_max(flat("y")).alias("max_y"))


def sides_of(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, sides): all sides (x1, y1, x2, y2) of the rings or lines of a batch of geometries, with the row of each."""
    first = parts.offsets.to_numpy()
    points = parts.values.field("points")
    bounds = points.offsets.to_numpy()
    xy = np.stack([points.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    ring = np.arange(first[0], first[-1])
    sizes = np.maximum(bounds[ring + 1] - bounds[ring] - 1, 0)
    start = np.repeat(bounds[ring], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(np.repeat(np.arange(len(parts)), np.diff(first)), sizes)
    return owner, np.hstack([xy[start], xy[start + 1]])


def pairs(*group: np.ndarray) -> np.ndarray:
    """Places 0, 2, 4, ... of each run of equal groups that have a next one in their run."""
    same = np.ones(max(0, len(group[0]) - 1), bool)
    for g in group:
        same &= g[1:] == g[:-1]
    fresh = np.append(True, ~same)[: len(group[0])]
    place = np.arange(len(fresh)) - np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    return np.flatnonzero((place[:-1] % 2 == 0) & same) if len(fresh) else np.zeros(0, np.int64)


def points_on(kind: pa.StringArray, parts: pa.ListArray) -> pa.StructArray:
    """(x, y) on each geometry of a batch, see representative_point()."""
    n, known = len(parts), parts.is_valid().to_numpy(zero_copy_only=False)
    first = parts.offsets.to_numpy().astype(np.int64)
    points = parts.values.field("points")
    bounds = points.offsets.to_numpy().astype(np.int64)
    xy = np.stack([points.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    at = np.full((n, 2), np.nan)
    some = known & (np.diff(first) > 0)
    some[some] = bounds[first[:-1][some] + 1] > bounds[first[:-1][some]]
    own = first[:-1][some]
    at[some] = xy[bounds[own] + (bounds[own + 1] - bounds[own]) // 2]
    area = some & np.array([k in ("Polygon", "MultiPolygon") for k in kind.to_pylist()], bool)
    owner, sides = sides_of(parts)
    x1, y1, x2, y2 = sides[area[owner]].T
    owner = owner[area[owner]]
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    for y in (y1, y2):
        np.minimum.at(low, owner, y)
        np.maximum.at(high, owner, y)
    level = ((low + high) / 2)[owner]
    cuts = (y1 > level) != (y2 > level)
    x = x1[cuts] + (level[cuts] - y1[cuts]) * (x2[cuts] - x1[cuts]) / (y2[cuts] - y1[cuts])
    of = owner[cuts]
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    a = pairs(of)
    wide, middle, of = x[a + 1] - x[a], (x[a + 1] + x[a]) / 2, of[a]
    order = np.lexsort((middle, wide, of))
    last = order[np.append(of[order][1:] != of[order][:-1], True)] if len(order) else order
    at[of[last], 0], at[of[last], 1] = middle[last], ((low + high) / 2)[of[last]]
    return pa.StructArray.from_arrays([pa.array(at[:, k], mask=~some) for k in (0, 1)], names=["x", "y"])


def representative_point(kind: Column, parts: Column) -> Column:
    """(x, y) on the geometry: a point itself, the middle vertex of a line, the middle of a polygon's widest run at half height.

    Both are null without a vertex.
    """

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for k, p in batches:
            yield points_on(k, p)

    return F.arrow_udf(of, POINT)(kind, parts)

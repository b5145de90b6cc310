"""GeoTIFF files as cell tables: read as binary files, decoded in Arrow batches, one row per cell."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
_TYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def is_tiff(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4).isin(F.unhex(F.lit("49492A00")), F.unhex(F.lit("4D4D002A"))), F.lit(False))


def tags(raw: bytes, more: Callable[[int, int], bytes] | None = None) -> tuple[str, dict[int, tuple]]:
    """(byte order, values of each tag). more(start, size) gives what lies beyond raw, where raw is only a file's beginning."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if order is None:
        raise ValueError("not a TIFF file")

    def at(start: int, size: int) -> bytes:
        return raw[start : start + size] if start + size <= len(raw) or more is None else more(start, size)

    (start,) = struct.unpack_from(f"{order}I", raw, 4)
    (n,) = struct.unpack(f"{order}H", at(start, 2))
    entries, found = at(start + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", entries, 12 * k)
        if kind not in _CODES:
            continue
        size = _SIZES[kind] * count
        value = entries[12 * k + 8 : 12 * k + 12]
        value = value[:size] if size <= 4 else at(*struct.unpack(f"{order}I", value), size)
        found[tag] = (value,) if kind == 2 else struct.unpack(f"{order}{count}{_CODES[kind]}", value)
    return order, found


@dataclass(frozen=True)
class Layout:
    """How a file holds its pixels: the sizes of the raster and of a block, the kind of a pixel, and where each block lies."""

    height: int
    width: int
    bands: int
    block_height: int
    block_width: int
    tiled: bool
    planar: int
    kind: str
    packed: int
    predictor: int
    starts: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def per_plane(self) -> int:
        return self.across * -(-self.height // self.block_height)

    def corner(self, k: int) -> tuple[int, int]:
        """(row, col) of the first pixel of block k."""
        k %= self.per_plane
        return k // self.across * self.block_height, k % self.across * self.block_width

    def touching(self, row0: int, row1: int, col0: int, col1: int) -> list[int]:
        """Blocks of the first plane that hold a pixel of the window, ends exclusive."""
        return [r * self.across + c for r in range(row0 // self.block_height, -(-row1 // self.block_height)) for c in range(col0 // self.block_width, -(-col1 // self.block_width))]

    def unpack(self, k: int, block: bytes) -> np.ndarray:
        """Pixels (row, col, band of the plane) of block k, cut to the raster."""
        y, x = self.corner(k)
        kind, deep = np.dtype(self.kind), self.bands if self.planar == 1 else 1
        rows = self.block_height if self.tiled else min(self.block_height, self.height - y)
        block = zlib.decompress(block) if self.packed != 1 else block
        if self.predictor == 3:
            # Bytes of a row are differences, most significant bytes of all its pixels first.
            octets = np.cumsum(np.frombuffer(block, "u1", rows * self.block_width * deep * kind.itemsize).reshape(rows, -1), axis=1, dtype="u1")
            a = np.ascontiguousarray(octets.reshape(rows, kind.itemsize, -1).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, self.block_width, deep)
        else:
            a = np.frombuffer(block, kind, rows * self.block_width * deep).reshape(rows, self.block_width, deep)
            if self.predictor == 2:
                a = np.cumsum(a, axis=1, dtype=a.dtype)
        return a[: self.height - y, : self.width - x]


def layout(order: str, t: dict[int, tuple]) -> Layout:
    width, height = t[256][0], t[257][0]
    packed, predictor = t.get(259, (1,))[0], t.get(317, (1,))[0]
    if packed not in (1, 8, 32946) or predictor not in (1, 2, 3):
        raise ValueError(f"compression {packed} with predictor {predictor} is not supported")
    tiled = 322 in t
    bw, bh = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, (height,))[0], height))
    starts, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    return Layout(height, width, t.get(277, (1,))[0], bh, bw, tiled, t.get(284, (1,))[0], order + _TYPES[t.get(339, (1,))[0], t.get(258, (8,))[0]], packed, predictor, tuple(starts), tuple(sizes))


def decode(raw: bytes) -> tuple[np.ndarray, dict]:
    """(bands x height x width, grid) of an uncompressed or deflated file in strips or tiles.

    grid: height, width, origin_x, origin_y, px_w, px_h and crs, of a north-up file.
    """
    order, t = tags(raw)
    own = layout(order, t)
    height, width = own.height, own.width
    out = np.zeros((own.bands, height, width), dtype=np.dtype(own.kind).newbyteorder("="))
    for k, (at, size) in enumerate(zip(own.starts, own.sizes)):
        a, (y, x) = own.unpack(k, raw[at : at + size]), own.corner(k)
        for b in range(a.shape[2]):
            out[k // own.per_plane + b if own.planar != 1 else b, y : y + a.shape[0], x : x + a.shape[1]] = a[..., b]
    scale, tie = t.get(33550, (1.0, 1.0, 0.0)), t.get(33922, (0.0,) * 6)
    keys = t.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    epsg = codes.get(3072) or codes.get(2048)
    grid = {"height": height, "width": width, "origin_x": tie[3] - tie[0] * scale[0], "origin_y": tie[4] + tie[1] * scale[1], "px_w": scale[0], "px_h": -scale[1], "crs": f"EPSG:{epsg}" if epsg else None}
    return out, grid


def packed_strip(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"))).tobytes())


def encode(bands: np.ndarray, origin: tuple[float, float], pixel: tuple[float, float], epsg: int = 4326, nodata: float | None = None) -> bytes:
    """A north-up, deflated GeoTIFF of bands x height x width in one strip per band."""
    n, height, width = bands.shape
    strips = [packed_strip(b) for b in bands]
    head = header(bands.dtype.str, n, height, width, height, [len(s) for s in strips], origin, pixel, epsg, nodata)
    return head + b"".join(strips)


def header(dtype: str, n: int, height: int, width: int, rows: int, sizes: list[int], origin: tuple[float, float], pixel: tuple[float, float], epsg: int = 4326, nodata: float | None = None) -> bytes:
    """What stands before the deflated strips, of `rows` rows each and the given sizes, of a file of n bands one after the other."""
    own = np.dtype(dtype)
    kind = {"u": 1, "i": 2, "f": 3}[own.kind]
    shift = [0, *itertools.accumulate(sizes)][: len(sizes)]
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [own.itemsize * 8] * n), (259, 3, [8]), (262, 3, [1]), (273, 4, shift), (277, 3, [n]), (278, 4, [rows]), (279, 4, sizes), (284, 3, [2]), (339, 3, [kind] * n), (33550, 12, [pixel[0], pixel[1], 0.0]), (33922, 12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0]), (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg])]
    if nodata is not None:
        entries.append((42113, 2, list(f"{nodata:g}\0".encode())))
    fields, extra = [], b""
    after = 8 + 2 + 12 * len(entries) + 4
    for tag, code, values in entries:
        body = bytes(values) if code == 2 else struct.pack(f"<{len(values)}{_CODES[code]}", *values)
        fields.append((tag, code, len(values), None if len(body) <= 4 else after + len(extra), body))
        extra += b"" if len(body) <= 4 else body + b"\0" * (len(body) % 2)
    first = after + len(extra)
    if first + sum(sizes) >= 1 << 32:
        raise ValueError("a file of 4 GB or more is no TIFF")
    place = struct.pack(f"<{len(shift)}I", *[first + x for x in shift])
    out = b""
    for tag, code, count, where, body in fields:
        body = place if tag == 273 else body
        out += struct.pack("<HHI", tag, code, count) + (body.ljust(4, b"\0") if where is None else struct.pack("<I", where))
        if tag == 273 and where is not None:
            extra = extra[: where - after] + place + extra[where - after + len(place) :]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + out + b"\0\0\0\0" + extra


def radar_bands(a: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(bands, data mask) of a decoded clip; without a mask band every pixel counts.

    Accepts one plane, bands first or bands last; of three bands or more the last is the mask.
    """
    a = np.asarray(a)
    if a.ndim == 2:
        a = a[None]
    elif a.shape[-1] <= 4 < a.shape[0]:
        a = np.moveaxis(a, -1, 0)
    if len(a) >= 3:
        return list(a[:-1]), a[-1]
    return list(a), np.ones(a.shape[1:], dtype=np.uint8)


def cells(files: DataFrame, names: tuple[str, ...] = ("vv", "vh")) -> DataFrame:
    """(path, row, col, names..., mask) of clips (path, content); NaN and infinite values are null. A clip is one task's work."""
    schema = "path string, row int, col int, " + ", ".join(f"{n} float" for n in names) + ", mask double"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bands, mask = radar_bands(decode(raw)[0])
                if len(bands) < len(names):
                    raise ValueError(f"{path}: {len(bands)} bands, expected {len(names)}")
                h, w = mask.shape
                step = max(1, 200_000 // w)
                for y in range(0, h, step):
                    r, c = np.mgrid[y : min(y + step, h), 0:w]
                    values = [np.asarray(x[y : y + step], dtype=np.float32).ravel() for x in bands[: len(names)]]
                    arrays = [pa.array(v, mask=~np.isfinite(v)) for v in values]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * r.size), pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), *arrays, pa.array(mask[y : y + step].ravel().astype(np.float64))], ["path", "row", "col", *names, "mask"])

    return files.select("path", "content").mapInArrow(of, schema)


def grids(files: DataFrame) -> DataFrame:
    """(path, height, width, origin_x, origin_y, px_w, px_h, crs, min_lon, min_lat, max_lon, max_lat) of each file; bounds to nine decimals."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, **decode(raw)[1]} for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), *[(n, pa.float64()) for n in ("origin_x", "origin_y", "px_w", "px_h")], ("crs", pa.string())]))

    found = files.select("path", "content").mapInArrow(of, "path string, height int, width int, origin_x double, origin_y double, px_w double, px_h double, crs string")
    edge = lambda c: F.round(c, 9)
    return found.withColumns({"min_lon": edge(F.col("origin_x")), "max_lat": edge(F.col("origin_y")), "max_lon": edge(F.col("origin_x") + F.col("width") * F.col("px_w")), "min_lat": edge(F.col("origin_y") + F.col("height") * F.col("px_h"))})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files (path, content) that are TIFF."""
    return spark.read.format("binaryFile").load(path).where(is_tiff(F.col("content")))

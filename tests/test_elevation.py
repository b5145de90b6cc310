"""Elevation by byte ranges: only touched blocks are asked for, and the cells are those of whole tiles."""

import math
import os
import zlib

import numpy as np
import pytest

from hydrograin.errors import FloodError
from hydrograin.sources import dem, elevation, tiff

SIDE, BLOCK = 64, 16


def tiled(a, predictor):
    """A file of 16 x 16 tiles, as elevation services lay them out."""
    blocks = []
    for y in range(0, SIDE, BLOCK):
        for x in range(0, SIDE, BLOCK):
            b = a[y : y + BLOCK, x : x + BLOCK]
            if predictor == 3:
                octets = np.ascontiguousarray(b.astype(">f4")).view("u1").reshape(BLOCK, BLOCK, 4).transpose(0, 2, 1).reshape(BLOCK, -1)
                b = np.diff(octets, axis=1, prepend=np.zeros((BLOCK, 1), "u1"))
                blocks.append(zlib.compress(b.astype("u1").tobytes()))
            else:
                blocks.append(zlib.compress(b.astype("<f4").tobytes()))
    strips = tiff.header("<f4", 1, SIDE, SIDE, BLOCK, [1] * 4, (0.0, 0.0), (1 / SIDE, 1 / SIDE))
    import struct

    entries = [(256, 4, [SIDE]), (257, 4, [SIDE]), (258, 3, [32]), (259, 3, [8]), (277, 3, [1]), (317, 3, [predictor]), (322, 3, [BLOCK]), (323, 3, [BLOCK]), (324, 4, [0] * len(blocks)), (325, 4, [len(b) for b in blocks]), (339, 3, [3])]
    assert len(strips) > 8
    at = 20_000  # block offsets lie behind the first request, as in large files
    first = at + 8 * len(blocks)
    entries[8] = (324, 4, [first + sum(map(len, blocks[:k])) for k in range(len(blocks))])
    out, far = struct.pack("<H", len(entries)), {324: at, 325: at + 4 * len(blocks)}
    for tag, code, values in entries:
        body = struct.pack(f"<{len(values)}{'H' if code == 3 else 'I'}", *values)
        out += struct.pack("<HHI", tag, code, len(values)) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", far[tag]))
    raw = b"II*\0" + struct.pack("<I", 8) + out + b"\0\0\0\0"
    raw = raw.ljust(at, b"\0") + struct.pack(f"<{len(blocks)}I", *entries[8][2]) + struct.pack(f"<{len(blocks)}I", *entries[9][2])
    return raw + b"".join(blocks), entries[8][2]


@pytest.fixture
def store(tmp_path):
    """A folder of four tiles around 28 N 86 E, their arrays and block offsets."""
    rng, arrays, starts = np.random.default_rng(3), {}, {}
    for south in (27, 28):
        for west in (85, 86):
            a = rng.normal(500, 90, (SIDE, SIDE)).astype("f4")
            a[3, 5] = np.nan
            name = elevation.tile_name(south, west)
            (tmp_path / name).mkdir()
            raw, starts[name] = tiled(a, 3 if west == 85 else 1)
            (tmp_path / name / f"{name}.tif").write_bytes(raw)
            arrays[south, west] = a
    return tmp_path, arrays, starts


def counting(log):
    def ranges(url, at, size):
        with open(log, "a") as f:
            f.write(f"{url.rpartition('/')[2]} {at} {size}\n")
        return elevation.read_range(url, at, size)

    return ranges


def test_cells_and_requests(spark, store):
    folder, arrays, starts = store
    log = folder / "asked.txt"
    boxes = [("a", (85.80, 27.90, 86.10, 28.20)), ("b", (85.30, 27.30, 85.40, 27.35)), ("c", (85.0, 28.0, 85.25, 28.25))]
    got = elevation.elevation(spark, boxes, f"file://{folder}", SIDE, counting(log)).collect()
    for aoi, (west, south, east, north) in boxes:
        top, left = math.floor((90 - north) * SIDE + 1e-6), math.floor((west + 180) * SIDE + 1e-6)
        bottom, right = math.ceil((90 - south) * SIDE - 1e-6), math.ceil((east + 180) * SIDE - 1e-6)
        own = {(r.row, r.col): r.z for r in got if r.aoi_id == aoi}
        assert len(own) == (bottom - top) * (right - left) == sum(r.aoi_id == aoi for r in got)
        for (r, c), z in own.items():
            y, x = top + r, left + c
            whole = arrays[89 - y // SIDE, x // SIDE - 180][y % SIDE, x % SIDE]
            assert (z is None and np.isnan(whole)) or z == whole
    g = dem.window_grid(spark.createDataFrame([(a, *b) for a, b in boxes], "aoi_id string, min_lon double, min_lat double, max_lon double, max_lat double"), SIDE).collect()
    assert {r.aoi_id: r.height * r.width for r in g} == {a: sum(r.aoi_id == a for r in got) for a, _ in boxes}
    asked = {(line.split()[0], int(line.split()[1])) for line in log.read_text().splitlines()}
    touched = set()
    for _, box in boxes:
        for w in elevation.windows("x", box, SIDE):
            name = elevation.tile_name(w.south, w.west)
            touched |= {(f"{name}.tif", starts[name][r // BLOCK * 4 + c // BLOCK]) for r in range(*w.rows) for c in range(*w.cols)}
    blocks = {(f"{n}.tif", s) for n, all_ in starts.items() for s in all_}
    assert asked & blocks == touched and len(touched) < len(blocks) / 2


def test_more_blocks_than_partitions(spark, store):
    folder, arrays, _ = store
    spark.dataSource.register(elevation.source())
    box = '[{"aoi_id": "a", "bbox": [85, 27, 87, 29]}]'
    df = spark.read.format("elevation").options(boxes=box, base=f"file://{folder}", pixels=str(SIDE), partitions="5").load()
    assert df.rdd.getNumPartitions() <= 8 and df.count() == 4 * SIDE * SIDE


def test_whole_tiles(spark, store, tmp_path):
    folder, _, _ = store
    boxes = spark.createDataFrame([("a", 85.8, 27.9, 86.1, 28.2), ("b", 85.1, 27.1, 85.2, 27.2)], "aoi_id string, min_lon double, min_lat double, max_lon double, max_lat double")
    into = f"file://{tmp_path}/copies"
    first = elevation.fetch_tiles(boxes, into, f"file://{folder}").collect()
    assert len(first) == 4 and not any(r.from_cache for r in first) and all(os.path.getsize(r.path[7:]) == r.bytes for r in first)
    assert all(r.from_cache for r in elevation.fetch_tiles(boxes, into, f"file://{folder}").collect())
    for name in os.listdir(folder):
        if name.endswith("DEM"):
            (folder / name / f"{name}.tif").write_bytes(b"<html>")
    with pytest.raises(Exception, match="no TIFF file|CDSE_UNAVAILABLE"):
        elevation.fetch_tiles(boxes, f"file://{tmp_path}/other", f"file://{folder}").collect()


def test_failures(spark, store):
    folder, _, _ = store

    def broken(url, at, size):
        raise elevation.ServiceError(404, "gone", False)

    with pytest.raises(FloodError):
        elevation._Reader(broken, {"boxes": '[{"aoi_id": "a", "bbox": [85, 27, 86, 28]}]', "pixels": "64"}).partitions()
    with pytest.raises(FloodError):
        elevation._Reader(elevation.read_range, {"boxes": '[{"aoi_id": "a", "bbox": [85, 27, 86, 28]}]', "pixels": "65", "base": f"file://{folder}"}).partitions()

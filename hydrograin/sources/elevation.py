"""Elevation tiles read by byte ranges: a data source whose partitions are the blocks that the boxes touch.

Planning reads the directory of each touched tile, a small request, and makes a partition of every block with a pixel
in some box; tasks then ask for those blocks alone. Whole tiles can also be copied to the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import DEFAULT
from ..errors import FloodError
from ..functions import geo
from ..operators.tables import filesystem
from . import tiff
from .connectors import ServiceError, retried

#: (url, first byte, number of bytes or None for all that follow) -> content.
Ranges = Callable[[str, int, int | None], bytes]

BASE = "https://copernicus-dem-30m.s3.amazonaws.com"
#: Bytes of a tile's beginning that planning asks for, directories in parallel, partitions at most; beyond it one reads several blocks.
HEAD, PLANNED_AT_ONCE, MOST_PARTITIONS = 16_384, 16, 20_000
#: In pixels: edges of boxes are taken as whole where binary fractions miss them by less.
EDGE = 1e-6


def read_range(url: str, at: int, size: int | None) -> bytes:
    """A byte range by HTTP, or from any file system that Arrow knows."""
    if not url.startswith(("http:", "https:")):
        fs, path = filesystem(url)
        with fs.open_input_file(path) as f:
            f.seek(at)
            return f.read(size)
    request = urllib.request.Request(url, headers={"Range": f"bytes={at}-{'' if size is None else at + size - 1}"})
    try:
        with urllib.request.urlopen(request, timeout=DEFAULT.fetch.timeout_seconds) as r:
            content = r.read()
            return content if r.status == 206 else content[at:][:size]
    except urllib.error.HTTPError as e:
        raise ServiceError(e.code, str(e), e.code == 429 or e.code >= 500) from e
    except OSError as e:
        raise ServiceError(0, str(e), True) from e


def _asked(ranges: Ranges, url: str, at: int, size: int | None) -> bytes:
    return retried(lambda: ranges(url, at, size), "CDSE_UNAVAILABLE", DEFAULT.fetch.retries, factor=DEFAULT.fetch.backoff_factor)


@dataclass(frozen=True)
class Window:
    """A box's pixels in one tile, ends exclusive, and what takes them to the box's own rows and columns."""

    aoi_id: str
    south: int
    west: int
    rows: tuple[int, int]
    cols: tuple[int, int]
    shift: tuple[int, int]


def tile_name(south: int, west: int) -> str:
    return f"Copernicus_DSM_COG_10_{'N' if south >= 0 else 'S'}{abs(south):02d}_00_{'E' if west >= 0 else 'W'}{abs(west):03d}_00_DEM"


def windows(aoi_id: str, box: tuple[float, float, float, float], pixels: int) -> list[Window]:
    """The parts of a box (west, south, east, north) in the one-degree tiles that it touches."""
    west, south, east, north = box
    top, left = math.floor((90 - north) * pixels + EDGE), math.floor((west + 180) * pixels + EDGE)
    bottom, right = math.ceil((90 - south) * pixels - EDGE), math.ceil((east + 180) * pixels - EDGE)
    found = []
    for row in range(top // pixels, -(-bottom // pixels)):
        for col in range(left // pixels, -(-right // pixels)):
            y, x = row * pixels, col * pixels
            rows, cols = (max(top - y, 0), min(bottom - y, pixels)), (max(left - x, 0), min(right - x, pixels))
            found.append(Window(aoi_id, 89 - row, col - 180, rows, cols, (y - top, x - left)))
    return found


@dataclass
class Blocks(InputPartition):
    """Blocks of one tile: (number, first byte, size) of each, and the windows of boxes in the tile."""

    url: str
    layout: tiff.Layout
    blocks: list[tuple[int, int, int]]
    windows: list[Window]

    def __init__(self, url: str, layout: tiff.Layout, blocks: list[tuple[int, int, int]], windows: list[Window]):
        self.value, self.url, self.layout, self.blocks, self.windows = None, url, layout, blocks, windows


class _Reader(DataSourceReader):
    def __init__(self, ranges: Ranges, options: dict):
        self.ranges = ranges
        self.pixels, self.base = int(options.get("pixels", 3600)), options.get("base", BASE)
        self.boxes = [(str(b["aoi_id"]), tuple(map(float, b["bbox"]))) for b in json.loads(options["boxes"])]
        self.most = int(options.get("partitions", MOST_PARTITIONS))

    def partitions(self) -> list[InputPartition]:
        by_tile: dict[tuple[int, int], list[Window]] = {}
        for aoi_id, box in self.boxes:
            for w in windows(aoi_id, box, self.pixels):
                by_tile.setdefault((w.south, w.west), []).append(w)

        def plan(tile: tuple[int, int]) -> list[Blocks]:
            url = f"{self.base}/{tile_name(*tile)}/{tile_name(*tile)}.tif"
            raw = _asked(self.ranges, url, 0, HEAD)
            own = tiff.layout(*tiff.tags(raw, lambda at, size: _asked(self.ranges, url, at, size)))
            if (own.height, own.width) != (self.pixels, self.pixels):
                raise FloodError("CDSE_UNAVAILABLE", details=f"{url}: {own.height} x {own.width} pixels, expected {self.pixels}")
            touched = sorted({k for w in by_tile[tile] for k in own.touching(*w.rows, *w.cols)})
            # A task needs to know of its own block alone where it lies.
            bare = tiff.Layout(**{**own.__dict__, "starts": (), "sizes": ()})
            return [Blocks(url, bare, [(k, own.starts[k], own.sizes[k])], by_tile[tile]) for k in touched]

        with ThreadPoolExecutor(PLANNED_AT_ONCE) as pool:
            found = [b for blocks in pool.map(plan, sorted(by_tile)) for b in blocks]
        together = -(-len(found) // self.most)
        if together > 1:
            merged: dict[tuple, Blocks] = {}
            for n, b in enumerate(found):
                merged.setdefault((b.url, n // together), Blocks(b.url, b.layout, [], b.windows)).blocks.extend(b.blocks)
            found = list(merged.values())
        return found

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        own = partition.layout
        for k, at, size in partition.blocks:
            a, (y, x) = own.unpack(k, _asked(self.ranges, partition.url, at, size))[..., 0], own.corner(k)
            for w in partition.windows:
                r0, r1 = max(w.rows[0], y), min(w.rows[1], y + a.shape[0])
                c0, c1 = max(w.cols[0], x), min(w.cols[1], x + a.shape[1])
                if r0 < r1 and c0 < c1:
                    z = a[r0 - y : r1 - y, c0 - x : c1 - x].astype(np.float32).ravel()
                    row, col = np.mgrid[r0 + w.shift[0] : r1 + w.shift[0], c0 + w.shift[1] : c1 + w.shift[1]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([w.aoi_id] * len(z)), pa.array(row.ravel()), pa.array(col.ravel()), pa.array(z, mask=~np.isfinite(z))], ["aoi_id", "row", "col", "z"])


def source(ranges: Ranges = read_range) -> type[DataSource]:
    """The data source `elevation`, which reads through the given function.

    Options: boxes (JSON list of {aoi_id, bbox}), base (where tiles lie), pixels (a side of a tile), partitions (at most).
    """

    class Elevation(DataSource):
        @classmethod
        def name(cls) -> str:
            return "elevation"

        def schema(self) -> str:
            return "aoi_id string, row int, col int, z float"

        def reader(self, schema: object) -> DataSourceReader:
            return _Reader(ranges, dict(self.options))

    return Elevation


def elevation(spark: SparkSession, boxes: list[tuple[str, tuple[float, float, float, float]]], base: str = BASE, pixels: int = 3600, ranges: Ranges = read_range) -> DataFrame:
    """(aoi_id, row, col, z) of each box (aoi_id, (west, south, east, north)), rows and columns as in dem.window_grid(); z is null where unknown."""
    spark.dataSource.register(source(ranges))
    asked = json.dumps([{"aoi_id": a, "bbox": list(b)} for a, b in boxes])
    return spark.read.format("elevation").option("boxes", asked).option("base", base).option("pixels", pixels).load()


def fetch_tiles(boxes: DataFrame, folder: str, base: str = BASE, ranges: Ranges = read_range) -> DataFrame:
    """(tile_id, url, path, bytes, from_cache): every tile that a box touches, copied whole into a folder that all tasks reach.

    A file has its name from the tile and appears complete or not at all; one that is there is not asked for again.
    FloodError if what comes is no TIFF file.
    """
    tiles = geo.dem_tiles(boxes).select("tile_id").distinct().withColumn("url", geo.dem_tile_url(F.col("tile_id"), base))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, top = filesystem(folder)
        fs.create_dir(top)
        for b in batches:
            for tile, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{top}/{hashlib.sha256(tile.encode()).hexdigest()[:24]}.tif"
                info = fs.get_file_info(path)
                there = info.type == FileType.File and info.size > 0
                if not there:
                    content = _asked(ranges, url, 0, None)
                    if content[:4] not in (b"II*\0", b"MM\0*"):
                        raise FloodError("CDSE_UNAVAILABLE", details=f"{tile} is no TIFF file")
                    part = f"{path}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as f:
                        f.write(content)
                    fs.move(part, path)
                    info = fs.get_file_info(path)
                name = f"{folder}/{path.rpartition('/')[2]}"
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (tile, url, name, info.size, there)], ["tile_id", "url", "path", "bytes", "from_cache"])

    return tiles.repartition("tile_id").mapInArrow(fetch, "tile_id string, url string, path string, bytes long, from_cache boolean")

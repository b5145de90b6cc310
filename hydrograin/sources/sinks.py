"""Outputs: GeoJSON features and collections, CSV, cells, and the files of each stage."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import filesystem, stage
from . import tiff

#: The properties of each layer's features, in the order of the output.
COMMON = ("osm_id", "osm_type", "status", "confidence", "flooded_fraction", "clipped")
PROPERTIES = {
    "buildings": (*COMMON, "sampled", "pixels", "mean_probability"),
    "roads": (*COMMON, "highway", "name", "length_km", "flooded_length_km", "flood_probability"),
    "bridges": (*COMMON, "name", "highway", "structure", "buffer_m", "mean_probability", "length_km"),
    "settlements": ("osm_id", "name", "place", "class", "priority_rank", "priority_score", "buildings_affected", "extra_distance_km", "snapped", "snap_distance_m", "road_node"),
}


def coordinates(kind: Column, parts: Column) -> Column:
    """GeoJSON geometry as text from a kind and its parts."""
    line = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, lambda q: F.concat(F.lit("["), q["x"].cast("string"), F.lit(","), q["y"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    bracket = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    joined = F.array_join(F.transform(parts, lambda p: line(p["points"])), ",")
    numbers = F.array_distinct(F.transform(parts, lambda p: p["part"]))
    rings = F.array_join(F.transform(numbers, lambda n: bracket(F.array_join(F.transform(F.filter(parts, lambda p: p["part"] == n), lambda p: line(p["points"])), ","))), ",")
    first = F.get(F.get(parts, F.lit(0))["points"], F.lit(0))
    spot = F.concat(F.lit("["), first["x"].cast("string"), F.lit(","), first["y"].cast("string"), F.lit("]"))
    body = F.when(kind == "Point", spot).when(kind == "LineString", line(F.get(parts, F.lit(0))["points"])).when(kind.isin("Polygon", "MultiLineString"), bracket(joined)).when(kind == "MultiPolygon", bracket(rings)).otherwise(bracket(F.array_join(F.transform(parts, lambda p: F.regexp_replace(line(p["points"]), r"^\[|\]$", "")), ",")))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))


def feature(properties: tuple[str, ...], geometry: Column, columns: list[str]) -> Column:
    """A GeoJSON feature as text, with the named properties that exist; nulls are kept."""
    own = F.to_json(F.struct(*[F.col(c) for c in properties if c in columns]), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","properties":'), own, F.lit(',"geometry":'), geometry, F.lit("}"))


def write_features(rows: DataFrame, path: str, layer: str, geometry: Column) -> None:
    """One feature per line (GeoJSON sequence), written in parallel."""
    rows.select(feature(PROPERTIES[layer], geometry, rows.columns).alias("value")).write.mode("overwrite").text(path)


def collection(features: DataFrame, key: str = "aoi_id", crs: str = "urn:ogc:def:crs:EPSG::4326") -> DataFrame:
    """(aoi_id, geojson): one collection per area from (aoi_id, feature), for areas whose features fit into a row."""
    head = json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}})[:-1]
    return features.groupBy(key).agg(F.concat(F.lit(f'{head}, "features": ['), F.array_join(F.array_sort(F.collect_list("feature")), ","), F.lit("]}")).alias("geojson"))


def write_cells(cells: DataFrame, path: str, tile: int = 512) -> None:
    """Cells as Parquet by area and tile, so that windows are read by pruning."""
    cells.withColumns({"tile_row": F.floor(F.col("row") / tile), "tile_col": F.floor(F.col("col") / tile)}).write.mode("overwrite").partitionBy("aoi_id", "tile_row", "tile_col").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def written(pieces: DataFrame, folder: str, suffix: str, separator: bytes = b"", head: bytes = b"", tail: bytes = b"", key: str = "aoi_id") -> DataFrame:
    """(aoi_id, path, bytes): a file for each area from its pieces (aoi_id, place, content), in the order of their places.

    Pieces run through a task one after the other, so a file may be larger than its memory. Head and tail enclose them, a
    separator stands between those from place 0 on; null contents are left out, and an area of such alone still gets its
    file. A file appears complete or not at all; files of areas with odd names get the name's digest.
    """
    kind = dict(pieces.dtypes)[key]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top)
        now, out, part, size, first, done = None, None, "", 0, True, []

        def close() -> None:
            nonlocal size
            out.write(tail)
            size += len(tail)
            out.close()
            name = str(now) if re.fullmatch(r"[\w-]{1,64}", str(now)) else hashlib.sha256(str(now).encode()).hexdigest()[:24]
            fs.move(part, f"{top}/{name}{suffix}")
            done.append((now, f"{folder}/{name}{suffix}", size))

        for b in batches:
            for area, place, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                if out is None or area != now:
                    if out is not None:
                        close()
                    now, part, size, first = area, f"{top}/.{uuid.uuid4().hex}", len(head), True
                    out = fs.open_output_stream(part)
                    out.write(head)
                if content is not None:
                    if place >= 0 and not first:
                        content = separator + content
                    first = first and place < 0
                    out.write(content)
                    size += len(content)
        if out is not None:
            close()
        if done:
            areas, paths, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(areas), pa.array(paths), pa.array(sizes, pa.int64())], [key, "path", "bytes"])

    dealt = pieces.select(key, F.col("place").cast("long"), F.col("content").cast("binary").alias("content")).repartition(key).sortWithinPartitions(key, "place")
    return dealt.mapInArrow(write, f"{key} {kind}, path string, bytes long")


def write_collections(features: DataFrame, areas: DataFrame, folder: str, suffix: str, order: str, key: str = "aoi_id", crs: str = "urn:ogc:def:crs:EPSG::4326") -> DataFrame:
    """written() GeoJSON collections of features (aoi_id, feature as text), one for each of the areas, empty ones included."""
    head = json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}})[:-1] + ', "features": [\n'
    pieces = features.select(key, F.col(order).cast("long").alias("place"), F.col("feature").cast("binary").alias("content"))
    empty = areas.select(key, F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("content"))
    return written(pieces.unionByName(empty), folder, suffix, b",\n", head.encode(), b"\n]}\n", key)


def strips(cells: DataFrame, grid: DataFrame, value: str, dtype: str = "f4", nodata: float = 0.0, rows: int = 64, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, strip, content, size): deflated strips of so many rows of each area's grid, made in parallel; cells without a value are nodata."""
    shape = grid.select(key, "height", "width")
    kind = dict(cells.dtypes)[key]
    own = cells.select(key, F.floor(F.col("row") / rows).cast("int").alias("strip"), "row", "col", F.col(value).cast("double").alias("v"))
    # A strip without cells is all nodata: each has one row that says that it exists.
    every = shape.select(key, F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / rows).cast("int"))).alias("strip"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(None).cast("double").alias("v"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        g, k = part.iloc[0], int(part["strip"].iloc[0])
        a = np.full((min(rows, int(g["height"]) - k * rows), int(g["width"])), nodata, dtype=dtype)
        has = part["v"].notna()
        a[part.loc[has, "row"] - k * rows, part.loc[has, "col"]] = part.loc[has, "v"]
        content = tiff.packed_strip(a)
        return pd.DataFrame({key: [g[key]], "strip": [k], "content": [content], "size": [len(content)]})

    placed = own.unionByName(every).join(shape, key)
    return placed.groupBy(key, "strip").applyInPandas(pack, f"{key} {kind}, strip int, content binary, size int")


def write_geotiffs(cells: DataFrame, grid: DataFrame, value: str, folder: str, suffix: str, dtype: str = "f4", nodata: float = 0.0, rows: int = 64, key: str = "aoi_id") -> DataFrame:
    """written() GeoTIFF files: strips are packed in parallel, and put one after the other behind a header that their sizes give."""
    packed = stage(strips(cells, grid, value, dtype, nodata, rows, key))
    sizes = packed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("strip", "size"))), lambda x: x["size"]).alias("sizes"))
    kind = dict(cells.dtypes)[key]

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [tiff.header(np.dtype(dtype).newbyteorder("<").str, 1, int(g.height), int(g.width), rows, [int(x) for x in g.sizes], (g.origin_x, g.origin_y), (g.px_w, -g.px_h), nodata=nodata) for g in b.itertuples()]
            yield pd.DataFrame({key: b[key], "place": -1, "content": made})

    heads = grid.select(key, "height", "width", "origin_x", "origin_y", "px_w", "px_h").join(sizes, key).mapInPandas(head, f"{key} {kind}, place long, content binary")
    return written(heads.unionByName(packed.select(key, F.col("strip").cast("long").alias("place"), "content")), folder, suffix, key=key)


def geotiff(cells: DataFrame, grid: DataFrame, value: str, dtype: str = "f4", nodata: float = 0.0, key: str = "aoi_id") -> DataFrame:
    """(aoi_id, content): a GeoTIFF per area; its size is bounded by the cap on areas."""
    rows = cells.select(key, "row", "col", F.col(value).cast("double").alias("v")).join(grid.select(key, "origin_x", "origin_y", "px_w", "px_h", "height", "width"), key)
    kind = dict(cells.dtypes)[key]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        g = part.iloc[0]
        a = np.full((1, int(g["height"]), int(g["width"])), nodata, dtype=dtype)
        ok = part["v"].notna()
        a[0, part.loc[ok, "row"], part.loc[ok, "col"]] = part.loc[ok, "v"]
        return pd.DataFrame({key: [g[key]], "content": [tiff.encode(a, (g["origin_x"], g["origin_y"]), (g["px_w"], -g["px_h"]), nodata=nodata)]})

    return rows.groupBy(key).applyInPandas(one, f"{key} {kind}, content binary")

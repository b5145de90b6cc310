"""Resumable runs: from a request to scenes, flood map, damage, isolation, facts and report.

A run is a folder named by the digest of its request and configuration. Each stage writes its tables into a folder of
its own attempt, and the manifest then names them: a stage counts once the manifest says so, and a run that was killed
goes on behind the last of these. What a stage's operators stage on their way is deleted when the stage is committed.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..errors import FloodError
from ..operators import facts, raster, scenes
from ..operators.tables import filesystem, scratch
from ..sources import cache, connectors, dem, elevation, features, sinks, tiff
from . import damage, flood, isolation, service

#: Days that the catalogue is searched behind the event, and that the map snapshot lies before it unless the request says.
SEARCHED_AFTER, SNAPSHOT_BEFORE = 7, 3
AREA = "aoi"


class Run:
    """Stages of one request. root: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, request: dict, config: Config = DEFAULT) -> None:
        self.spark, self.request, self.config = spark, request, config
        self.key = cache.job_key(request, config.hash())
        self.folder = f"{root}/{self.key}"
        self._fs, self._path = filesystem(self.folder)
        self._fs.create_dir(self._path)
        self.manifest = self._read() or {"request": request, "config": config.hash(), "stages": {}}

    def _read(self) -> dict | None:
        from pyarrow.fs import FileType

        at = f"{self._path}/manifest.json"
        if self._fs.get_file_info(at).type != FileType.File:
            return None
        with self._fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def _commit(self) -> None:
        part = f"{self._path}/.manifest.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(part) as f:
            f.write(json.dumps(self.manifest, sort_keys=True, default=list).encode())
        self._fs.move(part, f"{self._path}/manifest.json")

    def done(self, name: str) -> bool:
        return name in self.manifest["stages"]

    def stage(self, name: str, make: Callable[[], dict]) -> bool:
        """Run a stage unless it is committed; whether it ran. make() gives its tables (DataFrames) and values (JSON) by name."""
        if self.done(name):
            return False
        attempt, tables, values = f"{name}/{uuid.uuid4().hex}", {}, {}
        with scratch():
            for key, found in make().items():
                if isinstance(found, DataFrame):
                    tables[key] = f"{attempt}/{key}"
                    found.write.parquet(f"{self.folder}/{tables[key]}")
                else:
                    values[key] = found
        self.manifest["stages"][name] = {"tables": tables, "values": values}
        self._commit()
        return True

    def table(self, stage: str, name: str) -> DataFrame:
        """A committed table; KeyError if there is none."""
        return self.spark.read.parquet(f"{self.folder}/{self.manifest['stages'][stage]['tables'][name]}")

    def value(self, stage: str, name: str) -> object:
        return self.manifest["stages"][stage]["values"][name]

    def clean(self) -> list[str]:
        """Delete what attempts left that never were committed; their folders."""
        from pyarrow.fs import FileSelector, FileType

        kept = {t.rpartition("/")[0] for s in self.manifest["stages"].values() for t in s["tables"].values()}
        gone = []
        for top in self._fs.get_file_info(FileSelector(self._path)):
            if top.type == FileType.Directory and top.base_name != "files":
                for own in self._fs.get_file_info(FileSelector(top.path)):
                    if own.type == FileType.Directory and f"{top.base_name}/{own.base_name}" not in kept:
                        self._fs.delete_dir(own.path)
                        gone.append(f"{top.base_name}/{own.base_name}")
        return gone


@dataclass
class Services:
    """Where a run gets its data from. Clips and extracts go to the clients' folders, which executors must reach too."""

    copernicus: connectors.CopernicusClient
    maps: connectors.MapClient
    ranges: elevation.Ranges = elevation.read_range
    elevation_base: str = elevation.BASE
    elevation_pixels: int = 3600
    #: Report templates (language, HTML).
    templates: list[tuple[str, str]] = field(default_factory=list)


class FloodRun(Run):
    """The stages of a flood assessment, in the order of STAGES; each can be called on its own once those before it are committed."""

    STAGES = ("pairing", "fetch", "terrain", "flood", "osm", "damage", "isolation", "facts", "report")

    def __init__(self, spark: SparkSession, root: str, request: service.Request, services: Services, config: Config = DEFAULT) -> None:
        super().__init__(spark, root, dataclasses.asdict(request), config)
        self.services, self.asked = services, request

    def go(self) -> list[str]:
        """Run what is not committed yet; the names of the stages that ran."""
        return [name for name in self.STAGES if self.stage(name, getattr(self, name))]

    def pairing(self) -> dict:
        """The first scene behind the event, and the newest ones before it of the same orbit and direction."""
        event = date.fromisoformat(self.asked.event_date[:10])
        start, end = event - timedelta(days=self.config.pairing.search_window_days), event + timedelta(days=SEARCHED_AFTER)
        found = self.services.copernicus.search("s1", self.asked.bbox, f"{start}T00:00:00Z", f"{end}T23:59:59Z")
        known = scenes.normalised_s1(self.spark.createDataFrame([(x,) for x in found], "item string"))
        post = scenes.first_post(known, str(event))
        if post.isEmpty():
            raise FloodError("NO_POST_EVENT_SCENE", event_date=str(event))
        pairs = scenes.pair(post, known.where(F.substring("acquisition_time", 1, 10) < str(event)), self.config.pairing.max_pre_scenes)
        scenes.require_pairs(post, pairs)
        gap = scenes.repeat_gap(pairs, self.config.pairing.primary_repeat_days).first()
        pres = [r.asDict() for r in pairs.orderBy("rank").select(*known.columns).collect()]
        return {"post": post.first().asDict(), "pre": pres, "gap_days": gap["gap_days"], "fits": gap["fits"]}

    def fetch(self) -> dict:
        """Cells of all clips, and their one grid. ValueError if a clip lies on another."""
        post, pres = self.value("pairing", "post"), self.value("pairing", "pre")
        paths = {s["scene_id"]: str(self.services.copernicus.clip("radar", self.asked.bbox, s)[0].resolve()) for s in (post, *pres)}
        names = self.spark.createDataFrame([(f"file:{p}", s) for s, p in paths.items()], "path string, scene_id string")
        files = self.spark.read.format("binaryFile").load(list(paths.values())).withColumn("path", F.regexp_replace("path", "^file:/*", "file:/"))
        files = files.join(F.broadcast(names), "path")  # a few scenes
        grids = tiff.grids(files).join(names, "path").withColumn("aoi_id", F.lit(AREA))
        own = F.col("scene_id") == post["scene_id"]
        if bad := raster.same_grid(grids.where(own), grids.where(~own)).first():
            raise ValueError(f"a scene before the event does not share the grid of the one after it: {bad['reason']}")
        cells = tiff.cells(files).join(names, "path").select(F.lit(AREA).alias("aoi_id"), "scene_id", "row", "col", "vv", "vh", "mask")
        return {"cells": cells, "grid": grids.where(own).drop("path", "scene_id")}

    def terrain(self) -> dict:
        """Slope, shadow and height above drainage on the radar grid."""
        west, south, east, north = self.asked.bbox
        boxes = self.spark.createDataFrame([(AREA, west, south, east, north)], "aoi_id string, min_lon double, min_lat double, max_lon double, max_lat double")
        s = self.services
        z = elevation.elevation(self.spark, [(AREA, self.asked.bbox)], s.elevation_base, s.elevation_pixels, s.ranges)
        grid = dem.window_grid(boxes, s.elevation_pixels)
        return {"layers": flood.terrain_layers(z, grid, self.table("fetch", "grid"), self.value("pairing", "post")["orbit_direction"], self.config.upstream.accumulation_threshold, self.config)}

    def flood(self) -> dict:
        cells, own = self.table("fetch", "cells"), F.col("scene_id") == self.value("pairing", "post")["scene_id"]
        m = flood.flood_map(cells.where(own).drop("scene_id"), cells.where(~own), self.table("fetch", "grid"), self.table("terrain", "layers"), self.config)
        return {f.name: getattr(m, f.name) for f in dataclasses.fields(m)}

    def osm(self) -> dict:
        snapshot = self.asked.osm_snapshot_date or str(date.fromisoformat(self.asked.event_date[:10]) - timedelta(days=SNAPSHOT_BEFORE))
        paths = self.services.maps.extract(self.asked.bbox, snapshot, self.asked.event_date)
        layers, missing = features.scan_layers(self.spark, {k: str(p.resolve()) for k, p in paths.items()}, AREA)
        return {"layers": layers, "missing": missing, "snapshot": snapshot}

    def damage(self) -> dict:
        d = damage.damage(self.table("osm", "layers"), self.table("flood", "cells"), self.table("fetch", "grid"), self.value("osm", "missing"), self.config)
        return {f.name: getattr(d, f.name) for f in dataclasses.fields(d)}

    def isolation(self) -> dict:
        found = isolation.isolation(self.table("osm", "layers"), self.table("flood", "cells"), self.table("fetch", "grid"), self.table("damage", "buildings"), self.config)
        isolation.check_classes(found.settlements)
        return {n: getattr(found, n) for n in ("settlements", "summary", "counts", "facts")}

    def facts(self) -> dict:
        every = facts.facts(self.table("flood", "area"), facts.FLOOD, "flood").unionByName(self.table("damage", "facts")).unionByName(self.table("isolation", "facts"))
        scene = lambda s: F.from_json(F.lit(json.dumps(s)), "struct<scene_id:string,acquisition_time:string,orbit_direction:string,relative_orbit:int>")
        made = facts.provenance("live", self.config.hash(), "1", "baseline", self.value("osm", "snapshot"), scene(self.value("pairing", "post")), F.array(*[scene(s) for s in self.value("pairing", "pre")]), F.lit(None).cast("struct<scene_id:string>"))
        meta = self.spark.createDataFrame([(AREA, self.key, [float(x) for x in self.asked.bbox], self.asked.event_date)], "aoi_id string, job_id string, bbox array<double>, event_date string")
        return {"facts": every, "document": facts.document(every, self.table("isolation", "settlements"), meta.withColumn("provenance", made))}

    def report(self) -> dict:
        line = self.table("damage", "counts").select(facts.report_line()).first()
        found: dict = {"line": line[0] if line else None}
        if self.services.templates:
            found["html"] = facts.report_html(self.table("facts", "facts"), self.spark.createDataFrame(self.services.templates, "lang string, html string"))
        return found

    def layer(self, name: str) -> DataFrame:
        """Features (aoi_id, place, feature as GeoJSON text) of a layer of a committed run: flood, buildings, roads, bridges or settlements."""
        if name == "flood":
            rows = self.table("flood", "polygons").select("aoi_id", F.row_number().over(Window.partitionBy("aoi_id").orderBy("component", "part")).alias("place"), "component", "pixel_count", "geometry")
            return rows.select("aoi_id", "place", sinks.feature(("component", "pixel_count"), F.col("geometry"), rows.columns).alias("feature"))
        if name == "settlements":
            rows = self.table("isolation", "settlements").withColumn("place", F.col("priority_rank"))
            at = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}"))
        elif name in ("buildings", "roads", "bridges"):
            rows = self.table("damage", name).withColumn("place", F.col("osm_id"))
            at = sinks.coordinates(F.col("kind"), F.col("parts"))
        else:
            raise KeyError(name)
        return rows.select("aoi_id", F.abs("place").alias("place"), sinks.feature(sinks.PROPERTIES[name], at, rows.columns).alias("feature"))

    def artifacts(self) -> list[str]:
        """Write each stage's set of files under `files`: rasters, layers and counts; their paths."""
        into, grid = f"{self.folder}/files", self.table("fetch", "grid")
        cells = self.table("flood", "cells").withColumn("mask", F.col("component").isNotNull().cast("int"))
        with scratch():
            sets = [sinks.write_geotiffs(cells, grid, "probability", into, "_flood_probability.tif"), sinks.write_geotiffs(cells, grid, "mask", into, "_flood_mask.tif", "u1")]
            sets += [sinks.write_collections(self.layer(n), grid, into, f"_{kind}.geojson", "place") for n, kind in (("flood", "flood_polygons"), ("buildings", "damage_buildings"), ("roads", "damage_roads"), ("bridges", "damage_bridges"), ("settlements", "isolation_settlements"))]
            steps = self.table("flood", "counts").join(self.table("flood", "thresholds"), "aoi_id", "left").join(self.table("flood", "area"), "aoi_id", "left")
            for rows, suffix in ((steps, "_flood_steps.json"), (self.table("damage", "counts"), "_damage_counts.json"), (self.table("isolation", "counts"), "_isolation_counts.json")):
                sets.append(sinks.written(rows.select("aoi_id", F.lit(0).alias("place"), F.to_json(F.struct(*rows.columns)).alias("content")), into, suffix))
            return sorted(r["path"] for s in sets for r in s.collect())


def steps(spark: SparkSession, root: str, services: Services, config: Config = DEFAULT) -> dict[str, Callable[[dict], dict]]:
    """Steps for service.Jobs.run(): each runs its stages of the request's run, or finds them committed."""

    def step(*names: str) -> Callable[[dict], dict]:
        def run(found: dict) -> dict:
            own = found.get("run") or FloodRun(spark, root, service.Request(**{**found["request"], "bbox": tuple(found["request"]["bbox"])}), services, config)
            for n in names:
                own.stage(n, getattr(own, n))
            return {"run": own}

        return run

    one = {n: step(n) for n in ("pairing", "fetch", "osm", "damage", "isolation", "facts", "report")}
    return one | {"flood_model": step("terrain", "flood"), "terrain_filter": lambda found: {"excluded": found["run"].table("flood", "counts").first().asDict()}}

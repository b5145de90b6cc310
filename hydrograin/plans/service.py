"""Requests, preflight checks, and jobs that run the stages on the driver."""

from __future__ import annotations

import dataclasses
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..errors import FloodError
from ..functions import geo, text
from ..operators import scenes
from ..sources import cache

STAGES = ("pairing", "fetch", "flood_model", "terrain_filter", "osm", "damage", "isolation", "facts", "report")


@dataclass(frozen=True)
class Request:
    bbox: tuple[float, float, float, float]
    event_date: str
    osm_snapshot_date: str | None = None

    def __post_init__(self) -> None:
        west, south, east, north = self.bbox
        if not (west < east and south < north):
            raise ValueError("minima must lie below maxima")
        if not (-180 <= west and east <= 180 and -90 <= south and north <= 90):
            raise ValueError("longitudes lie from -180 to 180, latitudes from -90 to 90")
        if self.osm_snapshot_date is not None and not self.osm_snapshot_date < self.event_date:
            raise ValueError("the map snapshot must lie before the event")


def preflight(spark: SparkSession, request: Request, s1: DataFrame | None = None, s2: DataFrame | None = None, config: Config = DEFAULT) -> dict:
    """Whether a request can run: area, scene pair and cloud cover, from catalogue tables where they are given."""
    box = spark.createDataFrame([request.bbox], "a double, b double, c double, d double")
    area = box.select(geo.bbox_area_km2(*[F.col(c) for c in "abcd"])).first()[0]
    found: dict = {"ok": True, "aoi_area_km2": area, "pair_found": False, "s2_available": False, "s2_cloud_pct": None, "warnings": [], "error": None}
    if area > config.aoi.max_area_km2:
        return found | {"ok": False, "error": FloodError("AOI_TOO_LARGE", area_km2=area, max_area_km2=config.aoi.max_area_km2).payload()["error"]}
    if s1 is not None:
        post = scenes.first_post(s1, request.event_date)
        pairs = scenes.repeat_gap(scenes.pair(post, s1.where(F.substring("acquisition_time", 1, 10) < request.event_date), config.pairing.max_pre_scenes), config.pairing.primary_repeat_days)
        best = pairs.first()
        found["pair_found"] = best is not None
        if best is None:
            code = "NO_VALID_ORBIT_PAIR" if not post.isEmpty() else "NO_POST_EVENT_SCENE"
            return found | {"ok": False, "error": FloodError(code).payload()["error"]}
        if not best["fits"]:
            found["warnings"].append(f"the pair is {best['gap_days']} days apart")
    if s2 is not None and (row := scenes.clearest(s2, request.event_date).first()):
        usable = row["cloud_pct"] is not None and row["cloud_pct"] <= config.optical.cloud_limit_pct
        found |= {"s2_available": usable, "s2_cloud_pct": row["cloud_pct"]}
        if not usable:
            found["warnings"].append("S2_TOO_CLOUDY")
    return found


def selftest(spark: SparkSession, root: str, config: Config = DEFAULT) -> dict:
    """Whether the parts work together, each tried for real: a query on executors, Python in a task, the shared folder, the configuration."""
    from ..operators import raster
    from ..operators.tables import release, stage
    from ..sources import tiff

    def query() -> None:
        cells = spark.range(64).selectExpr("'a' AS aoi_id", "IF(id % 2 = 0, -4.0D, 0.5D) AS v")
        found = raster.otsu(cells, "v").first()
        if found["method"] != "otsu":
            raise ValueError(found["method"])

    def python() -> None:
        files = spark.createDataFrame([("x", bytearray(tiff.encode(np.ones((3, 2, 2), "f4"), (85.0, 28.0), (1.0, 1.0))))], "path string, content binary")
        if tiff.cells(files).count() != 4:
            raise ValueError("cells are missing")

    def shared() -> None:
        table = stage(spark.range(3))
        try:
            if table.count() != 3:
                raise ValueError("rows are missing")
        finally:
            release(table)

    def files() -> None:
        path = cache.store(Path(root) / ".selftest", config.hash().encode())
        if cache.load(path) != config.hash().encode():
            raise ValueError("content differs")
        path.unlink()

    checks = {}
    for name, check in (("query", query), ("python", python), ("shared_folder", shared), ("cache_folder", files), ("config", lambda: Config.of(dataclasses.asdict(config)))):
        try:
            check()
            checks[name] = "passed"
        except Exception as e:  # whatever fails is the answer
            checks[name] = f"failed: {str(e)[:200]}"
    return {"status": "passed" if set(checks.values()) == {"passed"} else "failed", "checks": checks}


def answer(spark: SparkSession, question: str, facts: DataFrame, lang: str = "en") -> str:
    """An answer whose numbers come from the facts (id, value) alone."""
    which = text.intent(F.lit(question))
    values = facts.agg(F.map_from_entries(F.collect_list(F.struct("id", "value"))).alias("v"))
    return values.select(text.render(text.answer(which), F.col("v"), lang)).first()[0]


@dataclass
class Job:
    job_id: str
    request: dict
    status: str = "queued"
    current_stage: str | None = None
    stages: list[dict] = field(default_factory=lambda: [{"name": s, "state": "pending", "duration_seconds": None} for s in STAGES])
    warnings: list[str] = field(default_factory=list)
    error: dict | None = None
    created_at: float = field(default_factory=time.time)

    @property
    def progress(self) -> float:
        return sum(s["state"] in ("succeeded", "skipped") for s in self.stages) / len(self.stages)


class Jobs:
    """Registry of jobs with a record on disk each. A job's Spark work carries its id as tag, by which it is cancelled."""

    def __init__(self, root: str, config: Config = DEFAULT) -> None:
        self.root, self.config, self.jobs, self._lock = Path(root), config, {}, threading.Lock()
        for path in sorted(self.root.glob("*/job.json")):
            job = Job(**json.loads(path.read_text()))
            if job.status in ("queued", "running"):
                job.status, job.error = "failed", FloodError("INTERNAL", reason="restart").payload()["error"]
            self.jobs[job.job_id] = job
            self._save(job)

    def _save(self, job: Job) -> None:
        cache.store(self.root / job.job_id / "job.json", json.dumps(dataclasses.asdict(job)).encode())

    def create(self, request: Request) -> Job:
        with self._lock:
            if sum(j.status in ("queued", "running") for j in self.jobs.values()) >= self.config.jobs.queue_limit:
                raise FloodError("BUSY")
            job = Job(uuid.uuid4().hex, dataclasses.asdict(request))
            self.jobs[job.job_id] = job
            self._save(job)
            return job

    def get(self, job_id: str) -> Job | None:
        return self.jobs.get(job_id)

    def cancel(self, spark: SparkSession, job_id: str) -> Job:
        job = self.jobs[job_id]
        with self._lock:
            if job.status in ("queued", "running"):
                job.status = "cancelled"
                self._save(job)
        spark.interruptTag(f"job-{job_id}")
        return job

    def run(self, spark: SparkSession, job: Job, steps: dict[str, Callable[[dict], dict]]) -> dict:
        """Run the steps in the order of STAGES; each takes and returns what the former ones found. Stages without a step are skipped."""
        found: dict = {"request": job.request}
        spark.addTag(f"job-{job.job_id}")
        try:
            for row in job.stages:
                if job.status == "cancelled":
                    return found
                job.status, job.current_stage = "running", row["name"]
                began = time.monotonic()
                if step := steps.get(row["name"]):
                    row["state"] = "running"
                    self._save(job)
                    found |= step(found) or {}
                row["state"] = "succeeded" if step else "skipped"
                row["duration_seconds"] = round(time.monotonic() - began, 3)
                self._save(job)
            job.status, job.current_stage = "succeeded", None
        except Exception as e:
            if job.status != "cancelled":
                job.status = "failed"
                job.error = e.payload()["error"] if isinstance(e, FloodError) else FloodError("INTERNAL", reason=str(e)[:500]).payload()["error"]
            raise
        finally:
            spark.removeTag(f"job-{job.job_id}")
            self._save(job)
        return found


def presets(root: str) -> list[dict]:
    """Preset areas from the YAML files of a folder, by file name."""
    import yaml

    return [{"id": p.stem, **(yaml.safe_load(p.read_text(encoding="utf-8")) or {})} for p in sorted(Path(root).glob("*.yaml"))]

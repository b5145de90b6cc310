"""Closed configuration: groups of dataclasses, unknown keys rejected, hashed for provenance."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Aoi:
    max_side_km: float = 50.0
    max_area_km2: float = 2500.0


@dataclass(frozen=True)
class Pairing:
    primary_repeat_days: int = 12
    search_window_days: int = 24
    max_pre_scenes: int = 3
    allow_degraded_offsets: bool = True


@dataclass(frozen=True)
class Fetch:
    resolution_m: float = 20.0
    timeout_seconds: float = 60.0
    retries: int = 3
    backoff_factor: float = 1.5
    s2_datatake_window_seconds: float = 1800.0


@dataclass(frozen=True)
class Flood:
    probability_threshold: float = 0.5
    tile_size: int = 512
    overlap_pixels: int = 64
    speckle_filter_size: int = 3
    vv_weight: float = 0.5
    vh_weight: float = 0.5
    otsu_histogram_bins: int = 256
    otsu_fallback_min_db: float = -6.0
    otsu_fallback_max_db: float = -1.0
    probability_scale_db: float = 1.0
    permanent_water_vv_max_db: float = -16.0
    permanent_water_vh_max_db: float = -22.0
    min_component_size_px: int = 9
    area_sanity_min_km2: float = 0.01
    area_sanity_max_km2: float = 200.0
    s1_look_azimuth_ascending_deg: float = 90.0
    s1_look_azimuth_descending_deg: float = 270.0


@dataclass(frozen=True)
class Terrain:
    slope_cutoff_degrees: float = 15.0
    hand_cutoff_m: float = 15.0
    radar_shadow_slope_degrees: float = 52.0


@dataclass(frozen=True)
class Optical:
    cloud_limit_pct: float = 20.0
    mndwi_threshold: float = 0.2


@dataclass(frozen=True)
class Osm:
    snapshot_policy: str = "latest_before_event"
    feature_filters: tuple[str, ...] = ("building", "highway", "bridge", "amenity", "place")
    backend: str = "v2"
    v2_base_url: str = "https://api.heigit.org/ohsome-api/v2-rc"
    base_url: str = "https://api.ohsome.org/v1"
    request_timeout_seconds: float = 60.0
    retries: int = 3


@dataclass(frozen=True)
class Damage:
    affected_overlap_fraction: float = 0.25
    possibly_affected_overlap_fraction: float = 0.05
    bridge_buffer_m: float = 15.0
    confidence_high_margin: float = 0.20
    confidence_medium_margin: float = 0.05
    road_sample_spacing_m: float = 20.0


@dataclass(frozen=True)
class Isolation:
    flood_threshold_edge: float = 0.5
    settlement_snap_distance_m: float = 500.0
    facility_tags: tuple[str, ...] = ("hospital", "clinic")
    place_tags: tuple[str, ...] = ("town", "village", "hamlet")
    destination_place_tags: tuple[str, ...] = ("town",)
    severity_weights: dict[str, float] = field(default_factory=lambda: {"newly_cut_off": 1.0, "no_pre_event_access": 0.5, "still_connected": 0.0})
    settlement_radius_m: float = 1000.0
    priority_buildings_weight: float = 1.0
    priority_isolation_weight: float = 2.0


@dataclass(frozen=True)
class Upstream:
    accumulation_threshold: int = 1000
    hand_corridor_m: float = 10.0


@dataclass(frozen=True)
class Landing:
    max_slope_degrees: float = 5.0
    min_area_m2: float = 2500.0
    max_distance_from_settlement_m: float = 2000.0


@dataclass(frozen=True)
class Copilot:
    model: str = "none"
    max_tokens: int = 1024
    template_fallback_enabled: bool = True


@dataclass(frozen=True)
class Jobs:
    max_concurrent_jobs: int = 2
    stage_timeout_seconds: float = 180.0
    queue_limit: int = 10


@dataclass(frozen=True)
class Cache:
    root_dir: str = "data/cache"
    ttl_days: int = 30


@dataclass(frozen=True)
class Config:
    aoi: Aoi = field(default_factory=Aoi)
    pairing: Pairing = field(default_factory=Pairing)
    fetch: Fetch = field(default_factory=Fetch)
    flood: Flood = field(default_factory=Flood)
    terrain: Terrain = field(default_factory=Terrain)
    optical: Optical = field(default_factory=Optical)
    osm: Osm = field(default_factory=Osm)
    damage: Damage = field(default_factory=Damage)
    isolation: Isolation = field(default_factory=Isolation)
    upstream: Upstream = field(default_factory=Upstream)
    landing: Landing = field(default_factory=Landing)
    copilot: Copilot = field(default_factory=Copilot)
    jobs: Jobs = field(default_factory=Jobs)
    cache: Cache = field(default_factory=Cache)

    @classmethod
    def of(cls, values: dict) -> Config:
        """From nested dicts; a key that no group knows raises ValueError, missing keys keep their defaults."""
        groups = {f.name: f.default_factory for f in dataclasses.fields(cls)}
        if unknown := values.keys() - groups.keys():
            raise ValueError(f"unknown configuration groups: {sorted(unknown)}")
        made = {}
        for name, own in values.items():
            kind = groups[name]
            if unknown := own.keys() - {f.name for f in dataclasses.fields(kind)}:
                raise ValueError(f"unknown keys in {name}: {sorted(unknown)}")
            made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})
        return cls(**made)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a YAML or JSON file on the driver."""
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            return cls.of(json.loads(text))
        import yaml

        return cls.of(yaml.safe_load(text) or {})

    def hash(self, length: int = 16) -> str:
        return digest(dataclasses.asdict(self), length)


def digest(value: object, length: int = 64) -> str:
    """Hash of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=list).encode()).hexdigest()[:length]


DEFAULT = Config()

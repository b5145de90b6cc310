"""Pixel, footprint and scene rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT

FLOOR_DB = -60.0
LABELS = ("unaffected", "possibly_affected", "affected")
CLOUDY = (8, 9, 10)


def usable(value: Column, mask: Column | None = None) -> Column:
    """Whether a pixel holds a signal: finite, inside the data mask, above the floor. Never null."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (value > FLOOR_DB)
    return F.coalesce(ok & (mask > 0) if mask is not None else ok, F.lit(False))


def usable_or_null(value: Column, mask: Column | None = None) -> Column:
    return F.when(usable(value, mask), value)


def log_ratio(post: Column, pre: Column) -> Column:
    """Change in dB, in single precision."""
    return (post - pre).cast("float")


def combine(vv: Column, vh: Column, w_vv: float = DEFAULT.flood.vv_weight, w_vh: float = DEFAULT.flood.vh_weight) -> Column:
    """Weighted mean of the polarisations; null if either is. ValueError unless the weights add up to more than 0."""
    if w_vv + w_vh <= 0:
        raise ValueError("weights must add up to more than 0")
    return ((w_vv * vv + w_vh * vh) / (w_vv + w_vh)).cast("float")


def probability(ratio: Column, threshold: Column | float, scale: float = DEFAULT.flood.probability_scale_db) -> Column:
    """Logistic score of a drop below the threshold: one half at it. ValueError unless scale is above 0."""
    if scale <= 0:
        raise ValueError("scale must be above 0")
    return 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (ratio - threshold) / scale))))


def permanent_water(vv: Column, vh: Column, vv_max: float = DEFAULT.flood.permanent_water_vv_max_db, vh_max: float = DEFAULT.flood.permanent_water_vh_max_db) -> Column:
    return F.coalesce((vv <= vv_max) & (vh <= vh_max), F.lit(False))


def above(value: Column, cutoff: float) -> Column:
    """Exclusion by slope or height above drainage; unknown terrain is not excluded."""
    return F.coalesce(~F.isnan(value) & (value > cutoff), F.lit(False))


def without(value: Column, *masks: Column) -> Column:
    """value, or 0 where any mask holds."""
    return F.when(reduce(lambda a, b: a | b, [F.coalesce(m, F.lit(False)) for m in masks]), F.lit(0.0)).otherwise(value)


def first_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first condition that holds, in the order given; null if none does."""
    found = F.lit(None).cast("string")
    for name, c in reversed(reasons.items()):
        found = F.when(F.coalesce(c, F.lit(False)), F.lit(name)).otherwise(found)
    return found


def status_code(fraction: Column, possibly: float = DEFAULT.damage.possibly_affected_overlap_fraction, affected: float = DEFAULT.damage.affected_overlap_fraction) -> Column:
    return F.when(fraction >= affected, 2).when(fraction >= possibly, 1).otherwise(0)


def status(fraction: Column, **cuts: float) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), status_code(fraction, **cuts))


def confidence(
    fraction: Column,
    by_centroid: Column | None = None,
    possibly: float = DEFAULT.damage.possibly_affected_overlap_fraction,
    affected: float = DEFAULT.damage.affected_overlap_fraction,
    high: float = DEFAULT.damage.confidence_high_margin,
    medium: float = DEFAULT.damage.confidence_medium_margin,
) -> Column:
    """Tier by the distance to the nearest boundary between statuses; point samples reach medium at most."""
    margin = F.least(F.abs(fraction - possibly), F.abs(fraction - affected))
    tier = F.when((fraction == 0) | (margin >= high), "high").when(margin >= medium, "medium").otherwise("low")
    return tier if by_centroid is None else F.when(by_centroid & (tier == "high"), "medium").otherwise(tier)


def bridge_status(fraction: Column, possibly: float = DEFAULT.damage.possibly_affected_overlap_fraction) -> Column:
    return F.when(fraction >= possibly, "possibly_impacted").otherwise("unaffected")


def bridge_structure(tags: Column) -> Column:
    return F.when(F.map_contains_key(tags, "highway"), "road_bridge").otherwise("other_bridge")


def has_tag(tags: Column, keys: tuple[str, ...], values: tuple[str, ...] | None = None) -> Column:
    """Whether any of the keys is present, with one of the values if these are given. Never null."""
    one = [F.element_at(tags, F.lit(k)).isin(*values) if values else F.map_contains_key(tags, k) for k in keys]
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in one]), F.lit(False))


_HIGHWAYS = "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential living_street service track path".split()
#: Feature types: condition on tags, and the kinds of geometry that count.
_CARE = ("hospital", "clinic")
FEATURES = {
    "building": (lambda t: has_tag(t, ("building",)) & (F.element_at(t, F.lit("building")) != "no"), ("Polygon", "MultiPolygon")),
    "highway": (lambda t: has_tag(t, ("highway",), tuple(_HIGHWAYS)), ("LineString", "MultiLineString", "Polygon", "MultiPolygon")),
    "bridge": (lambda t: has_tag(t, ("bridge",)), ("LineString", "MultiLineString", "Polygon", "MultiPolygon")),
    "amenity": (lambda t: has_tag(t, ("amenity",), _CARE) | has_tag(t, ("healthcare",), _CARE), None),
    "place": (lambda t: has_tag(t, ("place",)), ("Point", "MultiPoint", "Polygon", "MultiPolygon")),
}


def feature_filter(types: list[str], tags: Column, geom_type: Column) -> Column:
    """Rows of any of the given feature types; ValueError for an unknown type."""
    if unknown := [t for t in types if t not in FEATURES]:
        raise ValueError(f"unknown feature types: {unknown}")
    one = [cond(tags) & geom_type.isin(*geoms) if geoms else cond(tags) for cond, geoms in (FEATURES[t] for t in types)]
    return reduce(lambda a, b: a | b, one)


def cloud_pct(scl: Column) -> Column:
    """Aggregate: percentage of cloudy pixels among those with a class; null if there is none."""
    return F.round(100 * F.try_divide(F.count_if(scl.isin(*CLOUDY)).cast("double"), F.count_if(scl != 0).cast("double")), 2)


def cloud_usable(pct: Column, limit: float = DEFAULT.optical.cloud_limit_pct) -> Column:
    return F.coalesce(pct <= limit, F.lit(False))


def settlement_class(snapped: Column, pre: Column, post: Column) -> Column:
    """Access of a settlement from its shortest distances before and after."""
    return F.when(~snapped | pre.isNull(), "no_pre_event_access").when(post.isNull(), "newly_cut_off").otherwise("still_connected")


def extra_km(pre: Column, post: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), post - pre) / 1000, 6)


def priority_score(buildings: Column, cls: Column, weights: dict[str, float] | None = None, by_building: float = DEFAULT.isolation.priority_buildings_weight, by_class: float = DEFAULT.isolation.priority_isolation_weight) -> Column:
    """Score of a settlement; a class without a weight counts 0."""
    severity = F.lit(0.0)
    for name, w in (weights or DEFAULT.isolation.severity_weights).items():
        severity = F.when(cls == name, F.lit(w)).otherwise(severity)
    return by_building * buildings + by_class * severity

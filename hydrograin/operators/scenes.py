"""Scene catalogues: pairing, selection and gaps. Times are ISO-8601 strings in UTC, compared as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..errors import FloodError


def pair(posts: DataFrame, pres: DataFrame, most: int = DEFAULT.pairing.max_pre_scenes) -> DataFrame:
    """Per post scene the newest pre scenes of the same orbit and direction, `most` at most, numbered by `rank` from 1.

    Scenes: (scene_id, acquisition_time, orbit_direction, relative_orbit). Posts without orbit or direction pair with none.
    """
    p = posts.select(F.col("scene_id").alias("post_id"), F.col("acquisition_time").alias("post_time"), "orbit_direction", "relative_orbit")
    found = p.join(pres, ["relative_orbit", "orbit_direction"]).where(F.col("acquisition_time") < F.col("post_time"))
    newest = W.partitionBy("post_id").orderBy(F.desc("acquisition_time"), "scene_id")
    return found.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most)


def require_pairs(posts: DataFrame, pairs: DataFrame) -> None:
    """FloodError NO_VALID_ORBIT_PAIR if a post scene has no pre scene."""
    lost = posts.join(pairs, posts["scene_id"] == pairs["post_id"], "left_anti").select("scene_id", "relative_orbit", "orbit_direction").first()
    if lost:
        raise FloodError("NO_VALID_ORBIT_PAIR", scene_id=lost[0], relative_orbit=lost[1], direction=lost[2])


def first_post(scenes: DataFrame, event: Column | str, by: list[str] | None = None) -> DataFrame:
    """The first scene on or after the event's day, per group."""
    event = F.lit(event) if isinstance(event, str) else event
    after = scenes.where(F.substring("acquisition_time", 1, 10) >= event)
    row = F.min_by(F.struct(*scenes.columns), F.struct("acquisition_time", "scene_id")).alias("s")
    return (after.groupBy(*by) if by else after.groupBy()).agg(row).select("s.*").where("scene_id IS NOT NULL")


def repeat_gap(pairs: DataFrame, repeat_days: int = DEFAULT.pairing.primary_repeat_days, tolerance: int = 2) -> DataFrame:
    """Nearest pairs with the days between them, and whether they fit the repeat cycle."""
    days = F.datediff(F.substring("post_time", 1, 10).cast("date"), F.substring("acquisition_time", 1, 10).cast("date"))
    return pairs.where("rank = 1").withColumn("gap_days", days).withColumn("fits", (days > 0) & (F.abs(days - repeat_days) <= tolerance))


def clearest(scenes: DataFrame, event: Column | str, by: list[str] | None = None) -> DataFrame:
    """The clearest scene on or after the event's day, or before it if there is none; unknown cover counts as 100."""
    event = F.lit(event) if isinstance(event, str) else event
    before = (F.substring(F.coalesce("acquisition_time", F.lit("")), 1, 10) < event).cast("int")
    order = F.struct(before, F.coalesce(F.col("cloud_pct").cast("double"), F.lit(100.0)), "scene_id")
    row = F.min_by(F.struct(*scenes.columns), order).alias("s")
    return (scenes.groupBy(*by) if by else scenes.groupBy()).agg(row).select("s.*").where("scene_id IS NOT NULL")


def normalised_s1(items: DataFrame) -> DataFrame:
    """Catalogue items (STAC features as JSON text `item`) as scenes; those without id or time are dropped, sorted by time."""
    at = lambda path: F.get_json_object("item", path)
    return items.select(
        at("$.id").alias("scene_id"), at("$.properties.datetime").alias("acquisition_time"), F.upper(at("$.properties['sat:orbit_state']")).alias("orbit_direction"),
        at("$.properties['sat:relative_orbit']").cast("int").alias("relative_orbit"), at("$.properties.platform").alias("platform"), at("$.properties['sar:instrument_mode']").alias("instrument_mode"), at("$.properties['product:type']").alias("product_type"),
    ).where("scene_id IS NOT NULL AND acquisition_time IS NOT NULL").orderBy("acquisition_time")


def normalised_s2(items: DataFrame, max_cloud: float | None = None) -> DataFrame:
    at = lambda path: F.get_json_object("item", path)
    found = items.select(
        at("$.id").alias("scene_id"), at("$.properties.datetime").alias("acquisition_time"), at("$.properties['eo:cloud_cover']").cast("double").alias("cloud_pct"),
        at("$.properties['sat:relative_orbit']").cast("int").alias("relative_orbit"), at("$.properties.platform").alias("platform"),
    ).where("scene_id IS NOT NULL AND acquisition_time IS NOT NULL").orderBy("acquisition_time")
    return found if max_cloud is None else found.where(F.col("cloud_pct") <= max_cloud)

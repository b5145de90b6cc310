"""Polylines as vertex rows: segments, sampling, and aggregation of samples per line or segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT


def vertices(lines: DataFrame, key: str = "aoi_id", id_: str = "osm_id") -> DataFrame:
    """(aoi_id, osm_id, part, idx, x, y) of geometries with parts; other kinds than lines are left out."""
    flat = lines.where(F.col("kind").isin("LineString", "MultiLineString")).select(key, id_, F.explode("parts").alias("p"))
    return flat.select(key, id_, "p.part", F.posexplode("p.points").alias("idx", "q")).select(key, id_, "part", "idx", "q.x", "q.y")


def segments(points: DataFrame, by: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Each vertex with the next one of its line: (x, y, x2, y2, length, start, end), the latter along the line."""
    w = W.partitionBy(*by).orderBy(*order)
    found = points.withColumns({"x2": F.lead(x).over(w), "y2": F.lead(y).over(w)})
    found = found.withColumn("length", F.hypot(F.col("x2") - F.col(x), F.col("y2") - F.col(y)))
    found = found.withColumn("end", F.sum("length").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return found.withColumn("start", F.coalesce(F.lag("end").over(w), F.lit(0.0))).where("x2 IS NOT NULL")


def sample_segments(segs: DataFrame, spacing: float) -> DataFrame:
    """Midpoints (sx, sy) of equal shares of each segment, one per started `spacing`, with the share's length as weight."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / spacing).cast("int"))
    found = segs.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = (F.col("_k") + 0.5) / F.col("_n")
    return found.withColumns({"sx": F.col("x") + t * (F.col("x2") - F.col("x")), "sy": F.col("y") + t * (F.col("y2") - F.col("y")), "weight": F.col("length") / F.col("_n")}).drop("_n", "_k")


def sample_lines(segs: DataFrame, spacing: float, by: list[str]) -> DataFrame:
    """Even stations of each line, both ends included, at most `spacing` apart: (by, station, sx, sy, spacing).

    A station's spacing is the way to the next one, 0 for the last. Each segment makes the stations that fall into
    it, so lines need not be gathered; the last station belongs to the segment that first gets to the end, so none is made twice.
    """
    line = W.partitionBy(*by)
    total = F.max("end").over(line)
    found = segs.withColumn("_total", total).withColumn("_n", F.greatest(F.lit(2), F.ceil(F.col("_total") / spacing).cast("int") + 1))
    step = F.col("_total") / (F.col("_n") - 1)
    found = found.withColumn("_step", step)
    first = F.ceil(F.coalesce(F.try_divide(F.col("start"), F.col("_step")), F.lit(0.0))).cast("int")
    last = F.when(F.col("end") == F.col("_total"), F.col("_n") - 1).otherwise(F.ceil(F.try_divide(F.col("end"), F.col("_step"))).cast("int") - 1)
    found = found.withColumns({"_a": F.when(F.col("start") == 0, 0).otherwise(first), "_b": F.least(last, F.col("_n") - 1)}).where("_b >= _a AND length > 0 AND start < _total")
    found = found.withColumn("station", F.explode(F.sequence("_a", "_b")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("station") * F.col("_step") - F.col("start")) / F.col("length")))
    return found.select(
        *by, "station", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("sx"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("sy"),
        F.when(F.col("station") == F.col("_n") - 1, 0.0).otherwise(F.col("_step")).alias("spacing"), F.col("_total").alias("line_length"),
    )


def edge_probability(samples: DataFrame, by: list[str], value: str = "probability", spacing: str = "spacing", threshold: float = DEFAULT.flood.probability_threshold, weight: Column | None = None) -> DataFrame:
    """Per line: weighted mean and maximum of the samples with a value (null without any), flooded share of all samples.

    A spacing of 0 weighs 1; samples outside the raster stay in the share's denominator.
    """
    w = weight if weight is not None else F.when(F.col(spacing) > 0, F.col(spacing)).otherwise(1.0)
    has = F.col(value).isNotNull()
    return samples.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(has, F.col(value) * w)), F.sum(F.when(has, w))).alias("mean_probability"),
        F.max(value).alias("max_probability"),
        (F.count_if(F.col(value) >= threshold) / F.count("*")).alias("flooded_fraction"),
    )


def segment_probability(samples: DataFrame, by: list[str], value: str = "probability", threshold: float = DEFAULT.flood.probability_threshold) -> DataFrame:
    """Per segment: mean weighted by length over samples inside the raster (0 without any), maximum (outside reads 0), flooded metres."""
    has = F.col(value).isNotNull()
    return samples.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(F.when(has, F.col(value) * F.col("weight"))), F.sum(F.when(has, F.col("weight")))), F.lit(0.0)).alias("probability"),
        F.max(F.coalesce(value, F.lit(0.0))).alias("max_probability"),
        F.coalesce(F.sum(F.when(F.col(value) >= threshold, F.col("weight"))), F.lit(0.0)).alias("flooded_m"),
    )


def vertex_keys(points: DataFrame, x: str = "x", y: str = "y", key: str = "aoi_id", unit: float = 0.01) -> DataFrame:
    """points with node_id: vertices equal to the centimetre are one node, numbered from 0 by x, then y."""
    kx, ky = F.rint(F.col(x) / unit).cast("long"), F.rint(F.col(y) / unit).cast("long")
    return points.withColumns({"_kx": kx, "_ky": ky}).withColumn("node_id", F.dense_rank().over(W.partitionBy(key).orderBy("_kx", "_ky")) - 1).drop("_kx", "_ky")


def merge_edges(segs: DataFrame, key: str = "aoi_id") -> DataFrame:
    """Undirected edges (u, v, length_m, flood_probability, max_probability, flooded_length_m) from segments; parallel ones add up.

    Segments from a node to itself are dropped.
    """
    length = F.sum("length_m")
    return (
        segs.where("u != v")
        .groupBy(key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .agg(
            length.alias("length_m"),
            F.coalesce(F.try_divide(F.sum(F.col("flood_probability") * F.col("length_m")), length), F.lit(0.0)).alias("flood_probability"),
            F.max("max_probability").alias("max_probability"),
            F.sum("flooded_length_m").alias("flooded_length_m"),
        )
    )

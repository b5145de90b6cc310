"""Feature extracts: GeoParquet layers, GeoJSON collections, and their counts and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, wkb

COLUMNS = ("osm_type", "osm_id", "tags", "geom_type", "geom", "clipped")
SCHEMA = (
    "osm_type string, osm_id long, version int, minor_version int, edits int, user_id int, user_name string, changeset_id long, "
    "tags map<string,string>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, geom_type string, geom binary, clipped boolean"
)
#: Tags that predicates ask for, as columns of their own: predicates on map entries don't reach the scan.
HOT_TAGS = ("highway", "place", "amenity", "name")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One layer: six columns are read, geometries decoded; rows without a usable geometry stay, with null parts."""
    df = spark.read.parquet(path).select(*COLUMNS)
    df = df.withColumn("geometry", wkb.from_wkb(F.col("geom"))).drop("geom")
    return df.select("*", F.col("geometry.kind").alias("kind"), F.col("geometry.parts").alias("parts")).drop("geometry")


def usable(layer: DataFrame) -> DataFrame:
    return layer.where("parts IS NOT NULL")


def dropped(layer: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = F.count_if(F.col("parts").isNull()).alias("dropped")
    return (layer.groupBy(*by) if by else layer.groupBy()).agg(n)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems hold the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan_layers(spark: SparkSession, paths: dict[str, str], aoi_id: str = "aoi") -> tuple[DataFrame, list[str]]:
    """(rows of all layers with feature_type and aoi_id, names of the layers that are missing)."""
    found = {k: p for k, p in paths.items() if exists(spark, p)}
    out = None
    for kind, path in found.items():
        layer = usable(scan(spark, path)).withColumns({"feature_type": F.lit(kind), "aoi_id": F.lit(aoi_id)})
        out = layer if out is None else out.unionByName(layer)
    if out is None:
        raise ValueError("no layer exists")
    return out, sorted(paths.keys() - found.keys())


def write_partitioned(layers: DataFrame, path: str) -> None:
    """Layers with their hot tags as columns, partitioned by area and type, so that a stage reads only what it asks for."""
    layers.withColumns({f"tag_{t}": F.element_at("tags", F.lit(t)) for t in HOT_TAGS}).write.partitionBy("aoi_id", "feature_type").parquet(path)


def restrict(layers: DataFrame, kinds: tuple[str, ...] = ("highway", "amenity", "place")) -> DataFrame:
    return layers.where(F.col("feature_type").isin(*kinds))


def select_features(layer: DataFrame, types: list[str]) -> DataFrame:
    """Rows that the filters of the given types let through."""
    return layer.where(classify.feature_filter(types, F.col("tags"), F.col("geom_type")))


def count_rows(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths).agg(F.count("*").alias("n"))


def newest_edit(spark: SparkSession, *paths: str) -> DataFrame:
    """The latest edit over all files, as ISO-8601 text in UTC."""
    return spark.read.parquet(*paths).agg(F.date_format(F.max("edit_timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("newest"))


def from_geojson(spark: SparkSession, path: str, feature_type: str) -> DataFrame:
    """Features of a GeoJSON collection: (feature_type, properties, kind, geometry as JSON text)."""
    lines = spark.read.text(path, wholetext=True)
    one = F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("feature")
    at = lambda p: F.get_json_object("feature", p)
    return lines.select(one).select(F.lit(feature_type).alias("feature_type"), F.from_json(at("$.properties"), "map<string,string>").alias("properties"), at("$.geometry.type").alias("kind"), at("$.geometry").alias("geometry"))


def attic_query(bbox: tuple[float, float, float, float], date: str, types: list[str]) -> str:
    """Overpass text for the state of the map on a date; ValueError for an unknown type."""
    selectors = {"building": ['way["building"]'], "highway": ['way["highway"]'], "bridge": ['way["bridge"]'], "amenity": [f'{k}["{t}"~"hospital|clinic"]' for t in ("amenity", "healthcare") for k in ("node", "way")], "place": ['node["place"]']}
    if unknown := [t for t in types if t not in selectors]:
        raise ValueError(f"unknown feature types: {unknown}")
    west, south, east, north = bbox
    when = date if "T" in date else f"{date}T00:00:00Z"
    body = "".join(f"{s}({south},{west},{north},{east});" for t in types for s in selectors[t])
    return f'[out:json][timeout:60][date:"{when}"];({body});out geom;'


def check_snapshot(snapshot: str, event: str) -> None:
    """ValueError unless the snapshot's day lies before the event's."""
    if not snapshot < event:
        raise ValueError(f"the map snapshot {snapshot} must lie before the event {event}")

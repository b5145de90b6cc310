"""Geographic functions as Column expressions: zones, areas, UTM, grids, elevation tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Metres of a degree of latitude.
DEGREE_M = 111_320.0
#: Largest side of a requested raster.
MAX_PIXELS = 2_500

# WGS84 and the transverse Mercator series of order four in the third flattening.
_A, _FLAT = 6_378_137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_E = math.sqrt(_FLAT * (2 - _FLAT))
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K0, _EAST = 0.9996, 500_000.0
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def centroid(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> tuple[Column, Column]:
    return (min_lon + max_lon) / 2, (min_lat + max_lat) / 2


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone that holds a point."""
    return F.when(lat >= 0, 32600).otherwise(32700) + ((lon + 180) / 6).cast("int") + 1


def bbox_area_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Area between meridians and parallels of a sphere, to two decimals."""
    band = F.abs(F.sin(F.radians(max_lat)) - F.sin(F.radians(min_lat)))
    return F.round(EARTH_KM**2 * F.abs(F.radians(max_lon) - F.radians(min_lon)) * band, 2)


def metres_per_pixel(px_w: Column, px_h: Column, lat: Column) -> tuple[Column, Column]:
    return F.abs(px_w) * DEGREE_M * F.cos(F.radians(lat)), F.abs(px_h) * DEGREE_M


def output_size(bbox: tuple[float, float, float, float], resolution_m: float) -> tuple[int, int]:
    """(width, height) in pixels of a bounding box; both shrink in proportion where one exceeds MAX_PIXELS."""
    west, south, east, north = bbox
    wide = (east - west) * DEGREE_M * math.cos(math.radians((south + north) / 2)) / resolution_m
    high = (north - south) * DEGREE_M / resolution_m
    shrink = min(1.0, MAX_PIXELS / max(wide, high, 1e-9))
    return max(1, round(wide * shrink)), max(1, round(high * shrink))


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(east, north) in metres in a zone from 1 to 60; north is negative south of the equator."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(_FORWARD, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return _EAST + _K0 * _R * east, _K0 * _R * north


def from_utm(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of UTM metres."""
    xi0, eta0 = north / (_K0 * _R), (east - _EAST) / (_K0 * _R)
    xi, eta = xi0, eta0
    for k, b in enumerate(_INVERSE, 1):
        xi = xi - b * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - b * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for k, d in enumerate(_LATITUDE, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183), F.degrees(phi)


def crs_urn(crs: Column) -> Column:
    """OGC name of a CRS, from the digits in its text; 4326 where there are none."""
    digits = F.regexp_replace(crs, "[^0-9]", "")
    return F.concat(F.lit("urn:ogc:def:crs:EPSG::"), F.when(F.length(digits) > 0, digits).otherwise("4326"))


def cell_of(x: Column, y: Column, origin_x: Column, origin_y: Column, px_w: Column, px_h: Column) -> tuple[Column, Column]:
    """(row, col) of the raster cell that holds a point; px_h is negative north-up."""
    return F.floor((y - origin_y) / px_h).cast("int"), F.floor((x - origin_x) / px_w).cast("int")


def centre_of(row: Column, col: Column, origin_x: Column, origin_y: Column, px_w: Column, px_h: Column) -> tuple[Column, Column]:
    """(x, y) of a cell's centre."""
    return origin_x + (col + 0.5) * px_w, origin_y + (row + 0.5) * px_h


def dem_tile_id(lat: Column, lon: Column) -> Column:
    """Name of the one-degree elevation tile with the given south-west corner."""
    south, west = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    return F.concat(
        F.lit("Copernicus_DSM_COG_10_"),
        F.when(south >= 0, "N").otherwise("S"), F.format_string("%02d", F.abs(south)), F.lit("_00_"),
        F.when(west >= 0, "E").otherwise("W"), F.format_string("%03d", F.abs(west)), F.lit("_00_DEM"),
    )


def dem_tile_corner(tile: Column) -> tuple[Column, Column]:
    """(south, west) in degrees of a tile's name; null if it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(tile, r"_([NS])(\d{2})_00_([EW])(\d{3})_00_DEM$", k), F.lit(""))
    south = part(2).cast("int") * F.when(part(1) == "S", -1).otherwise(1)
    west = part(4).cast("int") * F.when(part(3) == "W", -1).otherwise(1)
    return south, west


def dem_tile_url(tile: Column, base: str = "https://copernicus-dem-30m.s3.amazonaws.com") -> Column:
    return F.concat_ws("/", F.lit(base), tile, F.concat(tile, F.lit(".tif")))


def dem_tiles(boxes: DataFrame) -> DataFrame:
    """A row per tile that a box (min_lon, min_lat, max_lon, max_lat) touches, with the tile's corner."""
    edge = 1e-9
    lat = F.sequence(F.floor("min_lat").cast("int"), F.floor(F.col("max_lat") - edge).cast("int"))
    lon = F.sequence(F.floor("min_lon").cast("int"), F.floor(F.col("max_lon") - edge).cast("int"))
    found = boxes.withColumn("tile_south", F.explode(lat)).withColumn("tile_west", F.explode(lon))
    return found.withColumn("tile_id", dem_tile_id(F.col("tile_south"), F.col("tile_west")))


def tile_window(south: Column, west: Column, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, pixels: int) -> tuple[Column, Column, Column, Column]:
    """(row0, row1, col0, col1) of a box in a one-degree tile of pixels x pixels, ends exclusive, clamped to the tile."""
    eps = 1e-6
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(pixels), c.cast("int")))
    return (
        clamp(F.floor((south + 1 - max_lat) * pixels + eps)),
        clamp(F.ceil((south + 1 - min_lat) * pixels - eps)),
        clamp(F.floor((min_lon - west) * pixels + eps)),
        clamp(F.ceil((max_lon - west) * pixels - eps)),
    )


def look_azimuth(direction: Column, ascending: float = 90.0, descending: float = 270.0) -> Column:
    """Azimuth that the radar looks to, by the direction of the pass."""
    return F.when(F.upper(direction).startswith("ASC"), ascending).otherwise(descending)

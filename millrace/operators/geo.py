"""Points as latitude and longitude in degrees; distances on a sphere (within 0.6 % of the spheroid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_371_008.8


def within_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Strictly inside: points on the border are not."""
    return (lat > south) & (lat < north) & (lon > west) & (lon < east)


def metres(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians((a - b) / 2)), F.lit(2))
    h = half(lat, F.lit(to_lat)) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(to_lat))) * half(lon, F.lit(to_lon))
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_radius(lat: Column, lon: Column, to_lat: float, to_lon: float, radius: float) -> Column:
    """A latitude band, which files can be skipped by, before the exact distance."""
    band = radius / RADIUS * 57.29577951308232
    return lat.between(to_lat - band, to_lat + band) & (metres(lat, lon, to_lat, to_lon) <= radius)


def nearest(df: DataFrame, lat: str, lon: str, id: str, to_lat: float, to_lon: float, k: int) -> DataFrame:
    return df.withColumn("metres", metres(F.col(lat), F.col(lon), to_lat, to_lon)).orderBy("metres", id).limit(k)

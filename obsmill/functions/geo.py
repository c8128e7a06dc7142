"""Spherical geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_008.8
#: Radius of a blurred location that publishes none, for measured evidence.
ASSUMED_RADIUS_M = 500
NEAR_SEA_M = 1000.0


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres (haversine)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def destination(lat: Column, lon: Column, bearing_deg: Column, metres: Column) -> Column:
    """struct<lat, lon> at a bearing and distance."""
    d, b, p, q = metres / RADIUS_M, F.radians(bearing_deg), F.radians(lat), F.radians(lon)
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    lon2 = q + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), F.degrees(lon2).alias("lon"))


def blur_samples(lat: Column, lon: Column, radius_m: Column) -> Column:
    """The pin and eight points on the blur circle."""
    around = [destination(lat, lon, F.lit(45.0 * k), radius_m) for k in range(8)]
    return F.array(F.struct(lat.alias("lat"), lon.alias("lon")), *around)


def blur_range(metres: Column, radius_m: Column) -> Column:
    """struct<low, high, assumed>: distances possible within the blur; an unknown radius is assumed."""
    r = F.coalesce(radius_m, F.lit(ASSUMED_RADIUS_M))
    return F.struct(F.greatest(F.lit(0.0), metres - r).alias("low"), (metres + r).alias("high"), radius_m.isNull().alias("assumed"))


def least_distance(metres: Column, radius_a: Column, radius_b: Column) -> Column:
    """Least possible distance of two blurred places, to 0.1 m; an unknown radius is an exact pin."""
    return F.round(F.greatest(F.lit(0.0), metres - F.coalesce(radius_a, F.lit(0)) - F.coalesce(radius_b, F.lit(0))), 1)


def near_sea(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "unknown").when(high <= NEAR_SEA_M, "measured").when(low > NEAR_SEA_M, "denied").otherwise("unknown")


def segment_distance(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Metres from a point to a short segment, on the plane that touches the sphere at the point."""
    k = F.cos(F.radians(lat)) * (RADIUS_M * 3.141592653589793 / 180)
    m = RADIUS_M * 3.141592653589793 / 180
    ax, ay, bx, by = (a_lon - lon) * k, (a_lat - lat) * m, (b_lon - lon) * k, (b_lat - lat) * m
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy))), F.lit(0.0))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

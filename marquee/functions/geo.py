"""Geography expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.text import _col

EARTH_RADIUS = {"km": 6371.0, "mi": 3959.0}


def haversine(lat1, lng1, lat2, lng2, unit: str = "km") -> Column:
    """Great-circle distance."""
    lat1, lng1, lat2, lng2 = (_col(x) for x in (lat1, lng1, lat2, lng2))
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lng), 2
    )
    return EARTH_RADIUS[unit] * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_box(lat, lng, box: tuple[float, float, float, float]) -> Column:
    """Inside (south, north, west, east), edges included."""
    south, north, west, east = box
    return _col(lat).between(south, north) & _col(lng).between(west, east)


def in_coverage(lat, lng) -> Column:
    return in_box(lat, lng, V.CORE_BOX) | in_box(lat, lng, V.COAST_BOX)


def area(lat, lng) -> Column:
    """Name of the box a point falls in."""
    return (
        F.when(in_box(lat, lng, V.CORE_BOX), F.lit("westside"))
        .when(in_box(lat, lng, V.COAST_BOX), F.lit("malibu"))
        .otherwise(F.lit("outside"))
    )


def within_radius(lat, lng, point=V.REFERENCE_POINT, miles: float = V.RADIUS_MILES) -> Column:
    """At most so many miles from a point."""
    return haversine(lat, lng, F.lit(point[0]), F.lit(point[1]), "mi") <= miles

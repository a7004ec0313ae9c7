"""Great-circle distance and location columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Not least(1, chord): that would turn an unknown coordinate into half the globe.
    clamped = F.when(chord > 1, F.lit(1.0)).otherwise(chord)
    return F.asin(F.sqrt(clamped)) * (2 * EARTH_RADIUS_KM)


def coordinate(flat: Column, nested: Column) -> Column:
    """Flat value when it is a number, otherwise the nested one."""
    return F.coalesce(flat.try_cast("double"), nested.try_cast("double"))

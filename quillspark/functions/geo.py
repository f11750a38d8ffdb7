"""Distances on the sphere as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0087714


def distance_km(lon: float, lat: float, lon_column: Column, lat_column: Column) -> Column:
    """Haversine distance; the square root's argument is kept within 0..1."""
    dlat, dlon = F.radians(lat_column - lat) / 2, F.radians(lon_column - lon) / 2
    h = F.sin(dlat) ** 2 + F.cos(F.radians(lat_column)) * math.cos(math.radians(lat)) * F.sin(dlon) ** 2
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def within_box(lon: float, lat: float, km: float, lon_column: Column, lat_column: Column) -> Column:
    """Plain comparisons that a scan can use: a box around the circle (no bound on longitude near a pole)."""
    dlat = math.degrees(km / RADIUS_KM) + 1e-9
    box = (lat_column >= lat - dlat) & (lat_column <= lat + dlat)
    if abs(lat) + dlat < 89:
        reach = math.sin(km / RADIUS_KM) / math.cos(math.radians(lat)) if km / RADIUS_KM < math.pi / 2 else 2
        if reach < 1:
            dlon = math.degrees(math.asin(reach)) + 1e-9
            if lon - dlon >= -180 and lon + dlon <= 180:
                box &= (lon_column >= lon - dlon) & (lon_column <= lon + dlon)
    return box

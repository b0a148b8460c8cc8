"""Spherical-earth column expressions (degrees, metres of altitude, km of distance)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skylattice.constants import EARTH_RADIUS_KM, PLANE_LAT0
from skylattice.functions.calendar import as_column


def to_cartesian(
    lat: Column | str, lon: Column | str, alt: Column | str
) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(as_column(lat)), F.radians(as_column(lon))
    radius = F.lit(EARTH_RADIUS_KM) + as_column(alt) / F.lit(1000.0)
    return radius * F.cos(phi) * F.cos(lam), radius * F.cos(phi) * F.sin(lam), radius * F.sin(phi)


def to_geodetic(
    x: Column | str, y: Column | str, z: Column | str
) -> tuple[Column, Column, Column]:
    x, y, z = as_column(x), as_column(y), as_column(z)
    lat = F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
    lon = F.degrees(F.atan2(y, x))
    alt = (F.sqrt(x * x + y * y + z * z) - F.lit(EARTH_RADIUS_KM)) * F.lit(1000.0)
    return lat, lon, alt


def haversine_km(
    lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str,
    eps: float = 0.0,
) -> Column:
    """Great-circle distance; ``eps`` is added under the root to keep it off zero."""
    phi1, phi2 = F.radians(as_column(lat1)), F.radians(as_column(lat2))
    half_dphi = (phi2 - phi1) / F.lit(2.0)
    half_dlam = (F.radians(as_column(lon2)) - F.radians(as_column(lon1))) / F.lit(2.0)
    sin_phi, sin_lam = F.sin(half_dphi), F.sin(half_dlam)
    a = sin_phi * sin_phi + F.cos(phi1) * F.cos(phi2) * sin_lam * sin_lam + F.lit(float(eps))
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing_deg(
    lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str
) -> Column:
    """Initial bearing in degrees, 0 inclusive to 360 exclusive."""
    phi1, phi2 = F.radians(as_column(lat1)), F.radians(as_column(lat2))
    dlam = F.radians(as_column(lon2) - as_column(lon1))
    east = F.sin(dlam) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(dlam)
    return F.pmod(F.degrees(F.atan2(east, north)) + F.lit(360.0), F.lit(360.0))


def scaled_lon(lon: Column | str, lat0: float = PLANE_LAT0) -> Column:
    """Longitude shrunk to the local plane at ``lat0``."""
    return as_column(lon) * F.lit(math.cos(math.radians(lat0)))

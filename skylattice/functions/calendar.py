"""Calendar and solar column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skylattice.constants import SOLAR_TILT

TWO_PI = 2.0 * math.pi


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_cycle(ts: Column | str) -> tuple[Column, Column]:
    """(sin, cos) of the hour of day on a 24 hour circle."""
    angle = F.lit(TWO_PI) * F.hour(as_column(ts)) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def days_in_year(ts: Column | str) -> Column:
    year = F.year(as_column(ts))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(leap, F.lit(366.0)).otherwise(F.lit(365.0))


def day_cycle(ts: Column | str) -> tuple[Column, Column]:
    """(sin, cos) of the day of year, leap years included."""
    angle = F.lit(TWO_PI) * (F.dayofyear(as_column(ts)) - 1) / days_in_year(ts)
    return F.sin(angle), F.cos(angle)


def cos_zenith(ts: Column | str, lat: Column | str, lon: Column | str) -> Column:
    """Cosine of the solar zenith angle; ``ts`` is UTC, local solar hour comes from ``lon``."""
    ts, phi, lon = as_column(ts), F.radians(as_column(lat)), as_column(lon)
    declination = F.radians(
        F.lit(SOLAR_TILT) * F.sin(F.lit(TWO_PI) * (F.lit(284.0) + F.dayofyear(ts)) / F.lit(365.0))
    )
    solar_hour = F.pmod(
        F.hour(ts) + F.minute(ts) / F.lit(60.0) + lon / F.lit(15.0), F.lit(24.0)
    )
    hour_angle = F.radians((solar_hour - F.lit(12.0)) * F.lit(15.0))
    return F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour_angle)

"""Wind, temperature, pressure and humidity column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skylattice.constants import (
    ALT_MEAN, ALT_STD, KELVIN, MAGNUS_A, MAGNUS_B, POISSON_EXPONENT, PRESSURE_REF,
)
from skylattice.functions.calendar import as_column


def wind_direction_xy(wind_dir: Column | str) -> tuple[Column, Column]:
    angle = F.radians(as_column(wind_dir))
    return F.sin(angle), F.cos(angle)


def wind_components(wind_speed: Column | str, wind_dir: Column | str) -> tuple[Column, Column]:
    """(u, v) of the wind vector; direction is where the wind comes from."""
    speed = as_column(wind_speed)
    sine, cosine = wind_direction_xy(wind_dir)
    return -speed * sine, -speed * cosine


def wind_speed_from_uv(u: Column | str, v: Column | str) -> Column:
    u, v = as_column(u), as_column(v)
    return F.sqrt(u * u + v * v)


def kelvin(temp_c: Column | str) -> Column:
    return as_column(temp_c) + F.lit(KELVIN)


def log_rain(rain: Column | str) -> Column:
    """log(1 + mm); a missing or negative reading counts as no rain."""
    return F.log1p(F.greatest(F.coalesce(as_column(rain), F.lit(0.0)), F.lit(0.0)))


def pressure_anomaly(pressure: Column | str, ref: float = PRESSURE_REF) -> Column:
    return as_column(pressure) - F.lit(float(ref))


def dew_point(temp_k: Column | str, humidity_pct: Column | str) -> Column:
    """Magnus dew point in Kelvin; null where humidity is not positive."""
    celsius = as_column(temp_k) - F.lit(KELVIN)
    humidity = as_column(humidity_pct)
    a, b = F.lit(MAGNUS_A), F.lit(MAGNUS_B)
    alpha = F.ln(humidity / F.lit(100.0)) + F.try_divide(a * celsius, b + celsius)
    return F.when(humidity > 0, F.try_divide(b * alpha, a - alpha) + F.lit(KELVIN))


def potential_temperature(
    temp_k: Column | str, pressure: Column | str, ref: float = PRESSURE_REF
) -> Column:
    ratio = F.try_divide(F.lit(float(ref)), as_column(pressure))
    return as_column(temp_k) * F.pow(ratio, F.lit(POISSON_EXPONENT))


def humidity_fraction(humidity_pct: Column | str) -> Column:
    return as_column(humidity_pct) / F.lit(100.0)


def alt_norm(alt: Column | str, mean: float = ALT_MEAN, std: float = ALT_STD) -> Column:
    return (as_column(alt) - F.lit(float(mean))) / F.lit(float(std))


def to_metres_per_second(speed_kmh: Column | str) -> Column:
    """km/h to m/s; text that is not a number and missing readings count as calm."""
    return F.coalesce(as_column(speed_kmh).try_cast("double"), F.lit(0.0)) / F.lit(3.6)

"""The canonical feature row of one station and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylattice.constants import FEATURE_COLUMNS, PRESSURE_REF
from skylattice.functions import calendar as cal, physics as ph


def build_features(
    obs: DataFrame,
    wind_components: bool = True,
    log_rain: bool = True,
    year: bool = False,
    pressure_ref: float = PRESSURE_REF,
    keep: tuple[str, ...] = ("lat", "lon", "alt"),
) -> DataFrame:
    """One projection over cleaned readings (wind speed already in m/s). Dew point and potential
    temperature use Kelvin, humidity in percent and the original pressure; the stored humidity is
    a fraction and the stored pressure an anomaly."""
    temp_k = ph.kelvin("temp")
    hour_sin, hour_cos = cal.hour_cycle("ts")
    day_sin, day_cos = cal.day_cycle("ts")
    dir_sin, dir_cos = ph.wind_direction_xy("wind_dir")
    columns = {
        "temp": temp_k,
        "humidity": ph.humidity_fraction("humidity"),
        "rain": ph.log_rain("rain") if log_rain else F.col("rain"),
        "wind_speed": F.col("wind_speed"),
        "pressure": ph.pressure_anomaly("pressure", pressure_ref),
        "alt_norm": F.col("alt_norm") if "alt_norm" in obs.columns else ph.alt_norm("alt"),
        "wind_dir_sin": dir_sin,
        "wind_dir_cos": dir_cos,
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "day_sin": day_sin,
        "day_cos": day_cos,
        "cos_sza": cal.cos_zenith("ts", "lat", "lon"),
        "dew_point": ph.dew_point(temp_k, "humidity"),
        "potential_temp": ph.potential_temperature(temp_k, "pressure", pressure_ref),
    }
    if wind_components:
        columns["wind_u"], columns["wind_v"] = ph.wind_components("wind_speed", "wind_dir")
    if year:
        columns["year"] = F.year("ts")
    order = [c for c in [*FEATURE_COLUMNS, "year"] if c in columns]
    carried = [c for c in ("source", *keep) if c in obs.columns]
    return obs.select("station_id", "ts", *carried, *[columns[c].alias(c) for c in order])

"""SQL building blocks shared by the check queries (DuckDB dialect)."""

from __future__ import annotations

from skylattice.constants import BBOX, COMPASS_DEGREES
from skylattice.plans.station_events import RAW_COLUMNS, SOURCES, TRAIN_END

PLACES = 6


def r(expr: str, alias: str | None = None, places: int = PLACES) -> str:
    """Rounded double without negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0e0 AS {alias or expr}"


def rr(*cols: str) -> str:
    return ", ".join(r(c) for c in cols)


_compass = " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in COMPASS_DEGREES.items())
_sources = ", ".join(f"'{s}'" for s in SOURCES)
_lat, _lon = BBOX["lat"], BBOX["lon"]

RAW = "raw AS (SELECT " + ", ".join(c.format(text="VARCHAR") for c in RAW_COLUMNS) + " FROM events)"

TYPED = f"""typed AS (
  SELECT event_id, station_id, source, ts, lat, lon, alt, temp, humidity,
    coalesce(rain, 0e0) AS rain, CASE wind_dir {_compass} ELSE NULL END AS wind_dir,
    TRY_CAST(wind_speed AS DOUBLE) AS wind_speed, pressure
  FROM raw WHERE source IN ({_sources}))"""

OBS = """obs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY station_id, ts ORDER BY event_id) AS rn FROM typed)
  WHERE rn = 1)"""

_inside = f"lat BETWEEN {_lat[0]} AND {_lat[1]} AND lon BETWEEN {_lon[0]} AND {_lon[1]}"

POINTS = f"points AS (SELECT * FROM obs WHERE {_inside} AND alt IS NOT NULL)"


def neighbours(var: str) -> str:
    """Nearest reading within eight hours on either side, else the one 24 hours away."""
    value = f"CASE WHEN {var} IS NOT NULL THEN {{'e': e, 'v': {var}}} END"
    win = "OVER (PARTITION BY station_id ORDER BY e RANGE BETWEEN"
    return f"""
      coalesce(last_value({value} IGNORE NULLS) {win} 28800 PRECEDING AND 3600 PRECEDING),
               last_value({value} IGNORE NULLS) {win} 86400 PRECEDING AND 86400 PRECEDING)) AS {var}_b,
      coalesce(first_value({value} IGNORE NULLS) {win} 3600 FOLLOWING AND 28800 FOLLOWING),
               first_value({value} IGNORE NULLS) {win} 86400 FOLLOWING AND 86400 FOLLOWING)) AS {var}_f"""


def filled(var: str) -> str:
    return (
        f"coalesce({var}, CASE WHEN {var}_b IS NOT NULL AND {var}_f IS NOT NULL THEN "
        f"{var}_b.v + ({var}_f.v - {var}_b.v) * CAST(e - {var}_b.e AS DOUBLE) "
        f"/ CAST({var}_f.e - {var}_b.e AS DOUBLE) END)"
    )


RAIN = """greatest(rain - CASE WHEN hour(ts) = 0 THEN 0e0 ELSE coalesce(
      last_value(rain IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY e
        RANGE BETWEEN 3600 PRECEDING AND 3600 PRECEDING), 0e0) END, 0e0)"""

EPOCHED = "epoched AS (SELECT *, CAST(epoch(ts) AS BIGINT) AS e FROM obs)"

FOUR = ["temp", "humidity", "wind_speed", "pressure"]

CLEAN = f"""looked AS (
  SELECT *, {RAIN} AS rain_h, {', '.join(neighbours(v) for v in FOUR)} FROM epoched),
 completed AS (
  SELECT event_id, station_id, source, ts, lat, lon, alt, rain_h AS rain, wind_dir,
    {', '.join(f'{filled(v)} AS {v}' for v in FOUR)} FROM looked),
 clean AS (
  SELECT event_id, station_id, source, ts, lat, lon, alt, temp,
    least(greatest(humidity, 0e0), 100e0) AS humidity, rain,
    least(greatest(wind_dir, 0e0), 360e0) AS wind_dir,
    least(greatest(wind_speed, 0e0), 200e0) AS wind_speed, pressure
  FROM completed WHERE temp IS NOT NULL AND humidity IS NOT NULL AND wind_dir IS NOT NULL
    AND wind_speed IS NOT NULL AND pressure IS NOT NULL)"""

NODES = f"""fit AS (SELECT * FROM clean WHERE {_inside} AND alt IS NOT NULL AND humidity <> 0),
 nodes AS (SELECT * REPLACE (coalesce(wind_speed, 0e0) / 3.6e0 AS wind_speed) FROM fit
  WHERE ts IN (SELECT ts FROM fit GROUP BY ts HAVING count(*) >= 2))"""

HOUR_ANGLE = "(2e0 * pi() * hour(ts) / 24e0)"
DAYS = ("(CASE WHEN (year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 "
        "THEN 366e0 ELSE 365e0 END)")
DAY_ANGLE = f"(2e0 * pi() * (dayofyear(ts) - 1) / {DAYS})"
DECLINATION = "radians(23.44e0 * sin(2e0 * pi() * (284e0 + dayofyear(ts)) / 365e0))"
SOLAR_HOUR = ("((hour(ts) + minute(ts) / 60e0 + lon / 15e0)"
              " - 24e0 * floor((hour(ts) + minute(ts) / 60e0 + lon / 15e0) / 24e0))")
ZENITH = (f"(sin(radians(lat)) * sin({DECLINATION}) + cos(radians(lat)) * cos({DECLINATION})"
          f" * cos(radians(({SOLAR_HOUR} - 12e0) * 15e0)))")
ALPHA = "(ln(humidity / 100e0) + 17.27e0 * temp / nullif(237.7e0 + temp, 0))"
DEW = (f"CASE WHEN humidity > 0 THEN 237.7e0 * {ALPHA} / nullif(17.27e0 - {ALPHA}, 0)"
       " + 273.15e0 END")
THETA = "(temp + 273.15e0) * pow(1013e0 / nullif(pressure, 0), 0.286e0)"

FEATURE_EXPRS = {
    "temp": "temp + 273.15e0",
    "humidity": "humidity / 100e0",
    "rain": "ln(1e0 + greatest(coalesce(rain, 0e0), 0e0))",
    "wind_speed": "wind_speed",
    "pressure": "pressure - 1013e0",
    "alt_norm": "(alt - 454.3e0) / 175.61e0",
    "wind_dir_sin": "sin(radians(wind_dir))",
    "wind_dir_cos": "cos(radians(wind_dir))",
    "hour_sin": f"sin{HOUR_ANGLE}",
    "hour_cos": f"cos{HOUR_ANGLE}",
    "day_sin": f"sin{DAY_ANGLE}",
    "day_cos": f"cos{DAY_ANGLE}",
    "cos_sza": ZENITH,
    "dew_point": DEW,
    "potential_temp": THETA,
    "wind_u": "-wind_speed * sin(radians(wind_dir))",
    "wind_v": "-wind_speed * cos(radians(wind_dir))",
}
FEATURES = ("features AS (SELECT station_id, source, ts, lat, lon, alt, "
            + ", ".join(f"{e} AS {n}" for n, e in FEATURE_EXPRS.items()) + " FROM nodes)")

TRAIN = f"ts < TIMESTAMP '{TRAIN_END}'"


def params(table: str, cols: list[str], where: str = "TRUE") -> str:
    """CTE body of (feature, mean, std)."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std"
        f" FROM {table} WHERE {where}"
        for c in cols
    )


_CHAIN = [
    ("raw", RAW), ("typed", TYPED), ("obs", OBS), ("points", POINTS), ("epoched", EPOCHED),
    ("clean", CLEAN), ("nodes", NODES), ("features", FEATURES),
]
_NEEDS = {
    "raw": ["raw"],
    "typed": ["raw", "typed"],
    "obs": ["raw", "typed", "obs"],
    "points": ["raw", "typed", "obs", "points"],
    "epoched": ["raw", "typed", "obs", "epoched"],
    "clean": ["raw", "typed", "obs", "epoched", "clean"],
    "nodes": ["raw", "typed", "obs", "epoched", "clean", "nodes"],
    "features": ["raw", "typed", "obs", "epoched", "clean", "nodes", "features"],
}


def sql(base: str | list[str], select: str, *ctes: str) -> str:
    """``WITH`` chain up to the named base frames, extra CTEs, then the final select."""
    bases = [base] if isinstance(base, str) else base
    wanted = {n for b in bases for n in _NEEDS[b]}
    parts = [text for name, text in _CHAIN if name in wanted] + list(ctes)
    return "WITH " + ",\n ".join(parts) + "\n" + select

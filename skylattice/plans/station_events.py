"""The events table read as a network of reporting stations, and the standard frames on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.operators import clean as cl
from skylattice.operators import features as ft
from skylattice.operators import impute as im
from skylattice.session import materialize, use_utc

SOURCES = ["click", "view", "purchase", "signup"]

WIND_NAMES = [
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW",
    "NNW", "Calma", "Variable",
]


def _case(index: str, names: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names[:-1]))
    return f"CASE {index} {arms} ELSE '{names[-1]}' END"


# One expression list serves Spark and DuckDB. {text} is the engine's name of the string type.
RAW_COLUMNS = [
    "event_id",
    "'S' || lpad(CAST(user_id AS {text}), 6, '0') AS station_id",
    "event_type AS source",
    "date_trunc('hour', ts) AS ts",
    "37.9e0 + CAST(user_id * 37 % 520 AS DOUBLE) / 100e0"
    " + sin(CAST(user_id AS DOUBLE)) * 0.004e0 AS lat",
    "-1.5e0 + CAST(user_id * 91 % 600 AS DOUBLE) / 100e0"
    " + cos(CAST(user_id AS DOUBLE)) * 0.004e0 AS lon",
    "CAST(user_id * 53 % 1500 AS DOUBLE) AS alt",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 0.1e0 END AS temp",
    "CASE WHEN event_id % 13 = 5 THEN NULL"
    " ELSE CAST(event_id * 13 % 101 AS DOUBLE) END AS humidity",
    "CASE WHEN event_id % 19 = 3 THEN NULL ELSE CAST(hour(ts) AS DOUBLE) * 0.4e0"
    " + CAST(event_id % 10 AS DOUBLE) * 0.05e0 END AS rain",
    _case("event_id % 18", WIND_NAMES) + " AS wind_dir",
    "CASE WHEN event_id % 17 = 0 THEN 'n/d'"
    " ELSE CAST(event_id % 60 AS {text}) END AS wind_speed",
    "CASE WHEN event_id % 11 = 0 THEN NULL"
    " ELSE CAST(980 + event_id * 7 % 60 AS DOUBLE) END AS pressure",
]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped readings, several per station and hour."""
    events = use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[c.format(text="STRING") for c in RAW_COLUMNS])


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed readings of the official sources, first per station and hour."""
    official = cl.filter_sources(raw(spark, sf_dir), SOURCES)
    return im.first_readings(im.typed_readings(official), "event_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations inside the study area, one per hour they report in."""
    return cl.within_bbox(cl.require_position(obs(spark, sf_dir)))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = im.rain_and_imputation(cl.drop_empty_rows(obs(spark, sf_dir)))
    return cl.clip_ranges(cl.drop_incomplete(filled))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned readings fit for the graph, wind in m/s."""
    inside = cl.within_bbox(cl.require_position(clean(spark, sf_dir)))
    return cl.min_stations(materialize(cl.wind_to_ms(cl.drop_zero_humidity(inside))))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.build_features(nodes(spark, sf_dir))


TRAIN_END = "2024-01-22 00:00:00"


def training_rows():
    """Days 1 to 21: every row lies in one month, so the split is by day instead of year."""
    return F.col("ts") < F.lit(TRAIN_END).cast("timestamp")

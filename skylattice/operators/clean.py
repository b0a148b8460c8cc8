"""Projection, typing and row filters applied to station readings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from skylattice.constants import (
    BBOX, CANONICAL_COLUMNS, COMPASS_DEGREES, IMPUTED_COLUMNS, NUMERIC_COLUMNS,
    OFFICIAL_SOURCES, VALID_RANGES,
)
from skylattice.functions.physics import to_metres_per_second


def filter_sources(df: DataFrame, allowed: Iterable[str] = OFFICIAL_SOURCES) -> DataFrame:
    return df.filter(F.col("source").isin(list(allowed)))


def select_canonical(df: DataFrame, optional_pressure_years: Iterable[int] = (2015,)) -> DataFrame:
    """Canonical columns only. Pressure may be absent as a column, or from a whole file, only in
    the optional years; other files without it are rejected."""
    years = list(optional_pressure_years)
    kept = [c for c in CANONICAL_COLUMNS if c in df.columns]
    if "has_pressure" in df.columns:
        df = df.filter(F.col("has_pressure") | F.year("ts").isin(years))
    elif "pressure" not in df.columns:
        df = df.filter(F.year("ts").isin(years))
    extra = [c for c in ("path", "line_no") if c in df.columns]
    return df.select(*kept, *extra)


def number(c: Column | str) -> Column:
    """Double, with text that is not a number and NaN both as null."""
    column = F.col(c) if isinstance(c, str) else c
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def to_numeric(df: DataFrame, cols: Iterable[str] = NUMERIC_COLUMNS) -> DataFrame:
    return df.withColumns({c: number(c) for c in cols if c in df.columns})


def fill_rain(df: DataFrame) -> DataFrame:
    return df.withColumn("rain", F.coalesce("rain", F.lit(0.0)))


def compass_degrees(c: Column | str) -> Column:
    """Degrees of one of the sixteen compass names; anything else is null."""
    column = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(v) for pair in COMPASS_DEGREES.items() for v in pair])
    return F.try_element_at(table, column)


def compass_to_degrees(df: DataFrame, col: str = "wind_dir") -> DataFrame:
    return df.withColumn(col, compass_degrees(col))


def drop_empty_rows(
    df: DataFrame,
    cols: Iterable[str] = ("temp", "humidity", "alt", "wind_speed", "lat", "lon", "pressure"),
) -> DataFrame:
    """Drop rows with every listed reading missing. Rain is left out of the default list because
    a missing rain reading has already become zero."""
    return df.dropna(how="all", subset=[c for c in cols if c in df.columns])


def drop_incomplete(df: DataFrame, cols: Iterable[str] = IMPUTED_COLUMNS) -> DataFrame:
    return df.dropna(how="any", subset=[c for c in cols if c in df.columns])


def clip_ranges(
    df: DataFrame, ranges: Mapping[str, tuple[float, float]] = VALID_RANGES
) -> DataFrame:
    """Clip into range; a missing reading stays missing."""

    def clipped(name: str, low: float, high: float) -> Column:
        c = F.col(name)
        return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))

    return df.withColumns(
        {n: clipped(n, lo, hi) for n, (lo, hi) in ranges.items() if n in df.columns}
    )


def require_position(df: DataFrame) -> DataFrame:
    return df.dropna(how="any", subset=["lat", "lon", "alt"])


def first_row(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """First row per key. Spark turns ``row_number() = 1`` into a per-task limit before the
    shuffle, so a key holding most of the rows sends at most one row per map task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedupe_stations(df: DataFrame, *order_cols: Column | str) -> DataFrame:
    """First row per station and hour in the given order."""
    return first_row(df, ["station_id", "ts"], order_cols)


def within_bbox(df: DataFrame, box: Mapping[str, tuple[float, float]] = BBOX) -> DataFrame:
    for name, (low, high) in box.items():
        df = df.filter(F.col(name).between(low, high))
    return df


def drop_zero_humidity(df: DataFrame) -> DataFrame:
    """Zero humidity marks a broken sensor; a missing reading is kept."""
    return df.filter(F.col("humidity").isNull() | (F.col("humidity") != 0))


def wind_to_ms(df: DataFrame, col: str = "wind_speed") -> DataFrame:
    return df.withColumn(col, to_metres_per_second(col))


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def min_stations(df: DataFrame, n: int = 2) -> DataFrame:
    """Keep hours with at least ``n`` rows. The counts are aggregated and joined back, so no
    task has to hold a whole hour as a window would."""
    full = df.groupBy("ts").count().filter(F.col("count") >= n).select("ts")
    return df.join(full, "ts", "left_semi")

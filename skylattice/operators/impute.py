"""Readings that depend on the same station's other hours.

All look-backs and look-aheads are bounded (24 hours at most), so a station's history is cut into
fixed spans of hours with a margin copied from each neighbour. One exchange on (station, span)
serves every lookup, and a station that reports most of the data is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from skylattice.operators.clean import compass_degrees, first_row, number

HOUR = 3600
SPAN_HOURS = 336
DEFAULT_VARS = ("temp", "humidity", "wind_speed", "pressure")


def _epoch(ts: str = "ts") -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def _with_spans(df: DataFrame, margin_hours: int) -> DataFrame:
    """Copy each row into every span whose margin it falls in; ``_own`` marks the original."""
    span = SPAN_HOURS * HOUR
    margin = margin_hours * HOUR

    def index(e: Column) -> Column:
        return F.floor(e / F.lit(span)).cast("long")

    e = F.col("_epoch")
    spans = F.array_distinct(F.array(index(e - margin), index(e), index(e + margin)))
    return (
        df.withColumn("_epoch", _epoch())
        .withColumn("_span", F.explode(spans))
        .withColumn("_own", F.col("_span") == index(e))
    )


class _Lookups:
    """Window lookups on one station and span, ordered by epoch seconds."""

    def __init__(self) -> None:
        self.window = Window.partitionBy("station_id", "_span").orderBy("_epoch")

    def exactly(self, value: Column, hours: int) -> Column:
        frame = self.window.rangeBetween(hours * HOUR, hours * HOUR)
        return F.last(value, ignorenulls=True).over(frame)

    def nearest(self, value: Column, hours: int, backward: bool) -> Column:
        if backward:
            frame = self.window.rangeBetween(-hours * HOUR, -HOUR)
            return F.last(value, ignorenulls=True).over(frame)
        frame = self.window.rangeBetween(HOUR, hours * HOUR)
        return F.first(value, ignorenulls=True).over(frame)


def _stamped(var: str) -> Column:
    value = F.col(var)
    return F.when(value.isNotNull(), F.struct(F.col("_epoch").alias("e"), value.alias("v")))


def _neighbour_columns(
    look: _Lookups, var: str, hours: int, fallback: int
) -> dict[str, Column]:
    value = _stamped(var)
    return {
        f"_{var}_back": F.coalesce(
            look.nearest(value, hours, True), look.exactly(value, -fallback)
        ),
        f"_{var}_fwd": F.coalesce(
            look.nearest(value, hours, False), look.exactly(value, fallback)
        ),
    }


def _lookup_frame(
    readings: DataFrame, keep: list[str], vars: list[str], hours: int, fallback: int, rain: bool
) -> DataFrame:
    """``keep`` plus the neighbour structs of every variable and the previous raw rain."""
    look = _Lookups()
    columns: dict[str, Column] = {}
    for var in vars:
        columns.update(_neighbour_columns(look, var, hours, fallback))
    if rain:
        columns["_rain_before"] = look.exactly(F.col("rain"), -1)
    margin = max(hours, fallback) if vars else 1
    need = dict.fromkeys(["station_id", "ts", *keep, *vars, *(["rain"] if rain else [])])
    spans = _with_spans(readings.select(*need), margin)
    return spans.withColumns(columns).filter("_own").select(*keep, *columns)


def first_readings(raw: DataFrame, *order_cols: Column | str) -> DataFrame:
    """The view neighbours are read from: first row per station and hour, even if it is null."""
    return first_row(raw, ["station_id", "ts"], order_cols)


def _attach(
    obs: DataFrame, raw: DataFrame | None, vars: list[str], hours: int, fallback: int,
    rain: bool = False,
) -> DataFrame:
    """``obs`` with its lookups. One row per station and hour needs no join: the rows travel
    through the lookup windows themselves."""
    if raw is None:
        return _lookup_frame(obs, obs.columns, vars, hours, fallback, rain)
    keys = ["station_id", "ts"]
    return obs.join(_lookup_frame(raw, keys, vars, hours, fallback, rain), keys, "left")


def _rain_since(current: Column, before: Column) -> Column:
    base = F.when(F.hour("ts") == 0, F.lit(0.0)).otherwise(F.coalesce(before, F.lit(0.0)))
    return F.greatest(F.coalesce(current, F.lit(0.0)) - base, F.lit(0.0))


def hourly_rain(obs: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Rain accumulated since midnight to rain of the hour. ``raw`` holds one row per station and
    hour (``first_readings``) and must cover ``obs``; without it ``obs`` itself must be such a
    table."""
    joined = _attach(obs, raw, [], 0, 0, rain=True)
    return joined.withColumn("rain", _rain_since(F.col("rain"), F.col("_rain_before"))).drop(
        "_rain_before"
    )


def nearest_valid(
    obs: DataFrame, var: str, hours: int = 8, fallback: int = 24, raw: DataFrame | None = None
) -> DataFrame:
    """Nearest reading within ``hours`` on each side, else the one exactly ``fallback`` hours
    away: ``{var}_back, {var}_back_ts, {var}_fwd, {var}_fwd_ts``."""
    joined = _attach(obs, raw, [var], hours, fallback)
    out = joined.withColumns(
        {
            f"{var}_back": F.col(f"_{var}_back.v"),
            f"{var}_back_ts": F.timestamp_seconds(F.col(f"_{var}_back.e")),
            f"{var}_fwd": F.col(f"_{var}_fwd.v"),
            f"{var}_fwd_ts": F.timestamp_seconds(F.col(f"_{var}_fwd.e")),
        }
    )
    return out.drop(f"_{var}_back", f"_{var}_fwd")


def _interpolated(var: str) -> Column:
    back, fwd = F.col(f"_{var}_back"), F.col(f"_{var}_fwd")
    share = (F.unix_timestamp(F.col("ts").cast("timestamp")) - back["e"]) / (fwd["e"] - back["e"])
    return F.coalesce(
        F.col(var),
        F.when(back.isNotNull() & fwd.isNotNull(), back["v"] + (fwd["v"] - back["v"]) * share),
    )


def impute_linear(
    obs: DataFrame, vars: Iterable[str] = DEFAULT_VARS, hours: int = 8, fallback: int = 24,
    raw: DataFrame | None = None,
) -> DataFrame:
    """Fill missing readings on the time-weighted line between both neighbours. A reading with
    only one neighbour stays missing. Wind direction is compass text in the neighbouring files,
    which is why it is not imputed unless asked for by name."""
    vars = list(vars)
    joined = _attach(obs, raw, vars, hours, fallback)
    return joined.withColumns({v: _interpolated(v) for v in vars}).drop(
        *[f"_{v}_{side}" for v in vars for side in ("back", "fwd")]
    )


def rain_and_imputation(
    obs: DataFrame, vars: Iterable[str] = DEFAULT_VARS, raw: DataFrame | None = None,
    hours: int = 8, fallback: int = 24,
) -> DataFrame:
    """``hourly_rain`` and ``impute_linear`` on one shared exchange."""
    vars = list(vars)
    joined = _attach(obs, raw, vars, hours, fallback, rain=True)
    changed = {v: _interpolated(v) for v in vars}
    changed["rain"] = _rain_since(F.col("rain"), F.col("_rain_before"))
    return joined.withColumns(changed).drop(
        "_rain_before", *[f"_{v}_{side}" for v in vars for side in ("back", "fwd")]
    )


def typed_readings(df: DataFrame) -> DataFrame:
    """Raw text readings as numbers and degrees, rain filled with zero."""
    numeric = ["temp", "humidity", "alt", "wind_speed", "lat", "lon", "pressure"]
    columns = {c: number(c) for c in numeric if c in df.columns}
    columns["rain"] = F.coalesce(number("rain"), F.lit(0.0))
    columns["wind_dir"] = compass_degrees("wind_dir")
    return df.withColumns(columns)

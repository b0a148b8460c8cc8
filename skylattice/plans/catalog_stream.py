"""Queries that stream the station readings, with their check SQL. The readings are written once as
the arriving files and closed; the streams process all of them and give out every hour."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from skylattice.operators import clean as cl, impute as im
from skylattice.plans import oracle as o
from skylattice.plans import station_events as ev
from skylattice.plans.catalog_rows import rounded
from skylattice.plans.oracle import r, sql
from skylattice.session import ensure_checkpoint_dir
from skylattice.streaming import hourly as hs

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str, places: int = 6):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), places)
        ORACLES[name] = oracle
        return fn

    return register


def _folder(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


ORDERED = hs.OBS_SCHEMA + ", event_id bigint"


def _arriving(spark, rows: DataFrame, schema: str = hs.OBS_SCHEMA) -> str:
    """The readings as files that have arrived, and the file that closes the stream."""
    path = _folder(spark, "arriving")
    rows.select(*[part.split()[0] for part in schema.split(",")]).write.parquet(path)
    hs.close_arrivals(spark, path, schema)
    return path


def _typed(spark, sf_dir: str) -> DataFrame:
    return im.typed_readings(cl.filter_sources(ev.raw(spark, sf_dir), ev.SOURCES))


@query("stream_observations", sql("typed", "SELECT DISTINCT station_id, ts FROM typed"))
def _(s, d):
    stream = hs.stream_observations(s, _arriving(s, _typed(s, d)))
    return hs.write_available(stream.select("station_id", "ts"), _folder(s, "stream"))


_VALUES = ["lat", "lon", "alt", "temp", "humidity", "rain", "wind_dir", "wind_speed", "pressure"]


@query("stream_observations_first",
       sql("obs", f"SELECT station_id, ts, source, event_id, {', '.join(r(c) for c in _VALUES)} FROM obs"))
def _(s, d):
    path = _arriving(s, _typed(s, d), ORDERED)
    stream = hs.stream_observations(s, path, schema=ORDERED, order="event_id")
    return hs.write_available(stream.select("station_id", "ts", "source", "event_id", *_VALUES),
                              _folder(s, "stream"))


_PARTS = " UNION ALL ".join(
    f"SELECT ts AS window_start, source, '{c}' AS feature, count({c}) AS n, avg({c}) AS mean,"
    f" var_pop({c}) * count({c}) AS m2 FROM obs GROUP BY ts, source"
    for c in ("temp", "humidity")
)


@query("stream_hourly_stats",
       sql("obs", f"SELECT window_start, source, feature, n, {r('mean', None, 9)}, {r('m2', None, 9)} FROM parts",
           f"parts AS ({_PARTS})"), places=9)
def _(s, d):
    stream = hs.stream_observations(
        s, _arriving(s, _typed(s, d), ORDERED), schema=ORDERED, order="event_id")
    stats = hs.stream_hourly_stats(stream, ["temp", "humidity"])
    return hs.write_available(stats, _folder(s, "stream"))


@query("stream_hourly_rain",
       sql("epoched", f"SELECT station_id, ts, {r('rain')} FROM (SELECT station_id, ts, {o.RAIN} AS rain"
                      " FROM epoched)"))
def _(s, d):
    stream = hs.stream_observations(s, _arriving(s, ev.obs(s, d)))
    return hs.write_available(hs.stream_hourly_rain(stream), _folder(s, "stream"))

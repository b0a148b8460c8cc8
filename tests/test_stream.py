"""Streams over files written by the test, compared with the batch operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skylattice.operators import impute as im, stats as st
from skylattice.streaming import hourly as hs

T0 = datetime(2024, 1, 1)


def put(spark, path, rows):
    frame = spark.createDataFrame(rows, "station_id string, source string, ts timestamp, rain double, temp double")
    for name in ("lat", "lon", "alt", "humidity", "wind_dir", "wind_speed", "pressure"):
        frame = frame.withColumn(name, F.lit(1.0))
    frame.coalesce(1).write.mode("append").parquet(path)


def drain(spark, stream, name, checkpoint):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", checkpoint).start())
    query.processAllAvailable()
    return query


def row(h, station="A", rain=0.0, temp=0.0, source="x"):
    return (station, source, T0 + timedelta(hours=h), rain, temp)


def test_duplicates_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, [row(0, temp=1.0), row(0, temp=1.0), row(1), row(0, "B")])
    q = drain(spark, hs.stream_observations(spark, path), "dedupe", str(tmp_path / "cp"))
    put(spark, path, [row(1), row(2)])
    q.processAllAvailable()
    q.stop()
    got = sorted((r.station_id, r.ts) for r in spark.table("dedupe").collect())
    assert got == [("A", T0), ("A", T0 + timedelta(hours=1)), ("A", T0 + timedelta(hours=2)), ("B", T0)]


def test_hourly_stats_merge_to_the_batch_result(spark, tmp_path):
    path = str(tmp_path / "in")
    first = [row(h, s, temp=float(h * 3 + i)) for h in range(5) for i, s in enumerate("ABC")]
    put(spark, path, first)
    stats = hs.stream_hourly_stats(hs.stream_observations(spark, path, "1 hour"), ["temp"])
    q = drain(spark, stats, "stats", str(tmp_path / "cp"))
    put(spark, path, [row(12)])
    q.processAllAvailable()
    q.stop()
    parts = spark.table("stats")
    got = st.merge_stats(spark.createDataFrame(parts.collect(), parts.schema)).first()
    want = spark.createDataFrame([(r[4],) for r in first], "temp double")
    fitted = st.fit_norm_params(want, ["temp"]).first()
    assert got.n == len(first)
    assert (got["mean"], got["std"]) == (pytest.approx(fitted["mean"]), pytest.approx(fitted["std"]))


def test_hourly_rain_matches_the_batch_operator(spark, tmp_path):
    path = str(tmp_path / "in")
    totals = {20: 1.0, 21: 2.5, 23: 4.0, 24: 0.5, 25: 0.2, 26: 1.2}
    late = {22: 3.0}
    put(spark, path, [row(h, rain=v) for h, v in totals.items() if h <= 23])
    stream = hs.stream_observations(spark, path, "3 hours")
    q = drain(spark, hs.stream_hourly_rain(stream), "rain", str(tmp_path / "cp"))
    put(spark, path, [row(h, rain=v) for h, v in late.items()])
    q.processAllAvailable()
    put(spark, path, [row(h, rain=v) for h, v in totals.items() if h > 23])
    q.processAllAvailable()
    put(spark, path, [row(100)])
    q.processAllAvailable()
    q.stop()
    batch = spark.createDataFrame(
        [("A", T0 + timedelta(hours=h), v) for h, v in {**totals, **late}.items()],
        "station_id string, ts timestamp, rain double")
    want = {r.ts: r.rain for r in im.hourly_rain(batch).collect()}
    got = {r.ts: r.rain for r in spark.table("rain").collect()}
    assert got == want


def test_hourly_rain_needs_no_python_per_station_and_day(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, [row(h, s, rain=float(h * i)) for h in (0, 1, 3) for i, s in enumerate("ABC")])
    hs.close_arrivals(spark, path)
    stream = hs.stream_hourly_rain(hs.stream_observations(spark, path))
    rows = hs.write_available(stream, str(tmp_path / "out")).collect()
    got = {(r.station_id, r.ts.hour): r.rain for r in rows}
    gain = {0: 0.0, 1: 1.0, 3: 3.0}
    assert got == {(s, h): gain[h] * i for h in gain for i, s in enumerate("ABC")}
    assert "Pandas" not in stream._jdf.queryExecution().logical().toString()

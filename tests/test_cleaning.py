"""Cleaning rules on hand-made readings."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skylattice.operators import clean as cl, impute as im, quality as qa

T0 = datetime(2024, 1, 10, 0)


def hours(spark, readings, name="temp", station="A", start=T0):
    rows = [(station, start + timedelta(hours=h), v) for h, v in readings.items()]
    return spark.createDataFrame(rows, f"station_id string, ts timestamp, {name} double")


def by_hour(df, col, start=T0):
    return {int((r.ts - start).total_seconds() // 3600): r[col] for r in df.collect()}


def test_rain_resets_at_midnight_and_floors_at_zero(spark):
    df = hours(spark, {22: 4.0, 23: 5.5, 24: 1.0, 25: 0.5, 27: 3.0}, "rain")
    got = by_hour(im.hourly_rain(df), "rain")
    # first hour and the hour after a gap have nothing to subtract, midnight starts over
    assert got == {22: 4.0, 23: 1.5, 24: 1.0, 25: 0.0, 27: 3.0}


def test_neighbours_reach_eight_hours_then_exactly_a_day(spark):
    df = hours(spark, {0: 10.0, 8: None, 9: None, 24: None, 33: 20.0, 48: 30.0})
    got = {int((r.ts - T0).total_seconds() // 3600): r for r in im.nearest_valid(df, "temp").collect()}
    assert got[8].temp_back == 10.0 and got[8].temp_back_ts == T0
    assert got[9].temp_back is None and got[9].temp_fwd == 20.0
    assert got[9].temp_fwd_ts == T0 + timedelta(hours=33)
    assert got[24].temp_back == 10.0 and got[24].temp_fwd == 30.0


def test_interpolation_is_time_weighted_and_needs_both_sides(spark):
    df = hours(spark, {0: 10.0, 1: None, 4: 22.0, 5: None})
    got = by_hour(im.impute_linear(df, ["temp"]), "temp")
    assert got[1] == pytest.approx(13.0)
    assert got[5] is None


def test_spans_do_not_change_results(spark):
    # two years of one station cross many spans
    readings = {h: (None if h % 5 in (1, 2) else float(h)) for h in range(0, 2000)}
    got = by_hour(im.impute_linear(hours(spark, readings), ["temp"]), "temp")
    assert len(got) == 2000
    assert all(got[h] == pytest.approx(h) for h in range(0, 1998))


def test_raw_view_decides_even_when_its_first_row_is_null(spark):
    rows = [("A", T0, 0, None), ("A", T0, 1, 9.0), ("A", T0 + timedelta(hours=1), 2, None),
            ("A", T0 + timedelta(hours=2), 3, 4.0)]
    raw = spark.createDataFrame(rows, "station_id string, ts timestamp, n int, temp double")
    first = im.first_readings(raw, "n")
    got = {r.n: r.temp for r in im.impute_linear(raw, ["temp"], raw=first).collect()}
    assert got == {0: None, 1: 9.0, 2: None, 3: 4.0}


def test_clip_keeps_missing_readings(spark):
    df = spark.createDataFrame([(None, -5.0), (120.0, 400.0)], "humidity double, wind_dir double")
    assert [tuple(r) for r in cl.clip_ranges(df).collect()] == [(None, 0.0), (100.0, 360.0)]


def test_numbers_and_directions(spark):
    df = spark.createDataFrame([("12.5", "NNW"), ("x", "Calma"), ("NaN", None)], "temp string, wind_dir string")
    got = cl.compass_to_degrees(cl.to_numeric(df, ["temp"])).collect()
    assert [tuple(r) for r in got] == [(12.5, 337.5), (None, None), (None, None)]


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="alt"):
        cl.require_columns(spark.range(1).select(F.lit(1).alias("lat")), ["lat", "alt"])


def test_pressure_is_optional_in_2015_only(spark):
    rows = [(datetime(2015, 5, 1), False), (datetime(2016, 5, 1), False), (datetime(2016, 5, 2), True)]
    df = spark.createDataFrame(rows, "ts timestamp, has_pressure boolean")
    assert {r.ts.year * 100 + r.ts.day for r in cl.select_canonical(df).collect()} == {201501, 201602}


def test_dedupe_limits_before_the_shuffle(spark):
    df = spark.range(100).select(
        F.concat(F.lit("A"), F.col("id") % 2).alias("station_id"),
        F.timestamp_seconds(F.col("id") % 2).alias("ts"), "id")
    out = cl.dedupe_stations(df, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r.id for r in out.collect()) == [0, 1]


def test_report_counts_the_first_failed_rule(spark):
    df = spark.createDataFrame([("f", 1.0, None), ("f", None, None), ("f", 2.0, 3.0)], "k string, a double, b double")
    got = qa.cleaning_report(
        df, {"a": F.col("a").isNotNull(), "b": F.col("b").isNotNull()}, ["k"]).first()
    assert (got.rows_before, got.dropped_a, got.dropped_b, got.rows_after) == (3, 1, 1, 1)


def test_excluded_folders(spark):
    paths = ["/r/2016/01/a.csv", "/r/HTML/a.csv", "/r/x/12_old/a.csv", "/r/2014/a.csv", "/r/myclimate/a.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r.path for r in qa.exclude_paths(df, "cleaning").collect()}
    assert kept == {"/r/2016/01/a.csv", "/r/2014/a.csv"}
    audit = {r.path for r in qa.exclude_paths(df, "audit").collect()}
    assert audit == {"/r/2016/01/a.csv", "/r/HTML/a.csv", "/r/x/12_old/a.csv", "/r/myclimate/a.csv"}

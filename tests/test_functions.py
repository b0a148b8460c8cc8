"""Column expressions against values worked out by hand."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skylattice.functions import calendar as cal, geodesy as geo, physics as ph, scores as sc


def value(spark, column, row=None):
    row = row or {"one": 1}
    return spark.createDataFrame([row]).select(column.alias("v")).first().v


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_cycles(spark):
    ts = F.lit(datetime(2024, 12, 31, 6))
    assert value(spark, cal.hour_cycle(ts)[0]) == pytest.approx(1.0)
    assert value(spark, cal.day_cycle(ts)[0]) == pytest.approx(math.sin(2 * math.pi * 365 / 366))
    common = F.lit(datetime(2023, 12, 31))
    assert value(spark, cal.days_in_year(common)) == 365.0
    assert value(spark, cal.days_in_year(F.lit(datetime(2100, 1, 1)))) == 365.0


def test_noon_sun_on_the_equator(spark):
    # day 81 has declination zero, so the sun stands overhead at noon on the equator
    ts = F.lit(datetime(2023, 3, 22, 12))
    assert value(spark, cal.cos_zenith(ts, *lit(0, 0))) == pytest.approx(1.0, abs=1e-4)
    assert value(spark, cal.cos_zenith(ts, *lit(0, 180))) == pytest.approx(-1.0, abs=1e-4)


def test_dew_point_and_theta(spark):
    # saturated air: the dew point is the temperature
    assert value(spark, ph.dew_point(*lit(293.15, 100))) == pytest.approx(293.15)
    assert value(spark, ph.dew_point(*lit(293.15, 50))) == pytest.approx(273.15 + 9.2544, abs=1e-3)
    assert value(spark, ph.dew_point(*lit(293.15, 0))) is None
    assert value(spark, ph.potential_temperature(*lit(300, 1013))) == pytest.approx(300)
    assert value(spark, ph.potential_temperature(*lit(300, 0))) is None


def test_wind(spark):
    u, v = ph.wind_components(*lit(10, 90))
    assert value(spark, u) == pytest.approx(-10)
    assert value(spark, v) == pytest.approx(0, abs=1e-12)
    assert value(spark, ph.wind_speed_from_uv(*lit(3, 4))) == 5.0
    assert value(spark, ph.to_metres_per_second(F.lit("36"))) == 10.0
    assert value(spark, ph.to_metres_per_second(F.lit("n/d"))) == 0.0
    assert value(spark, ph.log_rain(F.lit(-2.0))) == 0.0


def test_distance_and_bearing(spark):
    assert value(spark, geo.haversine_km(*lit(0, 0, 0, 1))) == pytest.approx(
        6371 * math.pi / 180)
    assert value(spark, geo.haversine_km(*lit(10, 20, 10, 20))) == 0.0
    assert value(spark, geo.haversine_km(*lit(0, 0, 0, 180))) == pytest.approx(6371 * math.pi)
    assert value(spark, geo.bearing_deg(*lit(0, 0, 0, 1))) == pytest.approx(90)
    assert value(spark, geo.bearing_deg(*lit(0, 0, -1, 0))) == pytest.approx(180)
    assert value(spark, geo.bearing_deg(*lit(0, 0, 0, -1))) == pytest.approx(270)


def test_cartesian_round_trip(spark):
    lat, lon, alt = geo.to_geodetic(*geo.to_cartesian(*lit(41.7, 2.2, 850)))
    assert value(spark, lat) == pytest.approx(41.7)
    assert value(spark, lon) == pytest.approx(2.2)
    assert value(spark, alt) == pytest.approx(850, abs=1e-6)


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, None)], "y double, p double")
    got = df.agg(
        sc.rmse("y", "p").alias("rmse"), sc.mae("y", "p").alias("mae"), sc.r2("y", "p").alias("r2"),
        sc.smape("y", "p").alias("smape"),
    ).first()
    assert got.rmse == pytest.approx(math.sqrt(5 / 3))
    assert got.mae == pytest.approx(1.0)
    assert got.r2 == pytest.approx(1 - 5 / 2)
    assert got.smape == pytest.approx(100 * (2 / 3 + 0 + 4 / 8) / 3, rel=1e-5)


def test_constant_truth_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, p double")
    assert df.agg(sc.r2("y", "p").alias("v")).first().v is None

"""Windows, forecasts and statistics on small frames."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import evaluate as evl, forecast as fc, stats as st, windows as wn

T0 = datetime(2024, 1, 1)


def snapshots(spark, n, skip=()):
    rows = [(T0 + timedelta(hours=h),) for h in range(n) if h not in skip]
    return spark.createDataFrame(rows, "ts timestamp")


@pytest.mark.parametrize("n,window,stride,horizon", [(20, 5, 3, 2), (7, 5, 3, 2), (6, 5, 3, 2)])
def test_window_count(spark, n, window, stride, horizon):
    got = wn.sliding_windows(snapshots(spark, n), window, stride, horizon).collect()
    starts = list(range(0, n - window - horizon + 1, stride))
    assert sorted({r.start for r in got}) == starts
    assert len(got) == len(starts) * (window + horizon)
    assert all(r.ts == T0 + timedelta(hours=r.start + r.step) for r in got)
    assert all((r.role == "target") == (r.step >= window) for r in got)


def test_contiguous_drops_runs_over_a_gap(spark):
    rows = snapshots(spark, 13, skip=(6,))
    every = wn.sliding_windows(rows, 3, 1, 1)
    solid = wn.sliding_windows(rows, 3, 1, 1, contiguous=True)
    assert sorted({r.start for r in every.collect()}) == list(range(9))
    assert sorted({r.start for r in solid.collect()}) == [0, 1, 2, 6, 7, 8]


def test_ordinal_over_uneven_buckets(spark):
    ids = ["A", "AB", "ABC1", "ABC2", "B9999", "B99990", "b"]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "station_id string")
    got = {r.station_id: r.node_idx for r in wn.node_index(df, df).collect()}
    assert [got[i] for i in sorted(ids)] == list(range(len(ids)))


def test_split_refuses_late_sequences(spark):
    df = spark.createDataFrame([("s", datetime(2022, 12, 31, 22)), ("t", datetime(2022, 12, 31, 23)),
                                ("u", datetime(2024, 12, 31, 22))], "seq_id string, input_end timestamp")
    got = {r.seq_id: r.split for r in wn.chronological_split(df).collect()}
    assert got == {"s": "train", "t": "val", "u": "test"}
    late = spark.createDataFrame([("x", datetime(2025, 1, 1))], "seq_id string, input_end timestamp")
    with pytest.raises(Exception, match="after the test period"):
        wn.chronological_split(late).collect()


def test_densify_marks_absent_stations(spark):
    feats = spark.createDataFrame(
        [(T0, "A", 1.0), (T0 + timedelta(hours=1), "B", 2.0)], "ts timestamp, station_id string, v double")
    windows = wn.sliding_windows(feats, 1, 1, 1)
    got = {(r.step, r.node_idx): (r.present, r.v) for r in
           wn.densify(windows, feats, wn.node_index(feats), ["v"]).collect()}
    assert got == {(0, 0): (True, 1.0), (0, 1): (False, 0.0), (1, 0): (False, 0.0), (1, 1): (True, 2.0)}


def test_merge_equals_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 5), float(1e6 + x)) for i, x in enumerate(rng.normal(size=400))] + [(1, None)]
    df = spark.createDataFrame(rows, "day int, v double")
    merged = st.merge_stats(
        st.partial_stats(df.filter("day < 3"), ["v"], ["day"]),
        st.partial_stats(df.filter("day >= 3"), ["v"], ["day"]),
    ).first()
    fitted = st.fit_norm_params(df, ["v"]).first()
    assert merged.n == 400
    assert merged["mean"] == pytest.approx(fitted["mean"], rel=1e-14)
    assert merged["std"] == pytest.approx(fitted["std"], rel=1e-9)


def test_normalize_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 9.0), (4.0, None)], "a double, b double")
    params = st.fit_norm_params(df, ["a", "b"])
    back = st.denormalize(st.normalize(df, params, ["a", "b"]), params, ["a", "b"]).collect()
    assert [tuple(r) for r in back] == [
        (pytest.approx(1.0), pytest.approx(5.0)), (pytest.approx(2.0), pytest.approx(9.0)),
        (pytest.approx(4.0), None)]


def test_histogram_counts_every_value(spark):
    df = spark.range(101).select((F.col("id") / 100.0).alias("x"), F.lit(7.0).alias("c"))
    rows = st.histograms(df, ["x", "c"], 10).collect()
    x = {r.bin: r.n for r in rows if r.feature == "x"}
    assert sum(x.values()) == 101 and x[9] == 11
    assert sum(r.n for r in rows if r.feature == "c") == 101


def test_regression_recovers_known_coefficients(spark):
    rng = np.random.default_rng(5)
    x = np.c_[np.ones(300), rng.normal(size=(300, 3)) * [1, 50, 0.01]]
    want = np.array([2.0, -1.0, 0.5, 30.0])
    rows = [("temp", 1, r.tolist(), float(r @ want)) for r in x]
    train = spark.createDataFrame(rows, "variable string, h int, x array<double>, y_true double")
    model = fc.fit_forecaster(train, 4).first()
    assert model.n == 300
    assert np.allclose(model.coef, want)


def test_recursive_forecast_feeds_back(spark):
    models = spark.createDataFrame([("temp", 1, [1.0, 0.5, 0.25, 2.0])], "variable string, h int, coef array<double>")
    design = spark.createDataFrame(
        [("s", "A", "temp", [1.0, 8.0, 4.0, 3.0])],
        "seq_id string, station_id string, variable string, x array<double>")
    got = [r.y_pred for r in fc.recursive_forecast(models, design, 3).orderBy("h").collect()]
    lags, want = [8.0, 4.0], []
    for _ in range(3):
        y = 1 + 0.5 * lags[0] + 0.25 * lags[1] + 2 * 3.0
        want.append(y)
        lags = [y, lags[0]]
    assert got == pytest.approx(want)


def test_moving_forecast_mixes_predictions(spark):
    coef = [1.0, 0.5, 0.25, 2.0]
    models = spark.createDataFrame([("temp", 1, coef)], "variable string, h int, coef array<double>")
    design = spark.createDataFrame(
        [("s", "A", "temp", [1.0, 8.0, 4.0, 3.0]), ("s", "B", "temp", [1.0, 2.0, 1.0, 5.0]),
         ("t", "A", "temp", [1.0, 1.0, 1.0, 1.0])],
        "seq_id string, station_id string, variable string, x array<double>")
    edges = spark.createDataFrame([("s", "A", "B", 0.5), ("s", "B", "A", 2.0), ("s", "C", "A", 1.0)],
                                  "seq_id string, src string, dst string, dist_scaled double")
    got = {(r.seq_id, r.station_id, r.h): r.y_pred
           for r in fc.moving_forecast(models, design, edges, 3, ["temp"]).collect()}
    degree = {"A": 4.0, "B": 1.5}
    state = {"A": ([8.0, 4.0], 3.0), "B": ([2.0, 1.0], 5.0)}
    for h in range(1, 4):
        y = {k: 1 + 0.5 * lags[0] + 0.25 * lags[1] + 2 * mix for k, (lags, mix) in state.items()}
        assert {k: got["s", k, h] for k in y} == pytest.approx(y)
        sent = {k: y[k] / degree[k] ** 0.5 for k in y}
        mixed = {"A": (2.0 * sent["B"] + sent["A"]) / 2.0, "B": (0.5 * sent["A"] + sent["B"]) / 1.5 ** 0.5}
        state = {k: ([y[k], lags[0]], mixed[k]) for k, (lags, _) in state.items()}
    assert got["t", "A", 1] == pytest.approx(1 + 0.5 + 0.25 + 2) and len(got) == 9


def test_overall_r2_is_the_mean_of_variables(spark):
    rows = [("a", 1, y, p) for y, p in [(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)]]
    rows += [("b", 1, y, p) for y, p in [(100.0, 110.0), (300.0, 290.0)]]
    df = spark.createDataFrame(rows, "variable string, h int, y_true double, y_pred double")
    got = {(r.variable, r.h): r for r in evl.evaluate(df).collect()}
    assert got[None, None].r2 == pytest.approx((got["a", None].r2 + got["b", None].r2) / 2)
    assert got[None, None].n == 5
    assert got[None, None].mae == pytest.approx(21 / 5)

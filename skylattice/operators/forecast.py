"""Baseline and regression forecasts on sliding sequences.

A cube is the long table ``seq_id, h, ts_valid, station_id, variable, y_true, y_pred`` with h from 1.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.constants import KELVIN, PRESSURE_REF, TARGET_COLUMNS, UNITS
from skylattice.operators.graph import propagate
from skylattice.operators.windows import one_row
from skylattice.session import materialize

CUBE_KEYS = ["seq_id", "h", "ts_valid", "station_id", "variable"]


def true_cube(
    seq: DataFrame, window: int = 48, variables: Iterable[str] = TARGET_COLUMNS
) -> DataFrame:
    """Target rows of the sequences, one row per variable."""
    rows = seq.filter(F.col("role") == "target").select(
        "seq_id", (F.col("step") - window + 1).alias("h"), F.col("ts").alias("ts_valid"),
        "station_id", *variables,
    )
    return rows.unpivot(CUBE_KEYS[:4], list(variables), "variable", "y_true")


def persistence(
    seq: DataFrame, window: int = 48, variables: Iterable[str] = TARGET_COLUMNS,
    reference: str = "last_input",
) -> DataFrame:
    """The reference step's value repeated over the horizon. ``last_input`` is the newest reading
    a forecaster may see; ``first_target`` repeats the first target step instead, which makes
    the first horizon error-free."""
    step = {"last_input": window - 1, "first_target": window}[reference]
    variables = list(variables)
    seen = seq.filter(F.col("step") == step).select(
        "seq_id", "station_id", *[F.col(v).alias(f"_{v}") for v in variables])
    targets = seq.filter(F.col("role") == "target").select(
        "seq_id", (F.col("step") - window + 1).alias("h"), F.col("ts").alias("ts_valid"),
        "station_id", *variables)
    both = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).alias("y_true"), F.col(f"_{v}").alias("y_pred"))
        for v in variables])
    return targets.join(seen, ["seq_id", "station_id"], "left").select(*CUBE_KEYS[:4], F.inline(both))


def climatology(cube: DataFrame, params: DataFrame) -> DataFrame:
    """The training mean of each variable (one parameter row per variable)."""
    means = params.select(F.col("feature").alias("variable"), F.col("mean").alias("y_pred"))
    return cube.drop("y_pred").join(F.broadcast(means), "variable").select(
        *CUBE_KEYS, "y_true", "y_pred"
    )


def valid_times(windows: DataFrame, horizon: int = 6) -> DataFrame:
    """``seq_id, h, ts_valid`` of every forecast step, h hours after the last input."""
    seqs = windows.select("seq_id", "input_end").distinct()
    steps = seqs.select(
        "seq_id", "input_end", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    )
    return steps.select(
        "seq_id", "h",
        (F.col("input_end") + F.make_dt_interval(hours=F.col("h"))).alias("ts_valid"),
    )


def _physical(c: str) -> Column:
    v, x = F.col("variable"), F.col(c)
    speed = v.isin("wind_speed", "wind_u", "wind_v")
    return (
        F.when(v == "temp", x - F.lit(KELVIN))
        .when(v == "humidity", x * 100.0)
        .when(v == "rain", F.expm1(x))
        .when(speed, x * 3.6)
        .when(v == "pressure", x + F.lit(PRESSURE_REF))
        .otherwise(x)
    )


def to_physical_units(cube: DataFrame, cols: Iterable[str] = ("y_true", "y_pred")) -> DataFrame:
    """Values in the units people read, with a ``unit`` column."""
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return cube.withColumns(
        {**{c: _physical(c) for c in cols}, "unit": F.try_element_at(table, F.col("variable"))}
    )


# --- regression on lags and neighbours -------------------------------------------------------


def lag_steps(windows: DataFrame, window: int = 48, lags: int = 3) -> DataFrame:
    """The steps a regression on ``lags`` inputs reads: those inputs and the targets."""
    return windows.filter(F.col("step") >= window - lags)


def design_rows(
    seq: DataFrame, neighbours: DataFrame, window: int = 48, lags: int = 3,
    variables: Iterable[str] = TARGET_COLUMNS,
) -> DataFrame:
    """``seq_id, station_id, variable, x``: intercept, the last ``lags`` inputs (newest first, a
    missing reading replaced by the newest), and the neighbour mix of the last input hour. Steps
    come from ``lag_steps`` with the same arguments; a sequence without them fails. Rows are
    summed and joined wide, and turned into one row per variable at the end."""
    variables = list(variables)
    recent = seq.filter(F.col("step").between(window - lags, window - 1))
    at = [
        F.max(F.when(F.col("step") == window - 1 - k, F.col(v))).alias(f"_{v}_{k}")
        for v in variables for k in range(lags)
    ]
    newest = F.max(F.when(F.col("step") == window - 1, F.col("ts"))).alias("ts")
    steps = recent.groupBy("seq_id").agg(F.min("step").alias("_oldest"))
    short = F.when(
        F.col("_oldest") > window - lags,
        F.raise_error(F.lit("sequences hold fewer input steps than the lags need")),
    ).otherwise(F.lit(True))
    wide = recent.groupBy("seq_id", "station_id").agg(*at, newest).join(
        steps.filter(short).select("seq_id"), "seq_id")
    mix = neighbours.select("ts", "station_id", *[f"nbr_{v}" for v in variables])

    def row(v: str) -> Column:
        lagged = [F.coalesce(f"_{v}_{k}", f"_{v}_0") for k in range(lags)]
        x = F.array(F.lit(1.0), *lagged, F.coalesce(f"nbr_{v}", f"_{v}_0"))
        return F.struct(F.lit(v).alias("variable"), F.when(F.col(f"_{v}_0").isNotNull(), x).alias("x"))

    return (
        wide.join(mix, ["ts", "station_id"], "left")
        .select("seq_id", "station_id", F.inline(F.array(*[row(v) for v in variables])))
        .filter("x is not null")
    )


def regression_moments(train: DataFrame, width: int) -> DataFrame:
    """``variable, h, n``, the mean of ``y_true`` and of each column of ``x`` after the constant, and
    their covariances, over the rows with ``y_true``. Centred while they are summed, so large values
    such as Kelvin lose no digits; combined map-side."""
    fits = F.when(F.size("x") == width, F.col("x")).otherwise(
        F.raise_error(F.concat(F.lit(f"x has not {width} columns but "), F.size("x").cast("string"))))
    cols = [f"_x{i}" for i in range(1, width)]
    rows = train.filter("y_true is not null").withColumn("_x", fits).select(
        "variable", "h", F.col("y_true").alias("_y"),
        *[F.col("_x")[i].alias(f"_x{i}") for i in range(1, width)])
    return rows.groupBy("variable", "h").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean_y"),
        *[F.avg(c).alias(f"mean{c}") for c in cols],
        *[F.covar_pop(a, b).alias(f"cov{a}{b}") for i, a in enumerate(cols) for b in cols[i:]],
        *[F.covar_pop(c, "_y").alias(f"cov{c}_y") for c in cols])


def fit_forecaster(train: DataFrame, width: int) -> DataFrame:
    """``variable, h, coef, n``: least squares per variable and horizon step over rows with
    ``x`` (``width`` columns, the first constant) and ``y_true``.

    One pass sums the centred moments of every model; what reaches a task afterwards is one small
    matrix per model."""
    cols = [f"_x{i}" for i in range(1, width)]

    def solve(batches):
        for pdf in batches:
            coefs = []
            for _, row in pdf.iterrows():
                a = np.array([[row[f"cov{cols[min(i, j)]}{cols[max(i, j)]}"] for j in range(len(cols))]
                              for i in range(len(cols))], dtype=float).reshape(len(cols), len(cols))
                b = np.array([row[f"cov{c}_y"] for c in cols], dtype=float)
                scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
                slope = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-10)[0] / scale
                at = np.array([row[f"mean{c}"] for c in cols], dtype=float)
                coefs.append([float(row["mean_y"] - slope @ at), *slope.tolist()])
            yield pd.DataFrame(
                {"variable": pdf["variable"], "h": pdf["h"], "coef": coefs, "n": pdf["n"]}
            )

    return regression_moments(train, width).mapInPandas(
        solve, "variable string, h int, coef array<double>, n bigint")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def predict(models: DataFrame, design: DataFrame) -> DataFrame:
    """``seq_id, station_id, variable, h, y_pred``; there are variables x horizon model rows."""
    return design.join(F.broadcast(models), "variable").select(
        "seq_id", "station_id", "variable", "h", _dot(F.col("coef"), F.col("x")).alias("y_pred")
    )


def recursive_forecast(models: DataFrame, design: DataFrame, steps: int = 6) -> DataFrame:
    """Only the one-hour model is used: each prediction becomes the newest lag of the next step
    while the neighbour mix stays as it was. The steps run inside one expression."""
    one_hour = models.filter(F.col("h") == 1).select("variable", "coef")
    rows = design.join(F.broadcast(one_hour), "variable")
    size = F.size("x")
    start = F.struct(
        F.slice("x", F.lit(2), size - 2).alias("lags"), F.array().cast("array<double>").alias("out")
    )

    def advance(state: Column, _: Column) -> Column:
        x = F.concat(F.array(F.lit(1.0)), state["lags"], F.array(F.element_at("x", -1)))
        y = _dot(F.col("coef"), x)
        lags = F.slice(F.concat(F.array(y), state["lags"]), F.lit(1), size - 2)
        return F.struct(lags.alias("lags"), F.concat(state["out"], F.array(y)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda s: s["out"])
    return rows.select(
        "seq_id", "station_id", "variable", F.posexplode(path).alias("_p", "y_pred")
    ).select("seq_id", "station_id", "variable", (F.col("_p") + 1).alias("h"), "y_pred")


def moving_forecast(
    models: DataFrame, design: DataFrame, edges: DataFrame, steps: int = 6,
    variables: Iterable[str] = TARGET_COLUMNS, weight: str = "dist_scaled",
) -> DataFrame:
    """Like ``recursive_forecast``, but neighbours move on, too: after every step the predictions of
    all stations of a sequence are mixed over its graph, and the next step reads that mix.

    ``edges`` are ``seq_id, src, dst`` and the weight, the graph of each sequence's last input hour.
    Where a station has no mix, its own prediction stands in. Every step is written as a table, so the
    plan of a step does not grow with their number; it shuffles one row per sequence and station."""
    variables, keys = list(variables), ["seq_id", "station_id"]
    one_hour = models.filter(F.col("h") == 1).agg(
        *[F.first(F.when(F.col("variable") == v, F.col("coef")), ignorenulls=True).alias(f"_c_{v}")
          for v in variables])
    state = one_row(design.groupBy(*keys).agg(
        *[F.first(F.when(F.col("variable") == v, F.col("x")), ignorenulls=True).alias(f"_x_{v}")
          for v in variables]), one_hour)
    links = materialize(edges.select("seq_id", "src", "dst", weight))
    path = None
    for h in range(1, steps + 1):
        said = materialize(state.select(
            "*", *[_dot(F.col(f"_c_{v}"), F.col(f"_x_{v}")).alias(v) for v in variables]))
        step = said.select(*keys, F.lit(h).alias("h"), *variables)
        path = step if path is None else path.union(step)
        if h < steps:
            mix = propagate(said, links, variables, weight, by="seq_id")
            state = said.join(mix, keys).select(*keys, *[f"_c_{v}" for v in variables], *[
                F.concat(F.slice(f"_x_{v}", 1, 1), F.array(v),
                         F.slice(F.col(f"_x_{v}"), F.lit(2), F.size(f"_x_{v}") - 3),
                         F.array(F.coalesce(f"nbr_{v}", v))).alias(f"_x_{v}") for v in variables])
    long = path.unpivot([*keys, "h"], variables, "variable", "y_pred")
    return long.filter("y_pred is not null").select(*keys, "variable", "h", "y_pred")


def forecast_cube(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    keys = ["seq_id", "station_id", "variable", "h"]
    return truth.join(predictions.select(*keys, "y_pred"), keys, "left").select(
        *CUBE_KEYS, "y_true", "y_pred"
    )

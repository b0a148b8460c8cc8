"""Scores of forecast cubes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from skylattice.functions import scores as sc

SCORES = ["rmse", "mae", "r2", "smape"]


def _aggs() -> list:
    both = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    named = {n: getattr(sc, n)("y_true", "y_pred").alias(n) for n in SCORES}
    return [F.count_if(both).alias("n"), *named.values()]


def mask_invalid(cube: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Null out truth and prediction of stations absent at the target hour (``mask`` lists
    ``seq_id, h, station_id`` that are present), then drop every row of a station and hour with
    any variable missing."""
    if mask is not None:
        keys = ["seq_id", "h", "station_id"]
        here = mask.select(*keys).distinct().withColumn("_here", F.lit(True))
        cube = cube.join(here, keys, "left").withColumns(
            {c: F.when(F.col("_here"), F.col(c)) for c in ("y_true", "y_pred")}
        ).drop("_here")
    # at most one row per variable in a partition
    row = Window.partitionBy("seq_id", "h", "station_id")
    missing = F.max(F.col("y_true").isNull()).over(row)
    return cube.withColumn("_missing", missing).filter(~F.col("_missing")).drop("_missing")


def evaluate(cube: DataFrame) -> DataFrame:
    """``variable, h, n`` and the scores: per variable and step, per variable (h null) and
    overall (both null). The overall R2 is the mean over the variables, as each has its own
    scale; the other overall scores pool all values."""
    table = cube.groupingSets([["variable", "h"], ["variable"], []], "variable", "h").agg(*_aggs())
    # the result has one row per variable and step, so one partition holds it
    per_variable = F.when(F.col("variable").isNotNull() & F.col("h").isNull(), F.col("r2"))
    mean_r2 = F.avg(per_variable).over(Window.partitionBy(F.lit(0)))
    overall = F.col("variable").isNull()
    return table.withColumn("r2", F.when(overall, mean_r2).otherwise(F.col("r2")))


def compare_baselines(cube: DataFrame, baselines: Mapping[str, DataFrame]) -> DataFrame:
    """One row per variable and one named ``all``, with ``{score}_{name}`` columns for the model
    and each baseline."""
    cols = ["variable", "y_true", "y_pred"]
    names = ["model", *baselines]
    rows = cube.select(*cols, F.lit("model").alias("name"))
    for name, frame in baselines.items():
        rows = rows.unionByName(frame.select(*cols, F.lit(name).alias("name")))
    table = rows.groupingSets([["name", "variable"], ["name"]], "name", "variable").agg(*_aggs())
    mean_r2 = F.avg(F.when(F.col("variable").isNotNull(), F.col("r2"))).over(
        Window.partitionBy("name")
    )
    table = table.withColumns(
        {
            "r2": F.when(F.col("variable").isNull(), mean_r2).otherwise(F.col("r2")),
            "variable": F.coalesce("variable", F.lit("all")),
        }
    )
    wide = table.groupBy("variable").pivot("name", names).agg(
        *[F.first(s).alias(s) for s in ("n", *SCORES)]
    )
    return wide.select(
        "variable", F.col("model_n").alias("n"),
        *[F.col(f"{n}_{s}").alias(f"{s}_{n}") for n in names for s in SCORES],
    )

"""Analytics on training run logs: ``run_id, epoch, stage, loss, rmse, mae, r2, smape``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylattice.constants import METRICS


def train_val_gap(run_log: DataFrame) -> DataFrame:
    """``gap_{metric}``: validation minus training per run and epoch."""

    def stage(name: str, suffix: str) -> DataFrame:
        return run_log.filter(F.col("stage") == name).select(
            "run_id", "epoch", *[F.col(m).alias(f"{m}_{suffix}") for m in METRICS]
        )

    joined = stage("train", "train").join(stage("val", "val"), ["run_id", "epoch"])
    return joined.select(
        "run_id", "epoch", *[(F.col(f"{m}_val") - F.col(f"{m}_train")).alias(f"gap_{m}") for m in METRICS]
    )


def best_epoch(run_log: DataFrame, metric: str = "loss") -> DataFrame:
    """Epoch of the smallest validation value, the earliest of equals."""
    rows = run_log.filter((F.col("stage") == "val") & F.col(metric).isNotNull())
    best = F.min(F.struct(F.col(metric), F.col("epoch"))).alias("b")
    return rows.groupBy("run_id").agg(best).select("run_id", "b.epoch", f"b.{metric}")


def epoch_thirds_summary(run_log: DataFrame, stage: str = "val") -> DataFrame:
    """Box statistics of each metric over the first, middle and last third of the epochs, for
    runs with at least six epochs in the stage."""
    rows = run_log.filter(F.col("stage") == stage)
    span = rows.groupBy("run_id").agg(
        F.min("epoch").alias("_e0"), F.floor(F.countDistinct("epoch") / 3).alias("_third"),
        F.countDistinct("epoch").alias("_n"),
    ).filter("_n >= 6")
    offset = F.col("epoch") - F.col("_e0")
    third = (
        F.when(offset < F.col("_third"), "start").when(offset < 2 * F.col("_third"), "middle")
        .otherwise("end")
    )
    long = rows.join(span, "run_id").withColumn("third", third).unpivot(
        ["run_id", "third"], METRICS, "metric", "v"
    )
    return long.filter("v is not null").groupBy("run_id", "third", "metric").agg(
        F.count("v").alias("n"), F.min("v").alias("low"),
        F.percentile("v", 0.25).alias("q1"), F.percentile("v", 0.5).alias("median"),
        F.percentile("v", 0.75).alias("q3"), F.max("v").alias("high"),
    )


def run_summary(run_log: DataFrame) -> DataFrame:
    """Last training row, last validation row and first test row of each run. Rows are ordered
    by line where the log was read from a file, else by epoch."""
    order = "line_no" if "line_no" in run_log.columns else "epoch"
    values = F.struct(*METRICS)
    picked = (
        run_log.filter(F.col("stage").isin("train", "val", "test"))
        .groupBy("run_id", "stage")
        .agg(F.max_by(values, order).alias("last"), F.min_by(values, order).alias("first"))
    )
    chosen = F.when(F.col("stage") == "test", F.col("first")).otherwise(F.col("last"))
    return picked.withColumn("m", chosen).select(
        "run_id", "stage", *[F.col(f"m.{m}").alias(m) for m in METRICS]
    )


def metric_correlation(run_log: DataFrame, stage: str) -> DataFrame:
    from skylattice.operators.stats import correlation_matrix

    return correlation_matrix(run_log.filter(F.col("stage") == stage), METRICS)

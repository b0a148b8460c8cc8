"""Audits of cleaned rows and station coverage."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from skylattice.constants import AUDIT_EXCLUDED_DIRS, CLEANING_EXCLUDED_DIRS, FILE_SUFFIX


def exclude_paths(
    df: DataFrame, mode: str = "cleaning", col: str = "path", root: str | None = None
) -> DataFrame:
    """Drop files in excluded folders. ``cleaning`` looks for the words in any folder name below
    ``root`` whatever the case, and for ``<digits>_old``; ``audit`` looks for them, and for the
    years before the study period, case-sensitively anywhere in the whole folder path."""
    folder = F.regexp_replace(F.col(col), r"/[^/]*$", "")
    if mode == "cleaning":
        if root:
            below = F.instr(folder, root.rstrip("/")) + len(root.rstrip("/"))
            folder = F.substr(folder, below)
        words = "|".join(w.lower() for w in CLEANING_EXCLUDED_DIRS)
        return df.filter(~F.lower(folder).rlike(words) & ~folder.rlike(r"\d+_old"))
    if mode == "audit":
        return df.filter(~folder.rlike("|".join(AUDIT_EXCLUDED_DIRS)))
    raise ValueError(f"unknown mode {mode!r}")


def file_name(col: str = "path") -> Column:
    return F.regexp_extract(F.col(col), r"([^/]+)$", 1)


def file_timestamp(col: str = "path") -> Column:
    """Hour a file name stands for, null where there is none (hour 24 included)."""
    stamp = F.regexp_extract(file_name(col), r"^(\d{10})" + FILE_SUFFIX.replace(".", r"\.") + "$", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyyMMddHH"))


def with_file_timestamp(df: DataFrame, col: str = "path") -> DataFrame:
    return df.withColumn("ts", file_timestamp(col))


def audit_filenames(df: DataFrame, col: str = "path") -> DataFrame:
    """``path, status``: ok, bad_hour (24 and above), bad_name or bad_date."""
    name = file_name(col)
    pattern = r"^\d{10}" + FILE_SUFFIX.replace(".", r"\.") + "$"
    hour = F.substring(name, 9, 2).try_cast("int")
    status = (
        F.when(~name.rlike(pattern), "bad_name")
        .when(hour >= 24, "bad_hour")
        .when(file_timestamp(col).isNull(), "bad_date")
        .otherwise("ok")
    )
    return df.select(F.col(col).alias("path"), status.alias("status"))


def cleaning_report(df: DataFrame, rules: Mapping[str, Column], keys: Iterable[str]) -> DataFrame:
    """Rows each rule drops, per key, applying the rules in order: a row counts for the first
    rule that rejects it. A rule is a column that is true for rows to keep."""
    first_failed = F.lit(None).cast("string")
    for name, keep in reversed(list(rules.items())):
        first_failed = F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)).otherwise(first_failed)
    return (
        df.withColumn("_failed", first_failed)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows_before"),
            *[F.count_if(F.col("_failed") == n).alias(f"dropped_{n}") for n in rules],
            F.count_if(F.col("_failed").isNull()).alias("rows_after"),
        )
    )


def station_coverage(obs: DataFrame, period: str = "none") -> DataFrame:
    """Share of the hourly snapshots each station appears in, overall or per day or month."""
    if period == "none":
        bucket = F.lit("all")
    elif period in ("day", "month"):
        bucket = F.date_format("ts", "yyyy-MM-dd" if period == "day" else "yyyy-MM")
    else:
        raise ValueError(f"unknown period {period!r}")
    seen = obs.select("station_id", "ts", bucket.alias("period"))
    totals = seen.groupBy("period").agg(F.countDistinct("ts").alias("snapshots"))
    present = seen.groupBy("period", "station_id").agg(F.countDistinct("ts").alias("present"))
    return present.join(totals, "period").select(
        "period", "station_id", "present", "snapshots",
        (F.col("present") / F.col("snapshots")).alias("coverage"),
    )

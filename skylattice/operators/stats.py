"""Normalisation parameters, histograms and correlations.

Parameter tables have one row per feature, so their size is bounded by the number of columns and
they may be broadcast whatever the data size.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from skylattice.constants import FEATURE_COLUMNS, TEMPORAL_FEATURES


def unpivot(df: DataFrame, ids: list[str], cols: Iterable[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, list(cols), name, value)


def _long(row: DataFrame, cols: list[str], parts: list[str]) -> DataFrame:
    """One aggregated row with ``{part}_{col}`` columns to one row per feature."""
    structs = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}_{c}").alias(p) for p in parts])
        for c in cols
    ]
    return row.select(F.inline(F.array(*structs)))


def fit_norm_params(
    df: DataFrame, cols: Iterable[str] = FEATURE_COLUMNS, keep: Column | None = None
) -> DataFrame:
    """``feature, mean, std`` (sample) in one pass; ``keep`` selects the training rows, such as
    ``year(ts) between 2016 and 2022``, and reaches the scan as a filter."""
    cols = list(cols)
    rows = df if keep is None else df.filter(keep)
    aggs = [F.avg(c).alias(f"mean_{c}") for c in cols]
    aggs += [F.stddev_samp(c).alias(f"std_{c}") for c in cols]
    return _long(rows.agg(*aggs), cols, ["mean", "std"])


def target_stats(df: DataFrame, cols: Iterable[str], eps: float = 1e-6) -> DataFrame:
    """Like ``fit_norm_params`` with the deviation floored at ``eps``."""
    stats = fit_norm_params(df, cols)
    return stats.withColumn(
        "std", F.when(F.col("std").isNotNull(), F.greatest("std", F.lit(float(eps))))
    )


def _wide(params: DataFrame, cols: list[str]) -> DataFrame:
    """Parameter rows as one row of ``_mean_{col}``, ``_std_{col}``."""
    aggs = []
    for c in cols:
        at = F.col("feature") == c
        aggs.append(F.max(F.when(at, F.col("mean"))).alias(f"_mean_{c}"))
        aggs.append(F.max(F.when(at, F.col("std"))).alias(f"_std_{c}"))
    return params.agg(*aggs)


def _with_params(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    # one row by construction of the aggregate
    return df.join(F.broadcast(_wide(params, cols)))


def _drop_params(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[f"_{p}_{c}" for c in cols for p in ("mean", "std")])


def normalize(
    df: DataFrame, params: DataFrame, cols: Iterable[str] = FEATURE_COLUMNS,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """(x - mean) / std for every listed feature that is not excluded."""
    cols = [c for c in cols if c in df.columns and c not in set(exclude)]
    scaled = {
        c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_std_{c}")) for c in cols
    }
    return _drop_params(_with_params(df, params, cols).withColumns(scaled), cols)


def denormalize(df: DataFrame, params: DataFrame, cols: Iterable[str]) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    restored = {c: F.col(c) * F.col(f"_std_{c}") + F.col(f"_mean_{c}") for c in cols}
    return _drop_params(_with_params(df, params, cols).withColumns(restored), cols)


def normalize_per_snapshot(
    df: DataFrame, cols: Iterable[str] = FEATURE_COLUMNS,
    exclude: Iterable[str] = (), by: str = "ts",
) -> DataFrame:
    """Each hour scaled by its own mean and deviation, a zero or undefined deviation counting as
    one. Aggregate and join rather than a window: a crowded hour combines map-side and its join
    partition can be split."""
    cols = [c for c in cols if c not in set(exclude)]
    aggs = [F.avg(c).alias(f"_mean_{c}") for c in cols]
    for c in cols:
        std = F.coalesce(F.stddev_samp(c), F.lit(0.0))
        aggs.append(F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"_std_{c}"))
    stats = df.groupBy(by).agg(*aggs)
    scaled = {c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}") for c in cols}
    return _drop_params(df.join(stats, by).withColumns(scaled), cols)


def histograms(df: DataFrame, cols: Iterable[str], bins: int = 50) -> DataFrame:
    """``feature, bin, low, high, n`` of equal-width bins over min..max, the last one closed."""
    cols = list(cols)
    limits = _long(
        df.agg(
            *[F.min(c).alias(f"lo_{c}") for c in cols],
            *[F.max(c).alias(f"hi_{c}") for c in cols],
        ),
        cols, ["lo", "hi"],
    )
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("x")
    # a constant column is binned over one unit around its value
    limits = limits.select(
        "feature",
        F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
    )
    width = (hi - lo) / F.lit(float(bins))
    index = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    long = unpivot(df.select(*cols), [], cols, "feature", "x").filter("x is not null")
    counted = (
        long.join(F.broadcast(limits), "feature")
        .groupBy("feature", "lo", "hi", index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counted, ["feature", "lo", "hi", "bin"], "left").select(
        "feature", "bin",
        (lo + width * F.col("bin")).alias("low"),
        (lo + width * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def partial_stats(df: DataFrame, cols: Iterable[str], by: Iterable[str]) -> DataFrame:
    """Mergeable state per key and feature: ``n, mean, m2`` (sum of squared deviations)."""
    long = unpivot(df.select(*by, *cols), list(by), cols, "feature", "x")
    return long.groupBy(*by, "feature").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        (F.var_pop("x") * F.count("x")).alias("m2"),
    )


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Combine ``partial_stats`` tables to ``feature, n, mean, std``, as if fitted in one pass."""
    cols = ["feature", "n", "mean", "m2"]
    states = parts[0].select(*cols)
    for part in parts[1:]:
        states = states.unionByName(part.select(*cols))
    states = states.filter("n > 0")
    totals = states.groupBy("feature").agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
    )
    shift = F.col("mean") - F.col("grand")
    return (
        states.join(F.broadcast(totals), "feature")
        .groupBy("feature", "total", "grand")
        .agg(F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"))
        .select(
            "feature",
            F.col("total").alias("n"),
            F.col("grand").alias("mean"),
            F.sqrt(F.try_divide(F.col("m2"), F.col("total") - 1)).alias("std"),
        )
    )


def correlation_matrix(df: DataFrame, vars: Iterable[str]) -> DataFrame:
    """``var_a, var_b, corr`` (Pearson) over rows with every variable present, in one pass."""
    vars = list(vars)
    pairs = list(combinations(vars, 2))
    rows = df.select(*vars).dropna(how="any")
    row = rows.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.corr(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)],
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append((x, y, F.col(f"_c{i}")))
    cells += [(v, v, F.when(F.col("_n") > 1, F.lit(1.0))) for v in vars]
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(x).alias("var_a"), F.lit(y).alias("var_b"), c.alias("corr"))
                    for x, y, c in cells
                ]
            )
        )
    )

"""Spatial tiles for snapshots too large for one task.

A snapshot is cut into slabs of equal station count by x and each slab into rows of equal count by
y, so a tile holds about the same number of stations however they cluster: the number asked for,
but no less than the root of the snapshot's, so that pairs of tiles do not outgrow the stations.
Every station is a candidate in its own tile only, unless a search names others ``around``. A search visits its own tile and those other tiles whose bounding
box its search region touches, and the partial results of one station are merged. The box test
runs on the tile table first, which has one row per tile, then on the stations of tiles that passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.operators import blocks

RESOLUTION = 512


def tile_size(n: Column, size: int, roots: float = 1.0) -> Column:
    """Stations in a tile of a snapshot of ``n``: no fewer than ``roots`` times the root of ``n``, as the
    tiles of a snapshot are compared in pairs and each costs a group of its own."""
    return F.greatest(F.lit(float(size)), F.sqrt(n) * F.lit(roots))


def _cuts(value: str) -> Column:
    return F.percentile_approx(value, [i / RESOLUTION for i in range(1, RESOLUTION)], 10000)


def _every(cuts: str, parts: str) -> Column:
    """The inner borders of ``parts`` equal shares out of the fine quantiles."""
    inner = F.filter(F.sequence(F.lit(0), F.col(parts) - 1), lambda i: i > 0)
    return F.transform(
        inner, lambda i: F.col(cuts)[F.floor(i * RESOLUTION / F.col(parts)).cast("int") - 1]
    )


def _share(value: str, borders: str) -> Column:
    return F.size(F.filter(borders, lambda b: b <= F.col(value)))


def assign_tiles(
    points: DataFrame, by: str = "ts", x: str = "px", y: str = "py", size: int = 512,
    roots: float = 1.0,
) -> DataFrame:
    """Add ``tile``, of about ``tile_size`` stations. The borders come from mergeable quantile
    sketches, combined map-side."""
    n = F.count(F.lit(1))
    slabs = (
        points.groupBy(by).agg(_cuts(x).alias("_cx"), n.alias("_n"))
        .withColumn("_size", tile_size(F.col("_n"), size, roots))
        .withColumn(
            "_slabs", F.least(F.ceil(F.sqrt(F.col("_n") / F.col("_size"))), F.lit(RESOLUTION)).cast("int")
        )
    )
    placed = points.join(
        slabs.select(by, "_size", _every("_cx", "_slabs").alias("_bx")), by
    ).withColumn("_slab", _share(x, "_bx")).drop("_bx")
    rows = placed.groupBy(by, "_slab").agg(
        _cuts(y).alias("_cy"), (n / F.max("_size")).alias("_full")
    ).withColumn("_rows", F.least(F.ceil("_full"), F.lit(RESOLUTION)).cast("int"))
    return (
        placed.join(rows.select(by, "_slab", _every("_cy", "_rows").alias("_by")), [by, "_slab"])
        .withColumn("tile", F.col("_slab") * RESOLUTION + _share(y, "_by"))
        .drop("_by", "_slab", "_size")
    )


def boxes(points: DataFrame, axes: list[str], *extra: Column, by: str = "ts") -> DataFrame:
    """One row per tile with ``lo_{axis}``, ``hi_{axis}`` of its stations."""
    aggs = [f(a).alias(f"{p}_{a}") for a in axes for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return points.groupBy(by, "tile").agg(*aggs, *extra)


def root_of_squares(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def gap_to_box(at: dict[str, Column]) -> Column:
    """Distance from a place to the box ``lo_*``, ``hi_*``; zero inside."""
    zero = F.lit(0.0)
    return root_of_squares(
        [F.greatest(F.col(f"lo_{a}") - v, v - F.col(f"hi_{a}"), zero) for a, v in at.items()]
    )


def tile_pairs(
    table: DataFrame, axes: list[str], reach: str, by: str = "ts", others: DataFrame | None = None,
    extra: dict[str, float] | None = None,
) -> DataFrame:
    """``home, tile`` and the box of ``tile``, for tiles (of ``others`` if given) within the largest
    reach of ``home``, and in each ``extra`` value at most that far apart."""
    extra = extra or {}
    every = [*axes, *extra]
    home = table.select(
        by, F.col("tile").alias("home"), F.col(reach).alias("_reach"),
        *[F.col(f"{p}_{a}").alias(f"_{p}_{a}") for a in every for p in ("lo", "hi")],
    )
    zero = F.lit(0.0)
    gaps = {
        a: F.greatest(F.col(f"lo_{a}") - F.col(f"_hi_{a}"), F.col(f"_lo_{a}") - F.col(f"hi_{a}"), zero)
        for a in every
    }
    near = root_of_squares([gaps[a] for a in axes]) <= F.col("_reach")
    for a, most in extra.items():
        near = near & (gaps[a] <= F.lit(float(most)))
    box = [f"{p}_{a}" for a in every for p in ("lo", "hi")]
    return (
        home.join((table if others is None else others).select(by, "tile", *box), by)
        .filter((F.col("home") != F.col("tile")) & near)
        .select(by, "home", "tile", *box)
    )


def visits(
    points: DataFrame, pairs: DataFrame, axes: list[str], reach: Column, by: str = "ts",
    extra: dict[str, float] | None = None,
) -> DataFrame:
    """The stations (``tile`` is their home) that search in another tile, ``tile`` now being the
    visited one. ``extra`` as in ``tile_pairs``."""
    cols = [c for c in points.columns if c != "tile"]
    near = gap_to_box({a: F.col(a) for a in axes}) <= reach
    for a, most in (extra or {}).items():
        near = near & (gap_to_box({a: F.col(a)}) <= F.lit(float(most)))
    return (
        points.withColumnRenamed("tile", "home").join(pairs, [by, "home"]).filter(near)
        .select(*cols, "home", "tile")
    )


def search(
    points: DataFrame, visitors: DataFrame | None, fn: blocks.BlockFunction, schema: str,
    by: str = "ts", own: bool = True, around: DataFrame | None = None,
) -> DataFrame:
    """``fn(queries, candidates)`` in every tile: its stations and those ``around`` it are the
    candidates, its stations (with ``own``) and the visitors are the queries. A function that gives
    its rows in several pieces has them leave the task one by one."""
    cols = [c for c in points.columns if c != "tile"]
    rows = points.select(
        *cols, F.col("tile").alias("home"), "tile", F.lit(own).alias("_query"),
        F.lit(True).alias("_candidate"),
    )
    for others, searching in ((visitors, True), (around, False)):
        if others is not None:
            rows = rows.unionByName(
                others.select(
                    *cols, "home", "tile", F.lit(searching).alias("_query"),
                    F.lit(not searching).alias("_candidate"),
                )
            )
    ddl = f"{by} {points.schema[by].dataType.simpleString()}, {schema}"
    arrow = blocks.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        stations = blocks.to_stations(table.drop_columns([by, "tile"]))
        as_query, as_candidate = (stations.pop(c).astype(bool) for c in ("_query", "_candidate"))
        out = fn(blocks.take(stations, as_query), blocks.take(stations, as_candidate))
        for part in [out] if isinstance(out, dict) else out:
            yield from blocks.to_table(part, arrow, **{by: table.column(by)[0]}).to_batches()

    return blocks.spread_evenly(rows, by, "tile").groupBy(by, "tile").applyInArrow(run, ddl)

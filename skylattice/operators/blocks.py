"""Geometry inside snapshots without emitting station pairs.

A snapshot is one hour of stations. Distances between its stations are worked out in numpy inside
a task and only results leave it. A snapshot of at most ``MAX_BLOCK`` stations is one group. Larger
ones go through spatial tiles (``tiles``), each snapshot by its own size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylattice.session import materialize

MAX_BLOCK = 1024

Stations = dict[str, np.ndarray]
BlockFunction = Callable[[Stations, Stations], Stations | Iterator[Stations]]


def by_size(
    points: DataFrame, by: str, max_block: int,
    whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``whole`` of the snapshots with at most ``max_block`` rows together with ``cut`` of the
    others. Both give the same rows; only the crowded snapshots pay for being cut."""
    sizes = points.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    crowded = materialize(sizes.filter(F.col("_n") > max_block).select(by))
    if crowded.isEmpty():
        return whole(points)
    few = whole(points.join(crowded, by, "left_anti"))
    return few.unionByName(cut(materialize(points.join(crowded, by, "left_semi"))))


def to_stations(table: pa.Table) -> Stations:
    """Column arrays ordered by station name."""
    arrays = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.argsort(arrays["station_id"], kind="stable")
    return {c: v[order] for c, v in arrays.items()}


def take(stations: Stations, rows: np.ndarray) -> Stations:
    return {c: v[rows] for c, v in stations.items()}


def to_table(out: Stations, schema: pa.Schema, **constants) -> pa.Table:
    n = len(next(iter(out.values())))
    arrays = [
        pa.repeat(constants[f.name].cast(f.type), n) if f.name not in out
        else out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
        for f in schema
    ]
    return pa.Table.from_arrays(arrays, schema=schema)


_ARROW = {
    "string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(),
    "timestamp": pa.timestamp("us", tz="UTC"), "timestamp_ntz": pa.timestamp("us"),
    "date": pa.date32(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string of the types above."""
    pairs = [part.split() for part in ddl.split(",")]
    return pa.schema([(name, _ARROW[kind]) for name, kind in pairs])


def spread_evenly(points: DataFrame, *keys: str) -> DataFrame:
    """One exchange on the keys with a fixed number of tasks: a snapshot is few bytes but much
    arithmetic, so merging small partitions by size would leave cores idle."""
    spark = points.sparkSession
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    return points.repartition(tasks, *keys)


def per_snapshot(
    points: DataFrame, fn: BlockFunction, schema: str, by: str = "ts"
) -> DataFrame:
    """``fn(queries, candidates)`` with both sides the whole snapshot."""
    ddl = f"{by} {points.schema[by].dataType.simpleString()}, {schema}"
    arrow = arrow_schema(ddl)

    def run(table: pa.Table) -> pa.Table:
        stations = to_stations(table.drop_columns([by]))
        return to_table(fn(stations, stations), arrow, **{by: table.column(by)[0]})

    return spread_evenly(points, by).groupBy(by).applyInArrow(run, ddl)


def distances(queries: Stations, candidates: Stations) -> np.ndarray:
    """Straight-line km between Cartesian positions; infinite from a station to itself."""
    squares = np.zeros((len(queries["x"]), len(candidates["x"])))
    for axis in ("x", "y", "z"):
        gap = queries[axis][:, None] - candidates[axis][None, :]
        squares += gap * gap
    out = np.sqrt(squares)
    out[same_station(queries, candidates)] = np.inf
    return out


def same_station(queries: Stations, candidates: Stations) -> np.ndarray:
    names = np.concatenate([queries["station_id"], candidates["station_id"]])
    code = np.unique(names, return_inverse=True)[1]
    return code[:len(queries["station_id"]), None] == code[None, len(queries["station_id"]):]

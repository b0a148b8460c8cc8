"""The usual order of the operators from raw readings to normalised hourly graphs."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from skylattice.constants import BBOX, FEATURE_COLUMNS, OFFICIAL_SOURCES, TEMPORAL_FEATURES
from skylattice.operators import clean as cl, impute as im, stats as st, windows as wn
from skylattice.operators.features import build_features
from skylattice.operators.graph import Graph, GraphOptions, build_graph
from skylattice.operators.quality import cleaning_report
from skylattice.session import materialize

FILE_ORDER = ("path", "line_no")


def clean_readings(
    raw: DataFrame, sources: Iterable[str] = OFFICIAL_SOURCES, first_year: int = 2016,
    impute_wind_dir: bool = False, order: Iterable[str] = FILE_ORDER,
) -> DataFrame:
    """Text readings to cleaned ones. Years before ``first_year`` only serve as neighbours, and
    so do files rejected for a missing pressure column."""
    typed = materialize(im.typed_readings(cl.filter_sources(raw, sources)))
    wanted = [*im.DEFAULT_VARS, *(["wind_dir"] if impute_wind_dir else [])]
    kept = cl.select_canonical(typed).filter(F.year("ts") >= first_year)
    filled = im.rain_and_imputation(
        cl.drop_empty_rows(kept), wanted, raw=im.first_readings(typed, *order)
    )
    return cl.clip_ranges(cl.drop_incomplete(filled))


def row_rules() -> dict:
    """What ``graph_rows`` asks of a row, in its order: columns that are true for rows to keep."""
    inside = F.lit(True)
    for name, (low, high) in BBOX.items():
        inside = inside & F.col(name).between(low, high)
    return {
        "position": F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("alt").isNotNull(),
        "bbox": inside,
        "zero_humidity": F.col("humidity").isNull() | (F.col("humidity") != 0),
    }


def graph_row_report(cleaned: DataFrame, keys: Iterable[str] = ("day",)) -> DataFrame:
    """How many cleaned readings of each day each rule of ``graph_rows`` drops."""
    return cleaning_report(cleaned.withColumn("day", F.to_date("ts")), row_rules(), list(keys))


def graph_rows(cleaned: DataFrame, order: Iterable[str] = FILE_ORDER) -> DataFrame:
    """Cleaned readings that can be nodes: one per station and hour, inside the study area, with
    humidity, at least two an hour. The first row of a station counts even if a later filter
    then drops it."""
    first = cl.dedupe_stations(cl.require_position(cleaned), *order)
    inside = cl.drop_zero_humidity(cl.within_bbox(first))
    return cl.min_stations(materialize(cl.wind_to_ms(inside)))


def training_params(
    cleaned: DataFrame, first_year: int = 2016, last_year: int = 2022
) -> DataFrame:
    """Normalisation over all cleaned rows of the training years, graph node or not."""
    years = F.year("ts").between(first_year, last_year)
    return st.fit_norm_params(build_features(cl.wind_to_ms(cleaned)), FEATURE_COLUMNS, years)


def hourly_graphs(
    cleaned: DataFrame, params: DataFrame | None = None, options: GraphOptions = GraphOptions(),
    exclude_temporal: bool = False, order: Iterable[str] = FILE_ORDER,
) -> Graph:
    """Graphs on normalised features, with global parameters or, without them, per hour."""
    rows = build_features(graph_rows(cleaned, order))
    exclude = TEMPORAL_FEATURES if exclude_temporal else ()
    if params is None:
        scaled = st.normalize_per_snapshot(rows, FEATURE_COLUMNS, exclude)
    else:
        scaled = st.normalize(rows, params, FEATURE_COLUMNS, exclude)
    return build_graph(scaled, options)


class Sequences(NamedTuple):
    index: DataFrame
    nodes: DataFrame
    edges: DataFrame


def hourly_sequences(
    graph: Graph, cols: Iterable[str] = FEATURE_COLUMNS, window: int = 48, stride: int = 12,
    horizon: int = 6, chunk_size: int = 50,
) -> Sequences:
    """From hourly graphs to chunked sequences: the station index, the station rows of every step
    with absent stations marked, and the edges of every step by index."""
    index = materialize(wn.node_index(graph.nodes))
    runs = wn.sequence_id(wn.sliding_windows(graph.nodes, window, stride, horizon))
    chunked = materialize(wn.chunk_sequences(runs, chunk_size))
    return Sequences(
        index, wn.densify(chunked, graph.nodes, index, cols),
        wn.sequence_edges(chunked, graph.edges, index),
    )

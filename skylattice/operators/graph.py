"""Station graphs: one set of nodes and directed edges per hour."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skylattice.constants import EARTH_RADIUS_KM, EDGE_ATTRIBUTES, EDGE_DIFFS, HAVERSINE_EPS
from skylattice.functions.geodesy import bearing_deg, haversine_km, to_cartesian
from skylattice.operators import blocks, tiles
from skylattice.operators.delaunay import EDGE_SCHEMA, delaunay_edges
from skylattice.operators.pairs import pairs_of, pairs_within, parts_of, straight_km
from skylattice.operators.quantile import distance_quantile
from skylattice.session import materialize, release

SIGNED = [*EDGE_DIFFS, "bearing_sin", "bearing_cos"]
ROUND_UP = 1.0 + 1e-9


def positions(nodes: DataFrame, by: str = "ts") -> DataFrame:
    x, y, z = to_cartesian("lat", "lon", "alt")
    return nodes.select(
        by, "station_id", F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"), F.col("alt").cast("double").alias("alt"),
        x.alias("x"), y.alias("y"), z.alias("z"),
    )


SEARCH_AXES = ["x", "y", "z"]


def _tiled(at: DataFrame, by: str, max_block: int) -> DataFrame:
    return tiles.assign_tiles(at, by, "lon", "lat", max(1, max_block // 2))


def _search_within(
    at: DataFrame, fn: blocks.BlockFunction, schema: str, by: str, own: bool = True
) -> DataFrame:
    """``fn`` on tiled positions, each station also searching the tiles within its ``reach``."""
    table = tiles.boxes(at, SEARCH_AXES, F.max("reach").alias("reach"), by=by)
    pairs = tiles.tile_pairs(materialize(table), SEARCH_AXES, "reach", by)
    visitors = tiles.visits(at, pairs, SEARCH_AXES, F.col("reach"), by)
    return tiles.search(at, visitors, fn, schema, by, own)


def _reach_block(queries: blocks.Stations, candidates: blocks.Stations) -> Iterator[blocks.Stations]:
    """Pairs within the reach of the query, given in strips of queries that bound the matrix and the
    pairs held at once."""
    step = max(1, STRIP // max(1, len(candidates["x"])))
    for low in range(0, len(queries["x"]), step):
        some = blocks.take(queries, np.arange(low, min(low + step, len(queries["x"]))))
        dist = blocks.distances(some, candidates)
        yield _pairs_within(some, candidates, dist, some["reach"])


STRIP = 1 << 20
PAIR_SCHEMA = "src string, dst string, alt_diff_km double, km double"


def _pairs_within(
    queries: blocks.Stations, candidates: blocks.Stations, dist: np.ndarray, radius: np.ndarray
) -> blocks.Stations:
    near = np.flatnonzero(dist <= radius[:, None])
    src, dst = np.divmod(near, max(1, dist.shape[1]))
    return {
        "src": pa.array(queries["station_id"], pa.string()).take(pa.array(src)),
        "dst": pa.array(candidates["station_id"], pa.string()).take(pa.array(dst)),
        "alt_diff_km": np.abs(queries["alt"][src] - candidates["alt"][dst]) / 1000.0,
        "km": dist.ravel()[near],
    }


def _kth(dist: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest other station, the farthest one if there are fewer."""
    ordered = np.sort(dist, axis=1)
    present = np.isfinite(ordered).sum(axis=1)
    column = np.clip(np.minimum(k, present) - 1, 0, None)
    out = ordered[np.arange(len(ordered)), column]
    out[present == 0] = -1.0
    return out


def adaptive_radius_edges(
    nodes: DataFrame, k: int = 4, scale: float = 1.3, by: str = "ts",
    max_block: int = blocks.MAX_BLOCK,
) -> DataFrame:
    """Directed edges to every station within ``scale`` times the distance to the k-th nearest."""
    def near(queries: blocks.Stations, candidates: blocks.Stations) -> blocks.Stations:
        dist = blocks.distances(queries, candidates)
        return _pairs_within(queries, candidates, dist, _kth(dist, k) * scale)

    def whole(at: DataFrame) -> DataFrame:
        return blocks.per_snapshot(at, near, EDGE_SCHEMA, by)

    # the k-th nearest of the own tile bounds the search, the real one is among what it finds
    def bound(queries: blocks.Stations, candidates: blocks.Stations) -> blocks.Stations:
        names = [c for c in queries if c != "home"]
        step = max(1, STRIP // max(1, len(candidates["x"])))
        reach = np.empty(len(queries["x"]))
        for low in range(0, len(reach), step):
            rows = np.arange(low, min(low + step, len(reach)))
            dist = blocks.distances(blocks.take(queries, rows), candidates)
            dist.partition(min(k, dist.shape[1]) - 1, axis=1)
            reach[rows] = dist[:, k - 1] if dist.shape[1] >= k else np.inf
        out = {c: queries[c] for c in names}
        out["tile"] = queries["home"]
        out["reach"] = reach * max(scale, 1.0) * ROUND_UP
        return out

    def cut(at: DataFrame) -> DataFrame:
        fields = "station_id string, lat double, lon double, alt double, x double, y double, z double"
        tiled = materialize(_tiled(at, by, max_block))
        reaching = materialize(
            tiles.search(tiled, None, bound, fields + ", tile int, reach double", by)
        )
        found = materialize(_search_within(reaching, _reach_block, PAIR_SCHEMA, by))
        rank = F.row_number().over(Window.partitionBy(by, "src").orderBy("km"))
        radius = (
            found.select(by, "src", "km").withColumn("_rank", rank).filter(F.col("_rank") <= k)
            .groupBy(by, "src").agg((F.max("km") * F.lit(scale)).alias("_radius"))
        )
        return found.join(radius, [by, "src"]).filter(F.col("km") <= F.col("_radius")).select(
            by, "src", "dst", "alt_diff_km"
        )

    return blocks.by_size(positions(nodes, by), by, max_block, whole, cut)


DIAMETER_KM = 2.0 * (EARTH_RADIUS_KM + 100.0)


def _with_self(queries: blocks.Stations, candidates: blocks.Stations) -> np.ndarray:
    dist = blocks.distances(queries, candidates)
    dist[np.isinf(dist)] = 0.0
    return dist


def radius_at_quantile(
    nodes: DataFrame, quantile: float, by: str = "ts", max_block: int = blocks.MAX_BLOCK
) -> DataFrame:
    """``ts, radius``: exact quantile, linearly interpolated, of the full distance matrix of the
    snapshot with its zero diagonal. Crowded snapshots open few of their pairs (``quantile``)."""
    def quantile_of(queries: blocks.Stations, candidates: blocks.Stations) -> blocks.Stations:
        return {"radius": np.array([np.quantile(_with_self(queries, candidates), quantile)])}

    return blocks.by_size(
        positions(nodes, by), by, max_block,
        lambda at: blocks.per_snapshot(at, quantile_of, "radius double", by),
        lambda at: distance_quantile(at, quantile, DIAMETER_KM, by, max_block),
    )


def radius_edges(
    nodes: DataFrame, quantile: float = 0.65, by: str = "ts", max_block: int = blocks.MAX_BLOCK
) -> DataFrame:
    """All pairs within the snapshot's distance quantile: a fixed share of all pairs, so the result
    grows with the square of a snapshot. ``radius_km_edges`` is the form for crowded ones."""
    def near(queries: blocks.Stations, candidates: blocks.Stations) -> blocks.Stations:
        dist = blocks.distances(queries, candidates)
        matrix = np.where(np.isinf(dist), 0.0, dist)
        radius = np.full(len(dist), np.quantile(matrix, quantile) * ROUND_UP)
        return _pairs_within(queries, candidates, dist, radius)

    def cut(at: DataFrame) -> DataFrame:
        radius = distance_quantile(at, quantile, DIAMETER_KM, by, max_block).select(
            by, (F.col("radius") * F.lit(ROUND_UP)).alias("reach")
        )
        return pairs_within(at.join(radius, by), by, max_block)

    return blocks.by_size(
        positions(nodes, by), by, max_block,
        lambda at: blocks.per_snapshot(at, near, EDGE_SCHEMA, by), cut,
    )


def radius_km_edges(
    nodes: DataFrame, km: float, by: str = "ts", max_block: int = blocks.MAX_BLOCK
) -> DataFrame:
    """Directed edges between stations at most ``km`` apart in a straight line. A station is only
    compared with its own tile and those within reach."""
    def near(queries: blocks.Stations, candidates: blocks.Stations) -> blocks.Stations:
        dist = blocks.distances(queries, candidates)
        return _pairs_within(queries, candidates, dist, np.full(len(dist), float(km)))

    def cut(at: DataFrame) -> DataFrame:
        return pairs_within(at.withColumn("reach", F.lit(float(km))), by, max_block)

    return blocks.by_size(
        positions(nodes, by), by, max_block,
        lambda at: blocks.per_snapshot(at, near, EDGE_SCHEMA, by), cut,
    )


def max_alt_filter(edges: DataFrame, km: float = 0.15) -> DataFrame:
    return edges.filter(F.col("alt_diff_km") <= km)


#: Slack in km that covers how rounding tells near stations apart in a search on the sphere.
CHORD_SLACK = 1e-6


def _nearest_level(
    lonely: blocks.Stations, candidates: blocks.Stations, max_km: float, max_alt_km: float
) -> blocks.Stations:
    """``dst, alt_diff_km, km`` of the nearest other station within the limits, the first by name of
    equally near ones, and the straight line to it on the sphere; km is infinite if there is none."""
    if not len(candidates["lat"]):
        none = np.full(len(lonely["lat"]), np.inf)
        return {"dst": np.full(len(none), None, object), "alt_diff_km": none, "km": none, "chord": none}
    lat1, lon1 = (np.radians(lonely[c])[:, None] for c in ("lat", "lon"))
    lat2, lon2 = (np.radians(candidates[c])[None, :] for c in ("lat", "lon"))
    a = (np.sin((lat2 - lat1) / 2) ** 2
         + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2 + HAVERSINE_EPS)
    km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
    gap = np.abs(lonely["alt"][:, None] - candidates["alt"][None, :]) / 1000.0
    km[~((km <= max_km) & (gap <= max_alt_km)) | blocks.same_station(lonely, candidates)] = np.inf
    rows, best = np.arange(len(km)), km.argmin(axis=1)
    out = {"dst": candidates["station_id"][best], "alt_diff_km": gap[rows, best], "km": km[rows, best]}
    out["chord"] = 2 * EARTH_RADIUS_KM * np.sqrt(np.minimum(a[rows, best], 1.0))
    return out


def rescue_isolated(
    nodes: DataFrame, edges: DataFrame, max_km: float = 80.0, max_alt_km: float = 0.15,
    by: str = "ts", max_block: int = blocks.MAX_BLOCK,
) -> DataFrame:
    """Edges both ways between each station without an edge and its nearest other station within
    the distance and altitude limits."""
    touched = edges.select(by, F.explode(F.array("src", "dst")).alias("station_id")).distinct()
    linked = positions(nodes, by).drop(*SEARCH_AXES).join(
        touched.withColumn("_linked", F.lit(True)), [by, "station_id"], "left"
    )
    marked = linked.withColumn("isolated", F.col("_linked").isNull()).drop("_linked")

    def best_of(lonely: blocks.Stations, candidates: blocks.Stations) -> blocks.Stations:
        """The nearest candidate of each station, in strips that bound the matrices; no number if none."""
        step = max(1, STRIP // max(1, len(candidates["lat"])))
        parts = [_nearest_level(blocks.take(lonely, slice(low, low + step)), candidates, max_km, max_alt_km)
                 for low in range(0, max(1, len(lonely["lat"])), step)]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def nearest(queries: blocks.Stations, candidates: blocks.Stations) -> blocks.Stations:
        lonely = blocks.take(queries, queries["isolated"].astype(bool))
        best = best_of(lonely, candidates)
        best["src"] = lonely["station_id"]
        return blocks.take(best, np.isfinite(best["km"]))

    # the nearest of the own tile bounds the search in others
    def at_home(queries: blocks.Stations, candidates: blocks.Stations) -> blocks.Stations:
        lonely = blocks.take(queries, queries["isolated"].astype(bool))
        best = best_of(lonely, candidates)
        none = ~np.isfinite(best["km"])
        best["reach"] = np.where(none, max_km, np.minimum(best.pop("chord"), max_km)) * ROUND_UP + CHORD_SLACK
        best["km"] = pa.array(best["km"], mask=none)
        return {**{c: lonely[c] for c in lonely if c != "home"}, "tile": lonely["home"], **best}

    def cut(some: DataFrame) -> DataFrame:
        # a station without a position has no nearest one, and its box would have no bounds
        placed = some.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("lat", "lon", "alt")))
        slim = materialize(_tiled(placed, by, max_block))
        release(some)
        on_sphere = to_cartesian("lat", "lon", F.lit(0.0))
        tiled = slim.withColumns(dict(zip(SEARCH_AXES, on_sphere, strict=True)))
        fields = ", ".join(f"{c} {k}" for c, k in tiled.dtypes if c != by)
        lonely = materialize(tiles.search(
            tiled, None, at_home, f"{fields}, dst string, alt_diff_km double, km double, reach double", by
        ))
        # on the sphere without altitude a straight line is shorter than the arc
        level = [F.min("alt").alias("lo_alt"), F.max("alt").alias("hi_alt")]
        homes = tiles.boxes(lonely, SEARCH_AXES, F.max("reach").alias("reach"), *level, by=by)
        pairs = materialize(tiles.tile_pairs(
            homes, SEARCH_AXES, "reach", by, tiles.boxes(tiled, SEARCH_AXES, *level, by=by),
            extra={"alt": max_alt_km * 1000.0 * ROUND_UP},
        ))
        visitors = tiles.visits(
            lonely, pairs, SEARCH_AXES, F.col("reach"), by, extra={"alt": max_alt_km * 1000.0 * ROUND_UP}
        )
        elsewhere = tiles.search(slim, visitors, nearest, PAIR_SCHEMA, by, own=False)
        own = lonely.filter(F.col("km").isNotNull()).withColumnRenamed("station_id", "src")
        return (
            own.select(elsewhere.columns).unionByName(elsewhere)
            .groupBy(by, "src")
            .agg(F.min(F.struct("km", "dst", "alt_diff_km")).alias("best"))
            .select(by, "src", "best.dst", "best.alt_diff_km", "best.km")
        )

    found = blocks.by_size(
        marked, by, max_block, lambda some: blocks.per_snapshot(some, nearest, PAIR_SCHEMA, by), cut
    )
    there = F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return found.select(by, "alt_diff_km", F.inline(F.array(there, back))).select(
        by, "src", "dst", "alt_diff_km"
    ).distinct()


def edge_attributes(
    edges: DataFrame, nodes: DataFrame, dist_scale: float = 100.0, by: str = "ts",
    cartesian: bool = False,
) -> DataFrame:
    """The fourteen attributes of each edge from the feature rows of its two ends. Slope relates
    the difference in normalised altitude to the distance in km. ``cartesian`` measures the straight
    line between positions with altitude, where a bearing has no meaning and is zero."""
    cols = _end_columns(cartesian)

    def end(prefix: str, key: str) -> DataFrame:
        return nodes.select(
            by, F.col("station_id").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in cols]
        )

    attributes = _attributes("_a_", "_b_", F.col("_km"), dist_scale, cartesian)
    joined = (
        edges.join(end("_a_", "src"), [by, "src"])
        .join(end("_b_", "dst"), [by, "dst"])
        .withColumn("_km", _km_between("_a_", "_b_", cartesian))
    )
    carried = [c for c in edges.columns if c not in (by, "src", "dst")]
    return joined.select(
        by, "src", "dst", *[attributes[a].alias(a) for a in EDGE_ATTRIBUTES], *carried
    )


def _end_columns(cartesian: bool) -> list[str]:
    place = ["lat", "lon", *(["alt"] if cartesian else [])]
    return [*place, "alt_norm", *dict.fromkeys(EDGE_DIFFS.values())]


def _km_between(one: str, other: str, cartesian: bool) -> Column:
    if not cartesian:
        return haversine_km(f"{one}lat", f"{one}lon", f"{other}lat", f"{other}lon", HAVERSINE_EPS)
    a, b = (to_cartesian(*[f"{p}{c}" for c in ("lat", "lon", "alt")]) for p in (one, other))
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def _attributes(
    one: str, other: str, km: Column, dist_scale: float, cartesian: bool
) -> dict[str, Column]:
    """The attributes of the edge between two ends whose columns have these prefixes."""
    if cartesian:
        bearing_sin = bearing_cos = F.lit(0.0)
    else:
        bearing = F.radians(bearing_deg(f"{one}lat", f"{one}lon", f"{other}lat", f"{other}lon"))
        bearing_sin, bearing_cos = F.sin(bearing), F.cos(bearing)
    abs_alt = F.abs(F.col(f"{one}alt_norm") - F.col(f"{other}alt_norm"))
    return {
        "dist_scaled": km / F.lit(float(dist_scale)),
        "abs_alt": abs_alt,
        "slope": F.when(km > 0, abs_alt / km).otherwise(F.lit(0.0)),
        "bearing_sin": bearing_sin,
        "bearing_cos": bearing_cos,
        **{name: F.col(f"{one}{c}") - F.col(f"{other}{c}") for name, c in EDGE_DIFFS.items()},
    }


def reverse_edges(edges: DataFrame, by: str = "ts") -> DataFrame:
    """The edges and their flipped copies (``flipped`` true), signed attributes negated."""
    swapped = {"src": F.col("dst"), "dst": F.col("src")}
    swapped.update({c: -F.col(c) for c in SIGNED if c in edges.columns})
    copies = edges.select(
        *[swapped.get(c, F.col(c)).alias(c) for c in edges.columns],
        F.lit(True).alias("flipped"),
    )
    return edges.withColumn("flipped", F.lit(False)).unionByName(copies)


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def coalesce_edges(edges: DataFrame, how: str = "first", by: str = "ts") -> DataFrame:
    """One row per directed pair with the number of copies in ``multiplicity``. ``first`` keeps
    the attributes of a direct edge before those of a flipped one, ``sum`` adds all copies up."""
    attributes = [c for c in EDGE_ATTRIBUTES if c in edges.columns]
    copies = F.col("multiplicity") if "multiplicity" in edges.columns else F.lit(1)
    order = [F.col("flipped")] if "flipped" in edges.columns else []
    keys = [by, "src", "dst"]
    total = F.sum(copies).alias("multiplicity")
    if how == "sum":
        return edges.groupBy(*keys).agg(
            *[F.sum(F.col(c) * copies).alias(c) for c in attributes], total
        )
    if how != "first":
        raise ValueError(f"unknown way {how!r}")
    if not attributes:
        return edges.groupBy(*keys).agg(total)
    packed = F.struct(*order, *attributes)
    return (
        edges.groupBy(*keys).agg(F.min(packed).alias("_first"), total)
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in attributes], "multiplicity")
    )


def edge_weight(
    edges: DataFrame, decay: float = 75.0, scaled: bool = False, dist_scale: float = 100.0
) -> DataFrame:
    """exp(-km / decay); ``scaled`` divides the already scaled distance instead."""
    distance = F.col("dist_scaled") * F.lit(1.0 if scaled else float(dist_scale))
    return edges.withColumn("weight", F.exp(-distance / F.lit(float(decay))))


def graph_metadata(nodes: DataFrame, edges: DataFrame, by: str = "ts") -> DataFrame:
    counted = nodes.groupBy(by).agg(F.count(F.lit(1)).alias("nodes"))
    linked = edges.groupBy(by).agg(
        F.count(F.lit(1)).alias("directed"), F.avg("dist_scaled").alias("effective_radius")
    )
    pairs = F.floor(F.coalesce("directed", F.lit(0)) / 2).cast("long")
    return counted.join(linked, by, "left").select(
        by, "nodes", pairs.alias("edges"),
        (F.lit(2.0) * pairs / F.col("nodes")).alias("mean_degree"),
        F.coalesce("effective_radius", F.lit(0.0)).alias("effective_radius"),
    )


def neighbors(
    edges: DataFrame, station: str | None = None, k: int = 3, dist_scale: float = 100.0,
    by: str = "ts",
) -> DataFrame:
    """``ts, src, degree, rank, dst, km`` of the first k neighbours by name."""
    if station is not None:
        edges = edges.filter(F.col("src") == station)
    degree = edges.groupBy(by, "src").agg(F.count(F.lit(1)).alias("degree"))
    rank = F.row_number().over(Window.partitionBy(by, "src").orderBy("dst"))
    top = edges.select(
        by, "src", "dst", (F.col("dist_scaled") * F.lit(float(dist_scale))).alias("km"),
        rank.alias("rank"),
    ).filter(F.col("rank") <= k)
    return top.join(degree, [by, "src"])


def propagate(
    nodes: DataFrame, edges: DataFrame, cols: Iterable[str], weight: str = "dist_scaled",
    by: str = "ts",
) -> DataFrame:
    """Symmetric-normalised weighted sum over neighbours and the station itself (weight one),
    as ``nbr_{col}``."""
    cols = list(cols)
    degree = edges.groupBy(by, F.col("dst").alias("station_id")).agg(F.sum(weight).alias("_in"))
    rooted = nodes.select(by, "station_id", *cols).join(degree, [by, "station_id"], "left")
    rooted = rooted.withColumn("_deg", F.coalesce("_in", F.lit(0.0)) + F.lit(1.0)).drop("_in")
    scale = F.when(F.col("_deg") > 0, F.lit(1.0) / F.sqrt("_deg")).otherwise(F.lit(0.0))
    sent = rooted.select(
        by, F.col("station_id").alias("src"),
        *[(F.col(c) * scale).alias(f"_m_{c}") for c in cols],
    )
    received = (
        edges.select(by, "src", F.col("dst").alias("station_id"), F.col(weight).alias("_w"))
        .join(sent, [by, "src"])
        .groupBy(by, "station_id")
        .agg(*[F.sum(F.col(f"_m_{c}") * F.col("_w")).alias(f"_s_{c}") for c in cols])
    )
    mixed = {
        c: scale * (F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) + F.col(c) * scale) for c in cols
    }
    return rooted.join(received, [by, "station_id"], "left").select(
        by, "station_id", *[mixed[c].alias(f"nbr_{c}") for c in cols]
    )


@dataclass(frozen=True)
class GraphOptions:
    k: int = 4
    scale: float = 1.3
    dist_scale: float = 100.0
    multiscale_quantile: float | None = None
    max_alt_km: float = 0.15
    rescue_km: float = 80.0
    decay: float = 75.0
    scaled_weight: bool = False
    coalesce: str = "first"
    cartesian: bool = False
    max_block: int = blocks.MAX_BLOCK


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame


@dataclass(frozen=True)
class _Wide:
    """The edges within a quantile of the distances, a fixed share of all pairs, split in two: copies of
    the pairs that other edges join as well, and all others, which stay packed in ``parts``."""
    copies: DataFrame
    linked: DataFrame
    others: DataFrame


def _wide_edges(nodes: DataFrame, known: DataFrame, o: GraphOptions, by: str = "ts") -> _Wide:
    """Of ``radius_edges`` within the altitude limit, one row a pair and neither stored nor shuffled.
    ``known`` are the edges of other kinds within that limit."""
    ways = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src", "dst"), ("dst", "src"))]
    pairs = known.select(by, F.inline(F.array(*ways))).distinct()
    ends = _end_columns(o.cartesian)
    extra = [c for c in ends if c not in ("lat", "lon", "alt")]
    radius = materialize(
        radius_at_quantile(nodes, o.multiscale_quantile, by, o.max_block)
        .select(by, (F.col("radius") * F.lit(ROUND_UP)).alias("reach"))
    )
    at = positions(nodes, by).join(radius, by)

    def end(prefix: str, key: str) -> DataFrame:
        return at.select(
            by, F.col("station_id").alias(key), *([F.col("reach")] if key == "src" else []),
            *[F.col(c).alias(f"{prefix}{c}") for c in ("alt", *SEARCH_AXES)],
        )

    near = (straight_km("_a_", "_b_") <= F.col("reach")) & ~F.isnan("reach")
    copies = pairs.join(end("_a_", "src"), [by, "src"]).join(end("_b_", "dst"), [by, "dst"]).filter(
        near & (F.col("src") != F.col("dst"))
    ).select(by, "src", "dst", (F.abs(F.col("_a_alt") - F.col("_b_alt")) / 1000.0).alias("alt_diff_km"))

    joined = pairs.groupBy(by, F.col("src").alias("station_id")).agg(F.collect_list("dst").alias("_known"))
    rows = at.join(nodes.select(by, "station_id", *extra), [by, "station_id"]).join(
        joined, [by, "station_id"], "left"
    )
    kinds = {c: "double" for c in ends if c != "alt"}
    others = max_alt_filter(
        pairs_of(parts_of(rows, by, o.max_block, {**kinds, "_known": "array<string>"}), by), o.max_alt_km
    ).filter(F.col("_a__known").isNull() | ~F.array_contains("_a__known", F.col("dst")))
    # stations no other edge joins
    linked = others.filter(F.col("_a__known").isNull()).select(by, "src").distinct()
    return _Wide(max_alt_filter(copies, o.max_alt_km), linked, others.drop("_a__known", "_b__known"))


def _both_ways(edges: DataFrame, o: GraphOptions, by: str = "ts") -> DataFrame:
    """What ``edge_attributes``, ``reverse_edges`` and ``coalesce_edges`` make of pairs that occur once
    in each direction and carry both ends: each edge with its attributes and those of the other, flipped."""
    km = {p: _km_between(p, q, o.cartesian) for p, q in (("_a_", "_b_"), ("_b_", "_a_"))}
    named = edges.withColumns({f"_km{p}": c for p, c in km.items()})
    own = _attributes("_a_", "_b_", F.col("_km_a_"), o.dist_scale, o.cartesian)
    if o.coalesce == "sum":
        back = _attributes("_b_", "_a_", F.col("_km_b_"), o.dist_scale, o.cartesian)
        own = {c: own[c] - back[c] if c in SIGNED else own[c] + back[c] for c in EDGE_ATTRIBUTES}
    return named.select(
        by, "src", "dst", *[own[c].alias(c) for c in EDGE_ATTRIBUTES], F.lit(2).cast("long").alias("multiplicity")
    )


def build_graph(features: DataFrame, options: GraphOptions = GraphOptions()) -> Graph:
    """Nodes, weighted edges and per-hour metadata. Copies of an edge are counted before the
    attributes are joined on, so each directed pair is looked up once. Edges that only the wide scale
    has grow with the square of a snapshot: they are worked out whenever the edges are read."""
    o = options
    nodes = materialize(features)
    found = delaunay_edges(nodes, max_block=o.max_block).unionByName(
        adaptive_radius_edges(nodes, o.k, o.scale, max_block=o.max_block)
    )
    wide = None
    if o.multiscale_quantile is not None and _one_row_a_station(nodes):
        found = materialize(max_alt_filter(found, o.max_alt_km))
        wide = _wide_edges(nodes, found, o)
        found = found.unionByName(wide.copies)
    elif o.multiscale_quantile is not None:
        found = found.unionByName(
            radius_edges(nodes, o.multiscale_quantile, max_block=o.max_block)
        )
    base = materialize(
        max_alt_filter(found, o.max_alt_km).groupBy("ts", "src", "dst")
        .agg(F.count(F.lit(1)).alias("multiplicity"), F.first("alt_diff_km").alias("alt_diff_km"))
    )
    joined = base.select("ts", "src", "dst")
    if wide:
        joined = joined.unionByName(wide.linked.withColumn("dst", F.col("src")))
    rescued = rescue_isolated(
        nodes, joined, o.rescue_km, o.max_alt_km, max_block=o.max_block
    ).withColumn("multiplicity", F.lit(1).cast("long"))
    plain = base.withColumn("rescued", F.lit(False)).unionByName(
        rescued.withColumn("rescued", F.lit(True))
    )
    described = edge_attributes(plain, nodes, o.dist_scale, cartesian=o.cartesian)
    # a rescue already comes in both directions
    both = reverse_edges(described).filter(~(F.col("flipped") & F.col("rescued")))
    edges = coalesce_edges(drop_self_loops(both), o.coalesce)
    edges = materialize(edge_weight(edges, o.decay, o.scaled_weight, o.dist_scale))
    if wide:
        others = drop_self_loops(_both_ways(wide.others, o))
        edges = edges.unionByName(edge_weight(others, o.decay, o.scaled_weight, o.dist_scale))
    return Graph(nodes, edges, graph_metadata(nodes, edges))


def _one_row_a_station(nodes: DataFrame, by: str = "ts") -> bool:
    counts = nodes.groupBy(by, "station_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter((F.col("_n") > 1) | F.col("station_id").isNull()).isEmpty()

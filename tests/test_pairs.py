"""Pairs within a reach by Spark's own code, against brute force."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import graph as gr

HOURS = [datetime(2024, 1, 1, h) for h in range(3)]
SCHEMA = "ts timestamp, station_id string, lat double, lon double, alt double"


def crowd(ts, n, seed):
    """Half of the stations within a kilometre, some at one place, one without a position."""
    rng = np.random.default_rng(seed)
    lat, lon = 40 + rng.random(n) * 2, 1 + rng.random(n) * 2
    lat[: n // 2], lon[: n // 2] = 41 + rng.random(n // 2) * 0.01, 2 + rng.random(n // 2) * 0.01
    alt = rng.random(n) * 800
    same = n // 6
    lat[:same], lon[:same], alt[:same] = 41.0, 2.0, 100.0
    rows = [(ts, f"S{i:03d}", float(lat[i]), float(lon[i]), float(alt[i])) for i in range(n)]
    return [*rows, (ts, "nowhere", None, 2.0, 10.0)]


@pytest.fixture(scope="module")
def groups():
    return {HOURS[0]: crowd(HOURS[0], 230, 1), HOURS[1]: crowd(HOURS[1], 150, 2), HOURS[2]: crowd(HOURS[2], 5, 3)}


@pytest.fixture(scope="module")
def points(spark, groups):
    return spark.createDataFrame([r for g in groups.values() for r in g], SCHEMA).cache()


def distances(group):
    at = [r for r in group if r[2] is not None]
    lat, lon = np.radians([r[2] for r in at]), np.radians([r[3] for r in at])
    radius = 6371 + np.array([r[4] for r in at]) / 1000
    xyz = np.stack([radius * np.cos(lat) * np.cos(lon), radius * np.cos(lat) * np.sin(lon), radius * np.sin(lat)], 1)
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    return at, d


def brute(groups, reach):
    found = {}
    for ts, group in groups.items():
        at, d = distances(group)
        limit = reach(d)
        np.fill_diagonal(d, np.inf)
        for i, j in zip(*np.nonzero(d <= limit)):
            found[ts, at[i][1], at[j][1]] = pytest.approx(abs(at[i][4] - at[j][4]) / 1000.0)
    return found


def check(edges, want):
    rows = edges.collect()
    assert len(rows) == len(want)
    assert {(r.ts, r.src, r.dst): r.alt_diff_km for r in rows} == want
    # only the pairs of small snapshots pass through Python
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("GroupsInArrow") == 1


def test_radius_edges_of_crowded_snapshots(spark, points, groups):
    want = brute(groups, lambda d: np.quantile(d, 0.55) * (1 + 1e-9))
    check(gr.radius_edges(points.filter(F.col("lat").isNotNull()), 0.55, max_block=8), want)


def test_radius_km_edges_of_crowded_snapshots(spark, points, groups):
    check(gr.radius_km_edges(points, 30.0, max_block=100), brute(groups, lambda d: 30.0))


def test_radius_km_edges_in_many_tiles(spark, points, groups):
    check(gr.radius_km_edges(points, 30.0, max_block=4), brute(groups, lambda d: 30.0))


def rescued(group, linked, max_km, max_alt_km):
    """The nearest station within the limits of every station not ``linked``, both ways."""
    found = set()
    for _, a, lat, lon, alt in group:
        best = []
        for _, b, lat2, lon2, alt2 in group:
            if a in linked or a == b or lat is None or lat2 is None or abs(alt - alt2) / 1000 > max_alt_km:
                continue
            dlat, dlon = np.radians(lat2 - lat) / 2, np.radians(lon2 - lon) / 2
            h = np.sin(dlat) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lat2)) * np.sin(dlon) ** 2 + 1e-8
            best.append((2 * 6371.0 * np.arcsin(np.sqrt(h)), b))
        if best and min(best)[0] <= max_km:
            found |= {(a, min(best)[1]), (min(best)[1], a)}
    return found


@pytest.mark.parametrize("size", [1024, 64, 4])
def test_rescue_searches_no_farther_than_needed(spark, points, groups, size, monkeypatch):
    linked = {f"S{i:03d}" for i in range(0, 230, 3)}
    edges = spark.createDataFrame([(ts, a, a) for ts in HOURS for a in linked], "ts timestamp, src string, dst string")
    visitors = []

    def counted(*args, _visits=gr.tiles.visits, **kwargs):
        out = _visits(*args, **kwargs)
        visitors.append((out.count(), out.select("ts", "station_id").distinct().count()))
        return out

    monkeypatch.setattr(gr.tiles, "visits", counted)
    got = gr.rescue_isolated(points, edges, 300.0, 0.05, max_block=size).collect()
    want = {(ts, *e) for ts, g in groups.items() for e in rescued(g, linked, 300.0, 0.05)}
    assert len(got) == len(want)
    assert {(r.ts, r.src, r.dst) for r in got} == want
    # every tile lies within 300 km of every station, yet few are visited
    for visits, stations in visitors:
        assert visits <= 6 * stations


def graph_by_operators(nodes, o):
    """Every edge of a multiscale graph as a row of its own, one operator after the other."""
    found = gr.delaunay_edges(nodes).unionByName(gr.adaptive_radius_edges(nodes, o.k, o.scale))
    found = gr.max_alt_filter(found.unionByName(gr.radius_edges(nodes, o.multiscale_quantile)), o.max_alt_km)
    base = found.groupBy("ts", "src", "dst").agg(F.count(F.lit(1)).alias("multiplicity"), F.first("alt_diff_km").alias("alt_diff_km"))
    saved = gr.rescue_isolated(nodes, base, o.rescue_km, o.max_alt_km).withColumn("multiplicity", F.lit(1).cast("long"))
    plain = base.withColumn("rescued", F.lit(False)).unionByName(saved.withColumn("rescued", F.lit(True)))
    both = gr.reverse_edges(gr.edge_attributes(plain, nodes, cartesian=o.cartesian)).filter("NOT (flipped AND rescued)")
    return gr.edge_weight(gr.coalesce_edges(gr.drop_self_loops(both), o.coalesce))


@pytest.mark.parametrize("options", [
    {"coalesce": "sum"}, {"coalesce": "first", "max_block": 40, "cartesian": True}])
def test_wide_edges_of_a_graph_are_not_stored(spark, options, monkeypatch):
    rows = [(*r, float(i % 7), float(i % 11)) for i, r in enumerate(crowd(HOURS[0], 90, 5)[15:-1])]
    # one station too high for any edge, one for any but a rescue
    rows += [(HOURS[0], "T1", 40.5, 1.5, 5000.0, 1.0, 1.0), (HOURS[0], "T2", 43.9, 6.9, 5100.0, 1.0, 2.0)]
    nodes = spark.createDataFrame(rows, SCHEMA + ", u double, v double").withColumns(
        {"alt_norm": F.col("alt") / 100.0, **{c: F.col("u") * i + F.col("v")
                                             for i, c in enumerate(dict.fromkeys(gr.EDGE_DIFFS.values()))}})
    o = gr.GraphOptions(multiscale_quantile=0.55, rescue_km=900.0, **options)
    stored = []

    def counted(df, _materialize=gr.materialize):
        out = _materialize(df)
        if "multiplicity" in out.columns:
            stored.append(out.count())
        return out

    monkeypatch.setattr(gr, "materialize", counted)
    graph = gr.build_graph(nodes, o)
    key = lambda r: (r.src, r.dst)
    got, most = sorted(graph.edges.collect(), key=key), max(stored)
    want = sorted(graph_by_operators(nodes, o).collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    assert {"T1", "T2"} <= {r.src for r in got}
    for a, b in zip(got, want):
        assert a.multiplicity == b.multiplicity
        assert [a[c] for c in (*gr.EDGE_ATTRIBUTES, "weight")] == pytest.approx(
            [b[c] for c in (*gr.EDGE_ATTRIBUTES, "weight")], abs=1e-9)
    # what is stored is a few edges a station, the rest of the pairs is worked out when read
    assert most < len(want) * 0.7
    assert graph.meta.collect()[0].edges == len(want) // 2

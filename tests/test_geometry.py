"""Snapshot geometry against brute force, whole and cut into small blocks."""

from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import delaunay, graph as gr, grid as gd, tiles
from skylattice.operators.delaunay import delaunay_edges, delaunay_triangles

HOURS = [datetime(2024, 1, 1, h) for h in range(2)]


def stations(n, seed, clustered=False):
    rng = np.random.default_rng(seed)
    lat, lon = 40 + rng.random(n) * 2, 1 + rng.random(n) * 2
    if clustered:
        lat[: n // 2] = 41 + rng.random(n // 2) * 0.01
        lon[: n // 2] = 2 + rng.random(n // 2) * 0.01
    return [(f"S{i:03d}", float(lat[i]), float(lon[i]), float(rng.random() * 800), float(rng.random()))
            for i in range(n)]


@pytest.fixture(scope="module")
def layers():
    return {HOURS[0]: stations(60, 1), HOURS[1]: stations(45, 2, clustered=True)}


@pytest.fixture(scope="module")
def points(spark, layers):
    rows = [(ts, *s) for ts, group in layers.items() for s in group]
    return spark.createDataFrame(
        rows, "ts timestamp, station_id string, lat double, lon double, alt double, v double").cache()


def circle(a, b, c):
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
    uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return a[0] + ux, a[1] + uy, ux * ux + uy * uy


def brute_triangles(group, lat0=41.7):
    shrink = np.cos(np.radians(lat0))
    at = {s[0]: (s[2] * shrink, s[1]) for s in group}
    xs = np.array([p[0] for p in at.values()])
    ys = np.array([p[1] for p in at.values()])
    found = set()
    for t in combinations(at, 3):
        x, y, r2 = circle(*[at[k] for k in t])
        inside = (xs - x) ** 2 + (ys - y) ** 2 < r2 * (1 - 1e-9)
        if not inside.any():
            found.add(t)
    return found


def cartesian(group):
    lat, lon = np.radians([s[1] for s in group]), np.radians([s[2] for s in group])
    radius = 6371 + np.array([s[3] for s in group]) / 1000
    xyz = np.stack([radius * np.cos(lat) * np.cos(lon), radius * np.cos(lat) * np.sin(lon),
                    radius * np.sin(lat)], axis=1)
    return np.linalg.norm(xyz[:, None] - xyz[None], axis=2)


def edge_set(df):
    return {(r.ts, r.src, r.dst) for r in df.collect()}


SIZES = [1024, 16]


@pytest.mark.parametrize("size", SIZES)
def test_delaunay(spark, points, layers, size):
    triangles = {(ts, *sorted((r.a, r.b, r.c))) for r in
                 delaunay_triangles(points, max_block=size).collect() for ts in [r.ts]}
    want = {(ts, *t) for ts, g in layers.items() for t in brute_triangles(g)}
    assert triangles == want
    edges = edge_set(delaunay_edges(points, max_block=size))
    sides = {(ts, a, b) for ts, *t in want for a, b in combinations(t, 2)}
    assert edges == sides | {(ts, b, a) for ts, a, b in sides}


def test_delaunay_degenerate(spark):
    rows = [("S1", 0.0, 0.0), ("S2", 0.0, 1.0), ("S3", 1.0, 0.0), ("S4", 1.0, 1.0), ("S5", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "station_id string, lat double, lon double").withColumns(
        {"ts": F.lit(HOURS[0]), "alt": F.lit(0.0)})
    sides = {(r.src, r.dst) for r in delaunay_edges(df, lat0=0.0).collect() if r.src < r.dst}
    # the square is cut from its first corner, and of two stations at one place the first stands for both
    assert sides == {("S1", "S2"), ("S1", "S3"), ("S2", "S4"), ("S3", "S4"), ("S1", "S4")}


def lattice(n, seed):
    """Stations on crossings of whole degrees, names in random order."""
    places = [(float(y), float(x)) for y in range(n) for x in range(n)]
    names = np.random.default_rng(seed).permutation(len(places))
    return [(f"S{k:03d}", *p, 0.0, p[0] + 2 * p[1]) for k, p in zip(names, places)]


@pytest.mark.parametrize("size", [1024, 6])
@pytest.mark.parametrize("lat0", [0.0, 41.7])
def test_lattice_is_triangulated_whole(spark, size, lat0):
    n = 5
    rows = [(HOURS[0], *s) for s in lattice(n, 4)] + [(HOURS[1], f"L{i}", 1.0, float(i), 0.0, 1.0) for i in range(7)]
    df = spark.createDataFrame(rows, "ts timestamp, station_id string, lat double, lon double, alt double, v double")
    edges = edge_set(delaunay_edges(df, max_block=size, lat0=lat0))
    assert all((ts, b, a) in edges for ts, a, b in edges)
    hull = 4 * (n - 1)
    assert sum(ts == HOURS[0] for ts, _, _ in edges) == 2 * (3 * n * n - 3 - hull)
    assert sum(ts == HOURS[1] for ts, _, _ in edges) == 2 * 6
    triangles = delaunay_triangles(df, max_block=size, lat0=lat0).collect()
    assert len(triangles) == 2 * (n - 1) ** 2
    cells = gd.interp_linear(df.filter(F.col("ts") == HOURS[0]), "v", 9, margin=0.0, max_block=size).collect()
    assert len(cells) == 81
    for r in cells:
        assert r.value == pytest.approx((r.row + 2 * r.col) * (n - 1) / 8)


@pytest.mark.parametrize("size", SIZES)
def test_adaptive_radius(spark, points, layers, size):
    want = set()
    for ts, g in layers.items():
        d = cartesian(g)
        np.fill_diagonal(d, np.inf)
        radius = np.sort(d, axis=1)[:, 3] * 1.3
        want |= {(ts, g[i][0], g[j][0]) for i, j in zip(*np.nonzero(d <= radius[:, None]))}
    assert edge_set(gr.adaptive_radius_edges(points, max_block=size)) == want


def test_adaptive_radius_with_few_stations(spark, points):
    few = points.filter("station_id in ('S001', 'S002', 'S003')")
    assert len(edge_set(gr.adaptive_radius_edges(few))) == 12


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("quantile", [0.1, 0.55])
def test_radius_quantile(spark, points, layers, size, quantile):
    got = {r.ts: r.radius for r in gr.radius_at_quantile(points, quantile, max_block=size).collect()}
    want = {ts: np.quantile(cartesian(g), quantile) for ts, g in layers.items()}
    assert got == {ts: pytest.approx(v, rel=1e-9) for ts, v in want.items()}
    pairs = set()
    for ts, g in layers.items():
        d = cartesian(g)
        np.fill_diagonal(d, np.inf)
        pairs |= {(ts, g[i][0], g[j][0]) for i, j in zip(*np.nonzero(d <= want[ts] * (1 + 1e-9)))}
    assert edge_set(gr.radius_edges(points, quantile, max_block=size)) == pairs


@pytest.mark.parametrize("size", SIZES)
def test_rescue(spark, points, size):
    edges = gr.max_alt_filter(delaunay_edges(points), 0.01)
    got = edge_set(gr.rescue_isolated(points, edges, max_km=60, max_block=size))
    assert got == edge_set(gr.rescue_isolated(points, edges, max_km=60))
    touched = {(r.ts, r.src) for r in edges.collect()}
    assert got and all((ts, s) not in touched or (ts, d) not in touched for ts, s, d in got)
    assert all((ts, d, s) in got for ts, s, d in got)


@pytest.mark.parametrize("size", SIZES)
def test_interpolation(spark, points, layers, size):
    n = 12
    idw = {(r.ts, r.row, r.col): r.value for r in gd.interp_idw(points, "v", n, max_block=size).collect()}
    near = {(r.ts, r.row, r.col): r.value for r in gd.interp_nearest(points, "v", n, max_block=size).collect()}
    linear = {(r.ts, r.row, r.col): r.value for r in gd.interp_linear(points, "v", n, max_block=size).collect()}
    grid = {(r.ts, r.row, r.col): (r.lon, r.lat) for r in gd.make_grid(points, n).collect()}
    assert len(idw) == len(near) == len(linear) == len(grid) == 2 * n * n
    for ts, g in layers.items():
        lon, lat, v = (np.array([s[i] for s in g]) for i in (2, 1, 4))
        triangles = [[g[int(name[1:])] for name in t] for t in brute_triangles(g, 0.0)]
        for (t, row, col), (x, y) in grid.items():
            if t != ts:
                continue
            d = np.hypot(lon - x, lat - y)
            w = 1 / (d + 1e-12)
            assert idw[t, row, col] == pytest.approx((w @ v) / w.sum())
            assert v.min() - 1e-9 <= idw[t, row, col] <= v.max() + 1e-9
            assert near[t, row, col] == v[d.argmin()]
            want = None
            for a, b, c in triangles:
                m = np.array([[a[2], b[2], c[2]], [a[1], b[1], c[1]], [1, 1, 1]])
                weights = np.linalg.solve(m, [x, y, 1])
                if weights.min() >= -1e-9:
                    want = float(weights @ [a[4], b[4], c[4]])
            assert linear[t, row, col] == (None if want is None else pytest.approx(want))


def test_smoothing_keeps_a_flat_field(spark, points):
    flat = gd.interp_idw(points.withColumn("v", F.lit(3.0)), "v", 7)
    assert all(r.value == pytest.approx(3.0) for r in gd.smooth_gaussian(flat, 7).collect())


def test_coalesce_and_reverse(spark):
    rows = [("a", "b", 1.0), ("a", "b", 1.0), ("b", "a", -1.0)]
    df = spark.createDataFrame(rows, "src string, dst string, d_temp double").withColumn("ts", F.lit(HOURS[0]))
    both = gr.reverse_edges(df)
    first = {(r.src, r.dst): (r.d_temp, r.multiplicity) for r in gr.coalesce_edges(both).collect()}
    summed = {(r.src, r.dst): r.d_temp for r in gr.coalesce_edges(both, "sum").collect()}
    assert first == {("a", "b"): (1.0, 3), ("b", "a"): (-1.0, 3)}
    assert summed == {("a", "b"): 3.0, ("b", "a"): -3.0}


@pytest.mark.parametrize("spread", [0.0, 1e-5])
def test_rings_found_for_many_stations_at_once_are_those_of_each(spread):
    rng = np.random.default_rng(3)
    x, y = rng.random(300), rng.random(300)
    if spread:
        x, y = 0.5 + np.where(rng.random(300) < 0.8, spread, 1.0) * (np.stack([x, y]) - 0.5)
    stations = {"px": x, "py": y, "station_id": np.array([f"s{i:03d}" for i in range(300)], dtype=object)}
    rings = delaunay._clear_rings(stations, stations)
    assert sum(ring is not None for ring in rings) > 200
    for i, ring in enumerate(rings):
        if ring is not None:
            others = np.flatnonzero(np.arange(300) != i)
            want, closed = delaunay.star(x[others] - x[i], y[others] - y[i], stations["station_id"][others], f"s{i:03d}")
            assert closed and others[want].tolist() == ring.tolist()


def test_rings_of_stations_in_clusters_are_found_together():
    rng = np.random.default_rng(4)
    centres = np.stack(np.meshgrid(np.arange(12.0), np.arange(12.0)), axis=-1).reshape(-1, 2) + 0.2 * rng.random((144, 2))
    at = (centres[:, None] + 0.05 * rng.random((144, 8, 2))).reshape(-1, 2)
    names = np.array([f"s{i:04d}" for i in range(len(at))], dtype=object)
    candidates = {"px": at[:, 0], "py": at[:, 1], "station_id": names}
    inner = np.flatnonzero(((at > 2.5) & (at < 9.5)).all(axis=1))
    rings = delaunay._clear_rings({c: v[inner] for c, v in candidates.items()}, candidates)
    assert sum(ring is not None for ring in rings) > 0.95 * len(inner)
    for i, ring in zip(inner[::20], rings[::20], strict=True):
        others = np.flatnonzero(np.arange(len(at)) != i)
        want, closed = delaunay.star(at[others, 0] - at[i, 0], at[others, 1] - at[i, 1], names[others], names[i])
        assert ring is None or (closed and others[want].tolist() == ring.tolist())


def test_stations_well_inside_a_star_change_nothing():
    angle = np.arange(6) * np.pi / 3
    rx, ry = np.cos(angle), np.sin(angle)
    dx, dy = np.array([3.0, 0.4, -5.0]), np.array([3.0, 0.1, 0.5])
    assert delaunay._enclosed(dx, dy, rx, ry).tolist() == [True, False, True]
    # the gap of an open ring lies between its last station and its first
    assert delaunay._enclosed(dx, dy, rx[2:5], ry[2:5]).tolist() == [False, False, True]


def test_tiles_do_not_outgrow_the_root_of_the_stations(spark):
    rng = np.random.default_rng(5)
    rows = [(1, f"S{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((900, 2)))]
    placed = tiles.assign_tiles(spark.createDataFrame(rows, "ts int, station_id string, px double, py double"), size=2)
    held = [n for (n,) in placed.groupBy("tile").count().select("count").collect()]
    assert sum(held) == 900 and 10 < len(held) <= 60


def test_circles_that_leave_the_margin_of_a_tile(spark):
    frame = spark.createDataFrame(
        [(0.5, 0.5, 1.4), (0.5, 0.5, 1.6), (1.5, 0.5, 0.4), (1.5, 0.5, 0.6), (2.5, 2.5, 0.1), (0.9, 0.1, 1.2), (0.5, 0.5, float("inf"))],
        "disc_x double, disc_y double, disc_r double",
    ).withColumns({f"_{p}_{a}": F.lit(v) for p, v in (("lo", 0.0), ("hi", 1.0)) for a in ("px", "py")})
    disc = F.struct("disc_x", "disc_y", "disc_r")
    left = frame.withColumn("_reach", F.lit(1.0)).select(delaunay._leaves_margin(disc).alias("out"))
    assert [r.out for r in left.collect()] == [False, True, False, True, True, True, True]


def test_pairs_within_reach_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(gr, "STRIP", 60)
    rng = np.random.default_rng(4)
    some = {"station_id": np.array([f"S{i:02d}" for i in range(20)], dtype=object), "alt": rng.random(20),
            "reach": np.full(20, 0.5), **{axis: rng.random(20) for axis in "xyz"}}
    pieces = list(gr._reach_block(some, some))
    assert len(pieces) == 7 and max(len(p["src"]) for p in pieces) <= 60
    at = np.stack([some[axis] for axis in "xyz"], axis=1)
    apart = np.sqrt(((at[:, None] - at) ** 2).sum(axis=2))
    want = {(f"S{i:02d}", f"S{j:02d}") for i, j in np.argwhere(apart <= 0.5) if i != j}
    got = [pair for p in pieces for pair in zip(p["src"].to_pylist(), p["dst"].to_pylist())]
    assert set(got) == want and len(got) == len(want)

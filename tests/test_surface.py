"""Grid arithmetic against plain forms, and maps cut into tiles against whole ones."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import grid as gd
from skylattice.operators import surface


def scattered(kind, m, rng):
    if kind == "lattice":
        return rng.integers(0, 8, m) / 8.0, rng.integers(0, 8, m) / 8.0
    x, y = rng.random(m), rng.random(m)
    if kind == "crowd":
        crowd = rng.random(m) < 0.9
        x = np.where(crowd, 0.5 + rng.normal(size=m) * 1e-5, x)
        y = np.where(crowd, 0.5 + rng.normal(size=m) * 1e-5, y)
    return x, y


@pytest.mark.parametrize("kind", ["even", "lattice", "crowd"])
@pytest.mark.parametrize("m", [1, 5, 600, 2000])
def test_nearest_is_the_first_of_the_closest(kind, m):
    x, y = scattered(kind, m, np.random.default_rng(m))
    lon, lat = np.linspace(-0.25, 1.25, 49), np.linspace(-0.25, 1.25, 25)
    dx, dy = lon[:, None] - x, lat[:, None] - y
    d = np.sqrt((dx * dx)[None, :, :] + (dy * dy)[:, None, :])
    assert (surface.nearest(lon, lat, x, y) == d.argmin(axis=2)).all()


def test_tree_keeps_few_nodes_per_point():
    """Twenty times the stations do not make twenty times the leaves that a cell compares."""
    lon = np.linspace(-0.1, 1.1, 60)
    seen = []
    for m in (1000, 20000):
        tree = surface.StationTree(*scattered("crowd", m, np.random.default_rng(1)))
        tree.leaves = Counted(tree.leaves)
        tree.nearest(np.tile(lon, 60), np.repeat(lon, 60))
        seen.append(tree.leaves.taken)
    assert seen[1] < 2 * seen[0]


class Counted:
    def __init__(self, rows):
        self.rows, self.taken = rows, 0

    def __getitem__(self, nodes):
        self.taken += len(nodes)
        return self.rows[nodes]


def test_blur_of_a_tile_equals_the_whole():
    n, sigma = 23, 1.3
    grid = np.random.default_rng(3).random((n, n))
    grid[4, 17] = np.nan
    whole = surface.blur(grid, (0, n), (0, n), n, sigma)
    radius = surface.radius_of(sigma)
    padded = np.pad(grid, radius, mode="symmetric")
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel = np.outer(kernel, kernel) / kernel.sum() ** 2
    plain = [[(padded[i:i + 2 * radius + 1, j:j + 2 * radius + 1] * kernel).sum() for j in range(n)] for i in range(n)]
    np.testing.assert_allclose(whole, plain)
    for rows, cols in (((0, 7), (14, 23)), ((7, 14), (0, 7)), ((20, 23), (20, 23))):
        (a, b), (c, d) = (surface.with_rim(*s, radius, n) for s in (rows, cols))
        part = surface.blur(grid[a:b, c:d], rows, cols, n, sigma)
        np.testing.assert_allclose(part, whole[rows[0]:rows[1], cols[0]:cols[1]])


@pytest.fixture(scope="module")
def stations(spark):
    rng = np.random.default_rng(7)
    rows = [(t, f"S{i:03}", float(rng.random() * 2), 40 + float(rng.random()), float(rng.normal()))
            for t in (1, 2) for i in range(40 if t == 1 else 2)]
    rows += [(1, "S900", 0.5, 40.5, None), (3, "S000", 1.0, 41.0, None)]
    return spark.createDataFrame(rows, "ts long, station_id string, lon double, lat double, v double")


def values(frame):
    return {(r.ts, r.row, r.col): r.value for r in frame.collect()}


@pytest.mark.parametrize("method", ["idw", "nearest", "linear", "hybrid"])
def test_tiles_and_crowded_layers_give_the_whole_map(stations, method):
    def drawn(**kw):
        return values(gd.interpolated_layer(stations, "v", 21, method, max_km=30.0, **kw))

    whole = drawn()
    assert len(whole) == 2 * 21 * 21 and any(v is None for v in whole.values())
    for other in (drawn(tile=8), drawn(tile=8, max_block=30)):
        assert other.keys() == whole.keys()
        for cell, want in whole.items():
            assert other[cell] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_masking_given_cells(spark, stations):
    cells = gd.make_grid(stations.filter("v is not null"), 21).withColumn("value", F.col("row") * 1.0)
    cells = cells.unionByName(cells.filter("ts = 1").withColumn("ts", F.lit(9).cast("long")))
    whole = values(gd.distance_mask(cells, stations, "v", 21, 20.0))
    assert whole == values(gd.distance_mask(cells, stations, "v", 21, 20.0, tile=8))
    assert whole == values(gd.distance_mask(cells, stations, "v", 21, 20.0, max_block=30))
    assert {t for t, _, _ in whole} == {1, 2}


def test_empty_layers(spark, stations):
    none = stations.filter("ts = 3")
    assert gd.interpolated_layer(none, "v", 9).count() == 0
    assert gd.interpolated_layer(none, "v", 9, tile=4).count() == 0


@pytest.mark.parametrize("method", ["idw", "nearest", "linear", "hybrid"])
def test_layers_of_several_chunks_give_the_whole_map(spark, method):
    spots = np.random.default_rng(7).permutation(256)[:200]
    rows = [(datetime(2024, 1, 1), f"s{i:03d}", k % 16 / 4.0, k // 16 / 4.0, float(i % 17))
            for i, k in enumerate(spots.tolist())]
    stations = spark.createDataFrame(rows, "ts timestamp, station_id string, lon double, lat double, v double")

    def drawn(**options):
        cells = gd.interpolated_layer(stations, "v", 9, method, 0.8, 30.0, **options).collect()
        return {(r.row, r.col): r.value for r in cells}

    whole, cut = drawn(), drawn(max_block=12, tile=5)
    assert len(cut) == len(whole) == 81
    for cell, value in whole.items():
        assert cut[cell] == (value if value is None else pytest.approx(value, abs=1e-9))
    # partial results: one row per tile and chunk of as many stations as there are cells
    measured = stations.withColumnRenamed("v", "value")
    chunks = -(-measured.count() // 81)
    spec = gd.MapSpec(9, "nearest", max_km=30.0, tile=5)
    assert gd._pieces(measured, spec, "ts", 12).count() <= 4 * chunks


def test_few_stations_are_summed_in_order():
    rng = np.random.default_rng(3)
    lon, lat, x, y, value = (rng.random(m) for m in (6, 5, 40, 40, 40))
    total, weight = surface.weighted_sums(lon, lat, x, y, value, 2.0)
    want_total, want_weight = np.zeros((5, 6)), np.zeros((5, 6))
    for k in range(40):
        w = (lon - x[k]) ** 2 + (lat[:, None] - y[k]) ** 2 + 1e-12
        want_total, want_weight = want_total + value[k] / w, want_weight + 1.0 / w
    assert (total == want_total).all() and (weight == want_weight).all()

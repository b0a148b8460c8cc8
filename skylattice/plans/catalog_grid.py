"""Queries on map grids and layers, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylattice.operators import grid as gd
from skylattice.plans import station_events as ev
from skylattice.plans.catalog_graph import DELAUNAY, _TRIANGLES
from skylattice.plans.catalog_rows import haversine_sql, rounded
from skylattice.plans.oracle import r, rr, sql
from skylattice.session import materialize

QUERIES = {}
ORACLES = {}
N = 200
BLOCK = 20


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


MEASURED = "measured AS (SELECT ts, station_id, lon, lat, temp AS value FROM points WHERE temp IS NOT NULL)"
BOUNDS = ("bounds AS (SELECT ts, min(lon) - 0.1e0 AS lon0, max(lon) + 0.1e0 AS lon1,"
          " min(lat) - 0.1e0 AS lat0, max(lat) + 0.1e0 AS lat1 FROM measured GROUP BY ts)")
GRID = (f"grid AS (SELECT ts, CAST(a.range AS INTEGER) AS row, CAST(b.range AS INTEGER) AS col,"
        f" lon0 + (lon1 - lon0) * b.range / {N - 1}e0 AS lon, lat0 + (lat1 - lat0) * a.range / {N - 1}e0 AS lat"
        f" FROM bounds, range({N}) a, range({N}) b)")
# the stations of a layer as one list, so that no row per station and cell is formed
LISTS = ("lists AS (SELECT ts, list({'lon': lon, 'lat': lat, 'v': value} ORDER BY station_id) AS ms"
         " FROM measured GROUP BY ts)")
_D = "sqrt((g.lon - m.lon) * (g.lon - m.lon) + (g.lat - m.lat) * (g.lat - m.lat))"


def _weighted(weight: str) -> str:
    return (f"idw AS (SELECT g.ts, row, col, list_sum(list_transform(ms, lambda m: m.v / ({weight})))"
            f" / list_sum(list_transform(ms, lambda m: 1e0 / ({weight}))) AS value"
            " FROM grid g JOIN lists l ON l.ts = g.ts)")


IDW = _weighted(f"{_D} + 1e-12")
# of stations equally near the first by name, which is the first of the list
NEAR = ("near AS (SELECT ts, row, col, lat AS glat, lon AS glon, best.v AS value, best.lat AS lat, best.lon AS lon"
        " FROM (SELECT ts, row, col, lat, lon, ms[list_position(ds, list_min(ds))] AS best FROM"
        f" (SELECT g.*, ms, list_transform(ms, lambda m: {_D}) AS ds FROM grid g JOIN lists l ON l.ts = g.ts)))")
BASE = [MEASURED, BOUNDS, GRID, LISTS]
FLAT = ("cart AS (SELECT ts, station_id, lon AS px, lat AS py, value FROM measured)")
LINEAR = """corners AS (SELECT t.ts, p.px AS ax, p.py AS ay, p.value AS av, q.px AS bx, q.py AS by_, q.value AS bv,
     s.px AS cx, s.py AS cy, s.value AS cv FROM triangles t
   JOIN cart p ON p.ts = t.ts AND p.station_id = t.a JOIN cart q ON q.ts = t.ts AND q.station_id = t.b
   JOIN cart s ON s.ts = t.ts AND s.station_id = t.c),
 weighed AS (SELECT g.ts, row, col, av, bv, cv,
     ((by_ - cy) * (lon - cx) + (cx - bx) * (lat - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wa,
     ((cy - ay) * (lon - cx) + (ax - cx) * (lat - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wb
   FROM grid g JOIN corners c ON c.ts = g.ts),
 linear AS (SELECT g.ts, g.row, g.col, w.value FROM grid g LEFT JOIN (SELECT ts, row, col,
     min(wa * av + wb * bv + (1e0 - wa - wb) * cv) AS value FROM weighed
   WHERE wa >= -1e-12 AND wb >= -1e-12 AND 1e0 - wa - wb >= -1e-12 GROUP BY ts, row, col) w
   ON w.ts = g.ts AND w.row = g.row AND w.col = g.col)"""
TRI = [FLAT, DELAUNAY, _TRIANGLES, LINEAR]
VALUE = r("value")


def _digest_sql(table: str) -> str:
    """What a whole layer comes to in each block of cells: the result stays small."""
    return (f"SELECT ts, CAST(row // {BLOCK} AS INTEGER) AS block_row, CAST(col // {BLOCK} AS INTEGER) AS block_col,"
            f" count(*) AS cells, count(value) AS filled, {r('sum(value)', 'total', 4)}, {r('min(value)', 'low')},"
            f" {r('max(value)', 'high')} FROM {table} GROUP BY ALL")


def _digest(cells: DataFrame) -> DataFrame:
    return cells.groupBy(
        "ts", F.floor(F.col("row") / BLOCK).cast("int").alias("block_row"),
        F.floor(F.col("col") / BLOCK).cast("int").alias("block_col"),
    ).agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"),
          F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


def _points(s, d) -> DataFrame:
    return materialize(ev.points(s, d))


def _measured(s, d) -> DataFrame:
    return ev.points(s, d).filter("temp is not null")


@query("make_grid", sql("points", _digest_sql("(SELECT ts, row, col, lon * lat AS value FROM grid)"),
                        MEASURED, BOUNDS, GRID))
def _(s, d):
    return _digest(gd.make_grid(_measured(s, d), N).withColumn("value", F.col("lon") * F.col("lat")))


@query("interp_idw", sql("points", _digest_sql("idw"), *BASE, IDW))
def _(s, d):
    return _digest(gd.interp_idw(_points(s, d), "temp", N))


@query("interp_idw_squared", sql("points", _digest_sql("idw"), *BASE, _weighted(f"{_D} * {_D} + 1e-12")))
def _(s, d):
    return _digest(gd.interp_idw(_points(s, d), "temp", N, power=2.0))


@query("interp_idw_cut", sql("points", _digest_sql("idw"), *BASE, IDW))
def _(s, d):
    return _digest(gd.interp_idw(_points(s, d), "temp", N, max_block=12))


@query("interp_nearest", sql("points", _digest_sql("near"), *BASE, NEAR))
def _(s, d):
    return _digest(gd.interp_nearest(_points(s, d), "temp", N))


@query("interp_nearest_cut", sql("points", _digest_sql("near"), *BASE, NEAR))
def _(s, d):
    return _digest(gd.interp_nearest(_points(s, d), "temp", N, max_block=12))


@query("interp_linear", sql("points", _digest_sql("linear"), MEASURED, BOUNDS, GRID, *TRI))
def _(s, d):
    return _digest(gd.interp_linear(_points(s, d), "temp", N))


_FILLED = ("hybrid AS (SELECT l.ts, l.row, l.col, coalesce(l.value, n.value) AS value FROM linear l"
           " JOIN near n ON n.ts = l.ts AND n.row = l.row AND n.col = l.col)")


@query("interp_hybrid", sql("points", _digest_sql("hybrid"), *BASE, NEAR, *TRI, _FILLED))
def _(s, d):
    return _digest(gd.interp_hybrid(_points(s, d), "temp", N))


_KM = haversine_sql("g", "m")


def _masked(table: str) -> str:
    return (f"masked AS (SELECT i.ts, i.row, i.col, CASE WHEN km <= 50e0 THEN i.value END AS value FROM {table} i"
            f" JOIN (SELECT n.ts, n.row, n.col, {_KM} AS km FROM near n,"
            " LATERAL (SELECT n.glat AS lat, n.glon AS lon) g, LATERAL (SELECT n.lat AS lat,"
            " n.lon AS lon) m) k ON k.ts = i.ts AND k.row = i.row AND k.col = i.col)")


_MASKED_IDW = sql("points", _digest_sql("masked"), *BASE, IDW, NEAR, _masked("idw"))


@query("distance_mask", _MASKED_IDW)
def _(s, d):
    return _digest(gd.interpolated_layer(_points(s, d), "temp", N, "idw", sigma=0.0, clip=False))


@query("distance_mask_cells", _MASKED_IDW)
def _(s, d):
    points = _points(s, d)
    return _digest(gd.distance_mask(gd.interp_idw(points, "temp", N), points, "temp", N, tile=50))


_WEIGHTS = [f"exp(-0.5e0 * ({k} / 0.8e0) * ({k} / 0.8e0))" for k in range(-3, 4)]
_TOTAL = "(" + " + ".join(_WEIGHTS) + ")"


def _blur(table: str, fixed: str, moving: str, out: str) -> str:
    """One pass along each line, held as a list; positions beyond its ends are mirrored."""
    terms = []
    for k, w in zip(range(-3, 4), _WEIGHTS):
        m = f"((j + {k}) % {2 * N} + {2 * N}) % {2 * N}"
        terms.append(f"line[CAST(CASE WHEN {m} < {N} THEN {m} ELSE {2 * N - 1} - {m} END AS BIGINT) + 1] * ({w} / {_TOTAL})")
    return (f"{out} AS (SELECT ts, {fixed}, j AS {moving}, " + " + ".join(terms) + " AS value FROM"
            f" (SELECT ts, {fixed}, list(value ORDER BY {moving}) AS line FROM {table} GROUP BY ts, {fixed}),"
            f" (SELECT CAST(range AS INTEGER) AS j FROM range({N})))")


_SMOOTH_IDW = sql("points", _digest_sql("smooth"), *BASE, IDW,
                  _blur("idw", "row", "col", "half"), _blur("half", "col", "row", "smooth"))


@query("smooth_gaussian", _SMOOTH_IDW)
def _(s, d):
    return _digest(gd.interpolated_layer(_points(s, d), "temp", N, "idw", max_km=None, clip=False))


@query("smooth_gaussian_cells", _SMOOTH_IDW)
def _(s, d):
    return _digest(gd.smooth_gaussian(gd.interp_idw(_points(s, d), "temp", N), N, tile=50))


def _clipped(table: str, factor: str) -> str:
    return (f"clipped AS (SELECT i.ts, i.row, i.col, CASE WHEN value IS NOT NULL THEN"
            f" least(greatest(i.value * {factor}, lo), hi) END AS value FROM {table} i"
            " JOIN (SELECT ts, min(temp) AS lo, max(temp) AS hi FROM points GROUP BY ts) l ON l.ts = i.ts)")


@query("clip_to_observed", sql("points", _digest_sql("clipped"), *BASE, IDW, _clipped("idw", "1.5e0")))
def _(s, d):
    points = _points(s, d)
    cells = gd.interp_idw(points, "temp", N).withColumn("value", F.col("value") * 1.5)
    return _digest(gd.clip_to_observed(cells, points, "temp"))


_LAYER = sql("points", _digest_sql("clipped"), *BASE, NEAR, *TRI, _FILLED,
             _blur("hybrid", "row", "col", "half"), _blur("half", "col", "row", "smooth"),
             _masked("smooth"), _clipped("masked", "1e0"))


@query("interpolated_layer", _LAYER)
def _(s, d):
    return _digest(gd.interpolated_layer(_points(s, d), "temp", N))


@query("interpolated_layer_tiles", _LAYER)
def _(s, d):
    return _digest(gd.interpolated_layer(_points(s, d), "temp", N, tile=50))


@query("interpolated_layer_cut", _LAYER)
def _(s, d):
    return _digest(gd.interpolated_layer(_points(s, d), "temp", N, max_block=12, tile=50))


@query("dedupe_coordinates",
       sql("raw", "SELECT ts, event_id FROM (SELECT *, row_number() OVER"
                  " (PARTITION BY ts, lat, lon ORDER BY event_id) AS k FROM raw) WHERE k = 1"))
def _(s, d):
    return gd.dedupe_coordinates(ev.raw(s, d), "event_id").select("ts", "event_id")


_SHOWN = ["temp", "humidity", "rain", "wind_speed", "pressure"]


def _case(items: dict[str, str]) -> str:
    return "CASE variable " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in items.items()) + " END"


@query("map_layer",
       sql("points", f"SELECT ts, station_id, variable, {VALUE}, unit, {rr('display_low', 'display_high')},"
                     f" value = 0 AS is_zero, {r('min(value) OVER w', 'low')}, {r('max(value) OVER w', 'high')}"
                     " FROM (SELECT *, "
           + _case({"temp": "'°C'", "humidity": "'%'", "rain": "'mm'", "wind_speed": "'km/h'",
                    "pressure": "'hPa'"}) + " AS unit, "
           + _case({"temp": "-20e0", "humidity": "0e0", "rain": "0e0", "wind_speed": "0e0",
                    "pressure": "980e0"}) + " AS display_low, "
           + _case({"temp": "45e0", "humidity": "100e0", "rain": "150e0", "wind_speed": "200e0",
                    "pressure": "1040e0"}) + " AS display_high FROM long)"
           " WINDOW w AS (PARTITION BY ts, variable)",
           f"long AS (SELECT ts, station_id, variable, value FROM points UNPIVOT (value FOR variable IN"
           f" ({', '.join(_SHOWN)})))"))
def _(s, d):
    long = ev.points(s, d).select("ts", "station_id", *_SHOWN).unpivot(
        ["ts", "station_id"], _SHOWN, "variable", "value"
    )
    return gd.map_layer(long)


@query("contour_bands",
       sql("points", f"SELECT ts, station_id, {VALUE}, CAST(CASE WHEN value IS NOT NULL THEN"
                     " least(greatest(floor(value / 10e0) + 1, 0), 10) END AS INTEGER) AS band FROM"
                     " (SELECT ts, station_id, wind_speed AS value FROM points)"))
def _(s, d):
    cells = ev.points(s, d).select("ts", "station_id", F.col("wind_speed").alias("value"))
    return gd.contour_bands(cells, variable="wind_speed")


@query("contour_bands_grid",
       sql("points", "SELECT ts, CAST(least(greatest(floor(value / 10e0) + 1, 0), 10) AS INTEGER) AS band,"
                     f" count(*) AS cells, {r('sum(value)', 'total', 4)} FROM idw GROUP BY ALL",
           MEASURED.replace("temp", "wind_speed"), BOUNDS, GRID, LISTS, IDW))
def _(s, d):
    cells = gd.interp_idw(_points(s, d), "wind_speed", N)
    return gd.contour_bands(cells, variable="wind_speed").groupBy("ts", "band").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 4).alias("total"))


@query("wind_arrows",
       sql("points", f"SELECT ts, station_id, {rr('lon', 'lat')},"
                     f" {r('cos(radians(wind_dir)) * wind_speed * 0.05e0', 'arrow_u')},"
                     f" {r('sin(radians(wind_dir)) * wind_speed * 0.05e0', 'arrow_v')} FROM (SELECT *,"
                     " row_number() OVER (PARTITION BY ts ORDER BY station_id) - 1 AS i,"
                     " count(*) OVER (PARTITION BY ts) AS n FROM points) WHERE i % greatest(n // 4, 1) = 0"))
def _(s, d):
    return gd.wind_arrows(_points(s, d), max_arrows=4)

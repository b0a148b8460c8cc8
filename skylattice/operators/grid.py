"""Map grids interpolated from stations, and the rows behind map layers.

A layer is one hour of stations; its grid is ``n`` x ``n`` over the bounds of the stations with a
margin, cut into square tiles of cells. The arithmetic (``surface``) runs in numpy on one tile, and a
tile that will be smoothed works out its rim too, so a whole map leaves one task and no cells are
joined. A layer with more than ``MAX_BLOCK`` stations is cut into chunks of about as many stations as
the grid has cells. A chunk gives one packed row per tile, so partial results take no more room than
stations, and a tile is drawn where its rows meet the triangles that reach it. No station and cell
pairs are ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.constants import CONTOUR_LEVELS, DISPLAY_LIMITS, EARTH_RADIUS_KM, UNITS
from skylattice.operators import blocks, surface
from skylattice.operators.clean import first_row
from skylattice.operators.delaunay import CORNER_COLUMNS, corners_of_crowded, triangle_corners
from skylattice.operators.windows import ordinal


def _bounds(points: DataFrame, margin: float, by: str) -> DataFrame:
    return points.groupBy(by).agg(
        (F.min("lon") - margin).alias("lon0"), (F.max("lon") + margin).alias("lon1"),
        (F.min("lat") - margin).alias("lat0"), (F.max("lat") + margin).alias("lat1"),
    )


def _at(low: str, high: str, index: str, n: int) -> Column:
    return F.col(low) + (F.col(high) - F.col(low)) * F.col(index) / F.lit(float(n - 1))


def make_grid(points: DataFrame, n: int = 200, margin: float = 0.1, by: str = "ts") -> DataFrame:
    """``ts, row, col, lon, lat``: rows go north, columns east."""
    index = F.sequence(F.lit(0), F.lit(n - 1))
    cells = (
        _bounds(points, margin, by)
        .withColumn("row", F.explode(index)).withColumn("col", F.explode(index))
    )
    return cells.select(
        by, "row", "col", _at("lon0", "lon1", "col", n).alias("lon"),
        _at("lat0", "lat1", "row", n).alias("lat"),
    )


@dataclass(frozen=True)
class MapSpec:
    """How a layer becomes a map: ``sigma`` 0 does not smooth, ``max_km`` None does not mask."""

    n: int = 200
    method: str = "hybrid"
    power: float = 1.0
    sigma: float = 0.0
    max_km: float | None = None
    clip: bool = False
    margin: float = 0.1
    tile: int = 256

    @property
    def tiles(self) -> int:
        """Tiles along one side."""
        return -(-self.n // self.tile)

    @property
    def linear(self) -> bool:
        return self.method in ("linear", "hybrid")

    @property
    def searched(self) -> bool:
        """Whether the nearest station of every cell is needed."""
        return self.method in ("nearest", "hybrid") or self.max_km is not None

    def lines(self, tile: int) -> tuple[int, int]:
        """First grid line of a tile and the one past its last."""
        return tile * self.tile, min(self.n, (tile + 1) * self.tile)

    def extent(self, tile: tuple[int, int]) -> tuple[list, list]:
        """Grid lines (rows, columns) of a tile, and with the rim that smoothing needs."""
        inner, radius = [self.lines(t) for t in tile], surface.radius_of(self.sigma)
        return inner, [surface.with_rim(*lines, radius, self.n) for lines in inner]


PACKED = ["lon", "lat", "value", "a", "b", "c"]


def _pack(stations: blocks.Stations, spec: MapSpec) -> dict[str, np.ndarray]:
    """What a tile needs to know of its layer: positions, values and triangle corners as numbers."""
    layer = {c: stations[c] for c in ("lon", "lat", "value")}
    layer.update(dict.fromkeys("abc", np.zeros(0, dtype=np.int64)))
    if spec.linear:
        layer.update(triangle_corners({**stations, "px": stations["lon"], "py": stations["lat"]}))
    return layer


def _grid_lines(position: np.ndarray, index: np.ndarray, spec: MapSpec) -> tuple[np.ndarray, float]:
    """Some grid lines of a layer along one axis, and the step between them."""
    low, high = position.min() - spec.margin, position.max() + spec.margin
    return low + (high - low) * index / (spec.n - 1.0), (high - low) / (spec.n - 1.0)


def _draw_tile(layer: dict[str, np.ndarray], spec: MapSpec, tile: tuple[int, int]) -> np.ndarray:
    """Interpolated, filled, smoothed, masked and clipped values of one tile, from one search for
    the nearest stations. A tile to be smoothed works out the cells of its rim as well."""
    _, outer = spec.extent(tile)
    (lat, up), (lon, right) = (
        _grid_lines(layer[axis], np.arange(*lines), spec)
        for axis, lines in zip(("lat", "lon"), outer, strict=True)
    )
    value, km = layer["value"], None
    if spec.searched:
        best, km = _closest(layer, lon, lat)
    if spec.method == "idw":
        total, weight = surface.weighted_sums(lon, lat, layer["lon"], layer["lat"], value, spec.power)
        cells = total / weight
    elif spec.method == "nearest":
        cells = value[best]
    else:
        corners = {
            f"{c}_{p}": layer[column][layer[c]]
            for c in "abc" for p, column in (("lon", "lon"), ("lat", "lat"), ("v", "value"))
        }
        cells = surface.draw(corners, lon, lat, right, up)
        if spec.method == "hybrid":
            cells = np.where(np.isnan(cells), value[best], cells)
    return _finish(cells, km, spec, tile, value.min(), value.max())


def _finish(
    cells: np.ndarray, km: np.ndarray | None, spec: MapSpec, tile: tuple[int, int], low: float, high: float
) -> np.ndarray:
    """A tile smoothed, masked by ``km`` and clipped from its cells with their rim."""
    inner, outer = spec.extent(tile)
    if spec.sigma:
        cells = surface.blur(cells, *inner, spec.n, spec.sigma)
    if spec.max_km is not None:
        top, left = (i[0] - o[0] for i, o in zip(inner, outer, strict=True))
        km = km[top:top + cells.shape[0], left:left + cells.shape[1]]
        cells = np.where(km <= spec.max_km, cells, np.nan)
    return np.clip(cells, low, high) if spec.clip else cells


def _tile_table(cells: np.ndarray, spec: MapSpec, tile: tuple[int, int], arrow: pa.Schema, key: pa.Scalar) -> pa.Table:
    row, col = (np.arange(*spec.lines(t), dtype=np.int32) for t in tile)
    flat = cells.ravel()
    out = {
        "row": np.repeat(row, len(col)), "col": np.tile(col, len(row)),
        "value": pa.array(flat, mask=np.isnan(flat)),
    }
    return blocks.to_table(out, arrow, **{arrow[0].name: key})


def _maps(measured: DataFrame, spec: MapSpec, by: str) -> DataFrame:
    """``ts, row, col, value`` of layers that fit a task. A grid of one tile is drawn where its
    stations meet. For a larger one the layer is packed into one row, which every tile receives."""
    kind = measured.schema[by].dataType.simpleString()
    ddl = f"{by} {kind}, row int, col int, value double"
    arrow = blocks.arrow_schema(ddl)
    layers = blocks.spread_evenly(measured, by).groupBy(by)
    if spec.tiles == 1:
        def whole(table: pa.Table) -> pa.Table:
            layer = _pack(blocks.to_stations(table.drop_columns([by])), spec)
            cells = _draw_tile(layer, spec, (0, 0))
            return _tile_table(cells, spec, (0, 0), arrow, table.column(by)[0])

        return layers.applyInArrow(whole, ddl)

    packed = pa.schema([arrow[0], *[
        pa.field(c, pa.list_(pa.int64() if c in "abc" else pa.float64())) for c in PACKED]])

    def pack(table: pa.Table) -> pa.Table:
        layer = _pack(blocks.to_stations(table.drop_columns([by])), spec)
        rows = {by: [table.column(by)[0].as_py()], **{c: [layer[c]] for c in PACKED}}
        return pa.table([pa.array(rows[f.name], f.type) for f in packed], schema=packed)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                layer = {c: np.asarray(batch.column(c)[i].values) for c in PACKED}
                tile = batch.column("_tr")[i].as_py(), batch.column("_tc")[i].as_py()
                cells = _draw_tile(layer, spec, tile)
                yield from _tile_table(cells, spec, tile, arrow, batch.column(by)[i]).to_batches()

    arrays = ", ".join(f"{c} array<{'bigint' if c in 'abc' else 'double'}>" for c in PACKED)
    index = F.sequence(F.lit(0), F.lit(spec.tiles - 1))
    tiles = (
        layers.applyInArrow(pack, f"{by} {kind}, {arrays}")
        .withColumn("_tr", F.explode(index)).withColumn("_tc", F.explode(index))
    )
    return blocks.spread_evenly(tiles, by, "_tr", "_tc").mapInArrow(draw, ddl)


#: Most stations in a chunk of a crowded layer.
CHUNK = 1 << 17
FRAME = ["lon0", "lon1", "lat0", "lat1", "low", "high"]
SUMS = ["total", "weight"]
#: The nearest station of a chunk to each cell. The first and its name serve to choose between chunks.
NEAREST = ["gap", "value", "km"]


def _layers(stations: DataFrame, spec: MapSpec, by: str, max_block: int) -> DataFrame:
    """Bounds, range of values and number of chunks of each layer."""
    size = F.lit(float(max(max_block, min(spec.n * spec.n, CHUNK))))
    ranges = stations.groupBy(by).agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_chunks"),
    )
    bounds = _bounds(stations, spec.margin, by).withColumnRenamed(by, "_layer")
    return ranges.join(bounds, F.col(by).eqNullSafe(F.col("_layer"))).drop("_layer")


def _frame_lines(frame: Mapping[str, float], lines: list, n: int) -> list[np.ndarray]:
    """Latitudes and longitudes of some grid lines of a layer."""
    return [
        frame[f"{axis}0"] + (frame[f"{axis}1"] - frame[f"{axis}0"]) * np.arange(*some) / (n - 1.0)
        for axis, some in zip(("lat", "lon"), lines, strict=True)
    ]


def _pieces(stations: DataFrame, spec: MapSpec, by: str, max_block: int) -> DataFrame:
    """What every chunk of stations knows of the cells of each tile and its rim, one array per
    quantity and one row per chunk and tile. Every tile has a row at least."""
    sums, layers = spec.method == "idw", _layers(stations, spec, by, max_block)
    keys = f"{by} {stations.schema[by].dataType.simpleString()}, _tr int, _tc int, _chunk int"
    doubles = [*(SUMS if sums else []), *(NEAREST if spec.searched else [])]
    ddl = ", ".join([keys, *[f"{c} double" for c in FRAME], *[f"{c} array<double>" for c in doubles],
                     "station_id array<string>"])
    arrow = blocks.arrow_schema(ddl)
    if not doubles:
        index = F.sequence(F.lit(0), F.lit(spec.tiles - 1))
        tiles = layers.withColumn("_tr", F.explode(index)).withColumn("_tc", F.explode(index))
        return tiles.select(by, "_tr", "_tc", F.lit(0).alias("_chunk"), *FRAME,
                            F.lit(None).cast("array<string>").alias("station_id"))

    def run(table: pa.Table) -> pa.Table:
        rows = blocks.to_stations(table.drop_columns([by]))
        frame, several = {c: rows[c][0] for c in FRAME}, rows["_chunks"][0] > 1
        out = {f.name: [] for f in arrow}
        for tile in product(range(spec.tiles), repeat=2):
            lat, lon = _frame_lines(frame, spec.extent(tile)[1], spec.n)
            found = {**frame, "_tr": tile[0], "_tc": tile[1], "_chunk": rows["_chunk"][0], "station_id": None}
            if sums:
                parts = surface.weighted_sums(lon, lat, rows["lon"], rows["lat"], rows["value"], spec.power)
                found.update(zip(SUMS, (p.ravel() for p in parts), strict=True))
            if spec.searched:
                best, km = _closest(rows, lon, lat)
                if spec.method in ("nearest", "hybrid"):
                    found["value"] = rows["value"][best].ravel()
                if spec.max_km is not None:
                    found["km"] = km.ravel()
                if several:
                    dx, dy = lon - rows["lon"][best], lat[:, None] - rows["lat"][best]
                    found["gap"] = np.sqrt(dx * dx + dy * dy).ravel()
                    found["station_id"] = rows["station_id"][best.ravel()]
            for c, values in out.items():
                values.append(found.get(c))
        del out[by]
        return blocks.to_table(out, arrow, **{by: table.column(by)[0]})

    chunk = F.pmod(F.xxhash64("station_id"), F.col("_chunks")).cast("int")
    layers = layers.withColumnRenamed(by, "_layer")
    rows = stations.join(layers, F.col(by).eqNullSafe(F.col("_layer"))).drop("_layer").withColumn("_chunk", chunk)
    return blocks.spread_evenly(rows, by, "_chunk").groupBy(by, "_chunk").applyInArrow(run, ddl)


def _stack(pieces: pa.Table, column: str) -> np.ndarray:
    """The arrays of a tile, one row per chunk."""
    chunks = pieces.column(column).chunks
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(pieces.num_rows, -1)


def _nearest_chunk(pieces: pa.Table) -> np.ndarray | int:
    """Which chunk has the station nearest to each cell, the first by name of those equally near."""
    if pieces.num_rows == 1:
        return 0
    gap, names = _stack(pieces, "gap"), _stack(pieces, "station_id")
    best, cells = np.zeros(gap.shape[1], dtype=np.int64), np.arange(gap.shape[1])
    for k in range(1, len(gap)):
        held = gap[best, cells]
        tied = np.flatnonzero(gap[k] == held)
        first = names[k, tied] < names[best[tied], tied]
        best[gap[k] < held] = k
        best[tied[first.astype(bool)]] = k
    return best


def _draw_pieces(pieces: pa.Table, corners: dict[str, np.ndarray], spec: MapSpec, tile: tuple[int, int]) -> np.ndarray:
    """What ``_draw_tile`` gives, from the pieces of all chunks and the triangles that reach the tile."""
    frame = {c: pieces.column(c)[0].as_py() for c in FRAME}
    lat, lon = _frame_lines(frame, spec.extent(tile)[1], spec.n)
    shape, every, km, near = (len(lat), len(lon)), np.arange(len(lat) * len(lon)), None, None
    if spec.searched:
        best = _nearest_chunk(pieces)
        if spec.max_km is not None:
            km = _stack(pieces, "km")[best, every].reshape(shape)
        if spec.method in ("nearest", "hybrid"):
            near = _stack(pieces, "value")[best, every].reshape(shape)
    if spec.method == "idw":
        total, weight = (_stack(pieces, c).sum(axis=0) for c in SUMS)
        cells = (total / weight).reshape(shape)
    elif spec.method == "nearest":
        cells = near
    else:
        right, up = ((frame[f"{axis}1"] - frame[f"{axis}0"]) / (spec.n - 1.0) for axis in ("lon", "lat"))
        cells = surface.draw(corners, lon, lat, right, up)
        if spec.method == "hybrid":
            cells = np.where(np.isnan(cells), near, cells)
    return _finish(cells, km, spec, tile, frame["low"], frame["high"])


def _crowded_maps(stations: DataFrame, spec: MapSpec, by: str, max_block: int) -> DataFrame:
    """``_maps`` of layers of any size."""
    kind = stations.schema[by].dataType.simpleString()
    ddl = f"{by} {kind}, row int, col int, value double"
    arrow, keys = blocks.arrow_schema(ddl), [by, "_tr", "_tc"]

    def run(pieces: pa.Table, corners: pa.Table | None = None) -> pa.Table:
        if not pieces.num_rows:
            return arrow.empty_table()
        tile = pieces.column("_tr")[0].as_py(), pieces.column("_tc")[0].as_py()
        some = {c: corners.column(c).to_numpy() for c in CORNER_COLUMNS} if spec.linear else {}
        cells = _draw_pieces(pieces, some, spec, tile)
        return _tile_table(cells, spec, tile, arrow, pieces.column(by)[0])

    pieces = blocks.spread_evenly(_pieces(stations, spec, by, max_block), *keys).groupBy(*keys)
    if not spec.linear:
        return pieces.applyInArrow(lambda table: run(table), ddl)
    visits = _triangle_visits(stations, spec, by, max_block).withColumnsRenamed({c: f"_{c}" for c in keys})
    corners = blocks.spread_evenly(visits, *[f"_{c}" for c in keys]).groupBy(*[f"_{c}" for c in keys])
    return pieces.cogroup(corners).applyInArrow(lambda a, b: run(a, b), ddl)


def _triangle_visits(stations: DataFrame, spec: MapSpec, by: str, max_block: int) -> DataFrame:
    """The triangles of crowded layers, once for every tile they reach. A triangle between grid lines
    holds no cell and is left out, so a tile receives few more triangles than it has cells."""
    layers = _bounds(stations, spec.margin, by)
    found = corners_of_crowded(stations, by, max_block).join(layers, by)
    radius, last = surface.radius_of(spec.sigma), F.lit(spec.tiles - 1)

    def span(axis: str) -> tuple[Column, Column]:
        """First and last grid line that may meet the triangle."""
        step = (F.col(f"{axis}1") - F.col(f"{axis}0")) / F.lit(spec.n - 1.0)
        ends = [(f(*[F.col(f"{c}_{axis}") for c in "abc"]) - F.col(f"{axis}0")) / step for f in (F.least, F.greatest)]
        return F.ceil(ends[0] - F.lit(1e-6)), F.floor(ends[1] + F.lit(1e-6))

    def tile(line: Column, shift: int) -> Column:
        return F.least(F.greatest(F.floor((line + F.lit(shift)) / F.lit(spec.tile)), F.lit(0)), last).cast("int")

    south, north = span("lat")
    west, east = span("lon")
    met = found.filter((south <= north) & (west <= east))
    rows = F.sequence(tile(south, -radius - 1), tile(north, radius + 1))
    cols = F.sequence(tile(west, -radius - 1), tile(east, radius + 1))
    return (
        met.withColumn("_tr", F.explode(rows)).withColumn("_tc", F.explode(cols))
        .select(by, "_tr", "_tc", *CORNER_COLUMNS)
    )


def _measured(points: DataFrame, value: str, by: str) -> DataFrame:
    cols = ["lon", "lat"]
    return points.filter(F.col(value).isNotNull()).select(
        by, "station_id", *[F.col(c).cast("double").alias(c) for c in cols],
        F.col(value).cast("double").alias("value"),
    )


def _interpolate(
    points: DataFrame, value: str, spec: MapSpec, by: str, max_block: int
) -> DataFrame:
    """Maps of the layers that fit a task, together with those of the crowded ones."""
    if spec.method not in ("idw", "nearest", "linear", "hybrid"):
        raise ValueError(f"unknown method {spec.method!r}")
    return blocks.by_size(
        _measured(points, value, by), by, max_block, lambda layers: _maps(layers, spec, by),
        lambda layers: _crowded_maps(layers, spec, by, max_block))


def interp_idw(
    points: DataFrame, value: str, n: int = 200, power: float = 1.0, margin: float = 0.1,
    by: str = "ts", max_block: int = blocks.MAX_BLOCK, tile: int = MapSpec.tile,
) -> DataFrame:
    """``ts, row, col, value``: mean of all stations weighted by 1 / (degrees^power + 1e-12)."""
    return _interpolate(points, value, MapSpec(n, "idw", power, margin=margin, tile=tile), by, max_block)


def _closest(
    stations: blocks.Stations, lon: np.ndarray, lat: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which station is nearest in degrees to each cell, and its distance in km."""
    best = surface.nearest(lon, lat, stations["lon"], stations["lat"])
    lat1, lat2 = np.radians(lat)[:, None], np.radians(stations["lat"])
    across = np.radians(stations["lon"][best] - lon) / 2
    a = np.sin((lat2[best] - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2)[best] * np.sin(across) ** 2
    return best, 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def interp_nearest(
    points: DataFrame, value: str, n: int = 200, margin: float = 0.1, by: str = "ts",
    max_block: int = blocks.MAX_BLOCK, tile: int = MapSpec.tile,
) -> DataFrame:
    """Value of the station nearest in degrees, the first by name of those equally near."""
    return _interpolate(points, value, MapSpec(n, "nearest", margin=margin, tile=tile), by, max_block)


def interp_linear(
    points: DataFrame, value: str, n: int = 200, margin: float = 0.1, by: str = "ts",
    max_block: int = blocks.MAX_BLOCK, tile: int = MapSpec.tile,
) -> DataFrame:
    """Barycentric value inside the Delaunay triangles (in degrees), null outside their hull."""
    return _interpolate(points, value, MapSpec(n, "linear", margin=margin, tile=tile), by, max_block)


def interp_hybrid(
    points: DataFrame, value: str, n: int = 200, margin: float = 0.1, by: str = "ts",
    max_block: int = blocks.MAX_BLOCK, tile: int = MapSpec.tile,
) -> DataFrame:
    """Linear inside the hull, nearest outside."""
    return _interpolate(points, value, MapSpec(n, "hybrid", margin=margin, tile=tile), by, max_block)


def interpolated_layer(
    points: DataFrame, value: str, n: int = 200, method: str = "hybrid", sigma: float = 0.8,
    max_km: float | None = 50.0, margin: float = 0.1, by: str = "ts",
    max_block: int = blocks.MAX_BLOCK, clip: bool = True, tile: int = MapSpec.tile,
) -> DataFrame:
    """The usual map of one variable: interpolate, smooth (``sigma`` 0 leaves it out), mask far
    cells (``max_km`` None leaves it out), clip to the range observed. One task does all of it for
    a tile; the nearest station is searched once for filling and masking."""
    spec = MapSpec(n, method, 1.0, sigma, max_km, clip, margin, tile)

    return _interpolate(points, value, spec, by, max_block)


def distance_mask(
    cells: DataFrame, points: DataFrame, value: str, n: int = 200, max_km: float = 50.0,
    margin: float = 0.1, by: str = "ts", max_block: int = blocks.MAX_BLOCK, tile: int = MapSpec.tile,
) -> DataFrame:
    """Cell values, of any origin, set to null where the station nearest in degrees is farther than
    ``max_km``. Cells meet the distances of their tile, one row per tile and chunk of stations, so
    neither cells nor stations are moved more than once; ``interpolated_layer`` masks without moving
    cells. Cells of a layer without stations are left out."""
    spec = MapSpec(n, "linear", max_km=max_km, margin=margin, tile=tile)
    ddl = f"{by} {cells.schema[by].dataType.simpleString()}, row int, col int, value double"
    arrow = blocks.arrow_schema(ddl)
    keys = [by, "_tr", "_tc"]

    def run(some: pa.Table, pieces: pa.Table) -> pa.Table:
        if not some.num_rows or not pieces.num_rows:
            return arrow.empty_table()
        (top, _), (left, right) = (spec.lines(some.column(k)[0].as_py()) for k in keys[1:])
        km = _stack(pieces, "km")
        km = km[_nearest_chunk(pieces), np.arange(km.shape[1])].reshape(-1, right - left)
        row, col = (some.column(c).to_numpy() for c in ("row", "col"))
        close = pa.array(km[row - top, col - left] <= max_km)
        value = pc.if_else(close, some.column("value"), pa.scalar(None, pa.float64()))
        return pa.table([some.column(by), some.column("row"), some.column("col"), value], schema=arrow)

    placed = cells.select(
        by, F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("double"),
        *[F.floor(F.col(c) / tile).cast("int").alias(k) for c, k in (("row", "_tr"), ("col", "_tc"))],
    )
    pieces = _pieces(_measured(points, value, by), spec, by, max_block)
    return (
        blocks.spread_evenly(placed, *keys).groupBy(*keys)
        .cogroup(blocks.spread_evenly(pieces, *keys).groupBy(*keys)).applyInArrow(run, ddl)
    )


def smooth_gaussian(
    cells: DataFrame, n: int, sigma: float = 0.8, truncate: float = 4.0, by: str = "ts",
    keep: tuple[str, ...] = (), tile: int = MapSpec.tile,
) -> DataFrame:
    """Gaussian smoothing of a full grid, edges mirrored, one pass along each axis; a null spreads
    to the cells that would use it. Cells go to their tile and, near its border, to the tiles whose
    rim they belong to. The double columns in ``keep`` pass through."""
    spec, radius = MapSpec(n, sigma=sigma, tile=tile), surface.radius_of(sigma, truncate)
    columns = ["row", "col", "value", *keep]
    ddl = ", ".join([f"{by} {cells.schema[by].dataType.simpleString()}, row int, col int, value double",
                     *[f"{c} double" for c in keep]])
    arrow = blocks.arrow_schema(ddl)
    keys = [by, "_tr", "_tc"]

    def run(table: pa.Table) -> pa.Table:
        inner = [spec.lines(table.column(k)[0].as_py()) for k in keys[1:]]
        outer = [surface.with_rim(*lines, radius, n) for lines in inner]
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        grid = np.full([high - low for low, high in outer], np.nan)
        grid[row - outer[0][0], col - outer[1][0]] = table.column("value").to_numpy().astype(float)
        grid = surface.blur(grid, *inner, n, sigma, truncate)
        own = (row >= inner[0][0]) & (row < inner[0][1]) & (col >= inner[1][0]) & (col < inner[1][1])
        mine = table.filter(pa.array(own))
        flat = grid[row[own] - inner[0][0], col[own] - inner[1][0]]
        out = {c: mine.column(c) for c in [by, "row", "col", *keep]}
        out["value"] = pa.array(flat, mask=np.isnan(flat))
        return pa.table([out[f.name] for f in arrow], schema=arrow)

    def tiles_of(line: str) -> Column:
        low, high = (F.floor((F.col(line) + F.lit(k)) / F.lit(tile)).cast("int") for k in (-radius, radius))
        return F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(spec.tiles - 1)))

    rows = cells.select(
        by, F.col("row").cast("int"), F.col("col").cast("int"),
        *[F.col(c).cast("double") for c in columns[2:]],
    )
    placed = rows.withColumn("_tr", F.explode(tiles_of("row"))).withColumn("_tc", F.explode(tiles_of("col")))
    return blocks.spread_evenly(placed, *keys).groupBy(*keys).applyInArrow(run, ddl)


def clip_to_observed(cells: DataFrame, points: DataFrame, value: str, by: str = "ts") -> DataFrame:
    """Cell values clipped to the range the stations of the layer report."""
    limits = points.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = F.col("value")
    return cells.join(limits, by).withColumn(
        "value", F.when(v.isNotNull(), F.least(F.greatest(v, F.col("_lo")), F.col("_hi")))
    ).drop("_lo", "_hi")


def dedupe_coordinates(points: DataFrame, *order_cols: Column | str, by: str = "ts") -> DataFrame:
    """First row per position of a layer."""
    return first_row(points, [by, "lat", "lon"], order_cols)


def map_layer(
    rows: DataFrame, variable: str | None = None, t=None, by: str = "ts"
) -> DataFrame:
    """Rows of one variable and time (all of them when not given) with the unit, display limits,
    a flag for exact zeros and the range of the layer (``low``, ``high``)."""
    if variable is not None:
        rows = rows.filter(F.col("variable") == variable)
    if t is not None:
        rows = rows.filter(F.col(by) == F.lit(t).cast("timestamp"))
    rows = rows.filter("value is not null")

    def lookup(table: Mapping[str, object]) -> Column:
        return F.try_element_at(
            F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("variable")
        )

    limits = rows.groupBy(by, "variable").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return rows.join(limits, [by, "variable"]).withColumns(
        {
            "unit": lookup(UNITS),
            "display_low": lookup({k: v[0] for k, v in DISPLAY_LIMITS.items()}),
            "display_high": lookup({k: v[1] for k, v in DISPLAY_LIMITS.items()}),
            "is_zero": F.col("value") == 0,
        }
    )


def contour_bands(
    cells: DataFrame, levels: list[float] | None = None, variable: str | None = None
) -> DataFrame:
    """Add ``band``, the number of contour levels at or below the value."""
    levels = CONTOUR_LEVELS[variable] if levels is None else levels
    v = F.col("value")
    band = sum((F.when(v >= F.lit(float(x)), 1).otherwise(0) for x in levels), F.lit(0))
    return cells.withColumn("band", F.when(v.isNotNull(), band))


def wind_arrows(
    obs: DataFrame, scale: float = 0.05, max_arrows: int = 200, meteorological: bool = False,
    by: str = "ts",
) -> DataFrame:
    """Arrow components per station, one station in every ``max(1, stations / max_arrows)`` by
    name. The plain form draws cos and sin of the direction; the meteorological one points where
    the wind blows to."""
    angle = F.radians("wind_dir")
    speed = F.col("wind_speed") * F.lit(float(scale))
    u, v = (-F.sin(angle), -F.cos(angle)) if meteorological else (F.cos(angle), F.sin(angle))
    counts = obs.groupBy(by).agg(
        F.greatest(F.floor(F.count(F.lit(1)) / F.lit(max_arrows)), F.lit(1)).alias("_skip")
    )
    placed = ordinal(obs, "station_id", "_i", [by]).join(counts, by)
    return placed.filter(F.col("_i") % F.col("_skip") == 0).select(
        by, "station_id", "lon", "lat", (u * speed).alias("arrow_u"), (v * speed).alias("arrow_v")
    )

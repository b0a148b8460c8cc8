"""Arithmetic on one tile of a map grid: weighted means, nearest station, triangles, smoothing.

A tile is the outer product of its grid lines: ``lat`` for the rows, ``lon`` for the columns. All
results are arrays of that shape. Nothing here knows about Spark.
"""

from __future__ import annotations

import numpy as np

#: Elements of a distance block, small enough for the cache of a core.
STRIP = 1 << 16
LEAF = 4
#: So few stations are compared with every cell.
FEW = 512
#: So many stations at a time are weighed.
SOME = 4096


def weighted_sums(
    lon: np.ndarray, lat: np.ndarray, x: np.ndarray, y: np.ndarray, value: np.ndarray, power: float
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value / (degrees^power + 1e-12) and of the weights over all stations."""
    total, weight = np.zeros((len(lat), len(lon))), np.zeros((len(lat), len(lon)))
    for low in range(0, len(x), SOME):
        some = slice(low, low + SOME)
        v, few = value[some], len(x) <= FEW
        east, north = (lon[:, None] - x[some]) ** 2, (lat[:, None] - y[some]) ** 2
        step = max(1, STRIP // len(v))
        for r in range(len(lat)):
            for c in range(0, len(lon), step):
                w = east[c:c + step] + north[r]
                if power == 1.0:
                    np.sqrt(w, out=w)
                elif power != 2.0:
                    np.power(w, power / 2.0, out=w)
                w += 1e-12
                if few:
                    # term by term in order, so that equal values on a contour stay on its side
                    total[r, c:c + step] += np.add.accumulate(v / w, axis=1)[:, -1]
                    weight[r, c:c + step] += np.add.accumulate(1.0 / w, axis=1)[:, -1]
                    continue
                np.reciprocal(w, out=w)
                total[r, c:c + step] += w @ v
                weight[r, c:c + step] += w.sum(axis=1)
    return total, weight


class StationTree:
    """A balanced k-d tree as arrays: the nodes of a level are equal slices of one station order.
    Stations fill the last leaf up by repeating the first, which changes no minimum."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x, y
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        size = LEAF << self.depth
        order = np.concatenate([np.arange(len(x)), np.zeros(size - len(x), dtype=np.int64)])[None, :]
        for _ in range(self.depth):
            px, py = x[order], y[order]
            wide = np.ptp(px, axis=1) >= np.ptp(py, axis=1)
            along = np.argsort(np.where(wide[:, None], px, py), axis=1, kind="stable")
            order = np.take_along_axis(order, along, axis=1).reshape(2 * len(order), -1)
        self.leaves = np.sort(order, axis=1)
        self.boxes = []
        for level in range(self.depth + 1):
            px, py = (v[order].reshape(1 << level, -1) for v in (x, y))
            self.boxes.append((px.min(axis=1), px.max(axis=1), py.min(axis=1), py.max(axis=1)))

    def nearest(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """All points go down level by level. A node is left out where its box lies farther off
        than the farthest corner of another, so a point keeps a few nodes however stations cluster."""
        point, node = np.arange(len(px)), np.zeros(len(px), dtype=np.int64)
        for level in range(1, self.depth + 1):
            point = np.repeat(point, 2)
            node = (node[:, None] * 2 + np.arange(2)).ravel()
            west, east, south, north = (side[node] for side in self.boxes[level])
            qx, qy = px[point], py[point]
            far = np.maximum(east - qx, qx - west) ** 2 + np.maximum(north - qy, qy - south) ** 2
            gap = (np.maximum(np.maximum(west - qx, qx - east), 0.0) ** 2
                   + np.maximum(np.maximum(south - qy, qy - north), 0.0) ** 2)
            reach = np.minimum.reduceat(far, np.searchsorted(point, np.arange(len(px))))
            # the slack covers the rounding of the distances compared in the end
            kept = gap <= (reach * (1.0 + 1e-9) + 1e-18)[point]
            point, node = point[kept], node[kept]
        stations = self.leaves[node]
        dx, dy = px[point, None] - self.x[stations], py[point, None] - self.y[stations]
        d = np.sqrt(dx * dx + dy * dy)
        least = np.minimum.reduceat(d.min(axis=1), np.searchsorted(point, np.arange(len(px))))
        tied = np.where(d == least[point, None], stations, len(self.x)).min(axis=1)
        return np.minimum.reduceat(tied, np.searchsorted(point, np.arange(len(px))))


def nearest(lon: np.ndarray, lat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the station nearest in degrees to every cell, the first of those equally near."""
    found = np.empty((len(lat), len(lon)), dtype=np.int64)
    if len(x) > FEW:
        tree = StationTree(x, y)
        step = max(1, STRIP // (4 * len(lon)))
        for r in range(0, len(lat), step):
            rows = lat[r:r + step]
            flat = tree.nearest(np.tile(lon, len(rows)), np.repeat(rows, len(lon)))
            found[r:r + step] = flat.reshape(len(rows), len(lon))
        return found
    east, north = (lon[:, None] - x) ** 2, (lat[:, None] - y) ** 2
    step = max(1, STRIP // len(x))
    for r in range(len(lat)):
        for c in range(0, len(lon), step):
            found[r, c:c + step] = np.sqrt(east[c:c + step] + north[r]).argmin(axis=1)
    return found


def draw(
    corners: dict[str, np.ndarray], lon: np.ndarray, lat: np.ndarray, right: float, up: float
) -> np.ndarray:
    """Barycentric values of the cells inside some triangles, nan elsewhere. ``right`` and ``up``
    are the steps between grid lines. Every triangle visits, on each of its grid rows, only the
    columns between its sides; where triangles share a border the smaller value stays."""
    values = np.full(len(lat) * len(lon), np.inf)
    x, y, v = (np.stack([corners[f"{c}_{p}"] for c in "abc"], axis=1) for p in ("lon", "lat", "v"))
    least, most = y.min(axis=1), y.max(axis=1)
    low = np.maximum(np.floor((least - lat[0]) / up), 0).astype(np.int64)
    high = np.minimum(np.ceil((most - lat[0]) / up), len(lat) - 1).astype(np.int64)
    t, i = _runs(low, np.maximum(high - low + 1, 0))
    # a row that only touches the triangle between grid lines takes the nearest height inside it
    at = np.clip(lat[i], least[t], most[t])[:, None]
    x1, y1 = x[t], y[t]
    x2, y2 = np.roll(x1, -1, axis=1), np.roll(y1, -1, axis=1)
    flat = y1 == y2
    cross = np.where(flat, x1, x1 + (at - y1) / np.where(flat, 1.0, y2 - y1) * (x2 - x1))
    met = (at >= np.minimum(y1, y2)) & (at <= np.maximum(y1, y2))
    ends = np.where(met & flat, x2, cross)
    left = np.where(met, np.minimum(cross, ends), np.inf).min(axis=1)
    past = np.where(met, np.maximum(cross, ends), -np.inf).max(axis=1)
    first = np.clip(np.floor((left - lon[0]) / right), 0, len(lon)).astype(np.int64)
    last = np.clip(np.ceil((past - lon[0]) / right), -1, len(lon) - 1).astype(np.int64)
    width = np.maximum(last - first + 1, 0)
    part = np.cumsum(width) // (16 * STRIP)
    for p in np.unique(part):
        mine = part == p
        span, j = _runs(first[mine], width[mine])
        k, row = t[mine][span], i[mine][span]
        ax, ay = x[k, 0] - x[k, 2], y[k, 0] - y[k, 2]
        bx, by = x[k, 1] - x[k, 2], y[k, 1] - y[k, 2]
        det = ax * by - bx * ay
        px, py = lon[j] - x[k, 2], lat[row] - y[k, 2]
        wa, wb = (px * by - bx * py) / det, (ax * py - px * ay) / det
        wc = 1.0 - wa - wb
        inside = np.minimum(np.minimum(wa, wb), wc) >= -1e-12
        mixed = wa * v[k, 0] + wb * v[k, 1] + wc * v[k, 2]
        np.fmin.at(values, (row * len(lon) + j)[inside], mixed[inside])
    values[np.isinf(values)] = np.nan
    return values.reshape(len(lat), len(lon))


def _runs(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of whole numbers: which run each number belongs to, and the number."""
    owner = np.repeat(np.arange(len(first)), length)
    start = np.cumsum(length) - length
    return owner, np.arange(len(owner)) - start[owner] + first[owner]


def radius_of(sigma: float, truncate: float = 4.0) -> int:
    return int(truncate * sigma + 0.5)


def with_rim(low: int, high: int, radius: int, n: int) -> tuple[int, int]:
    """Grid lines that lines low to high - 1 of ``n`` need: mirrored ones lie among them."""
    return max(0, low - radius), min(n, high + radius)


def blur(
    values: np.ndarray, rows: tuple[int, int], cols: tuple[int, int], n: int,
    sigma: float, truncate: float = 4.0,
) -> np.ndarray:
    """Gaussian means of the cells in ``rows`` and ``cols`` from ``values`` that cover them with
    their rim; edges of the whole grid are mirrored, nan spreads to the cells that use it."""
    radius = radius_of(sigma, truncate)
    reach = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (reach / sigma) ** 2)
    weights /= weights.sum()
    for low, high in (rows, cols):
        first = with_rim(low, high, radius, n)[0]
        line = (np.arange(low, high)[:, None] + reach) % (2 * n)
        line = np.where(line < n, line, 2 * n - 1 - line) - first
        out = np.zeros((high - low, values.shape[1]))
        for k, w in enumerate(weights):
            out += values[line[:, k]] * w
        values = out.T
    return values

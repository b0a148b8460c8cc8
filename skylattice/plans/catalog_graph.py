"""Queries that build and use the hourly station graphs, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylattice.constants import EDGE_ATTRIBUTES, EDGE_DIFFS
from skylattice.operators import graph as gr
from skylattice.operators.delaunay import delaunay_edges, delaunay_triangles
from skylattice.plans import station_events as ev
from skylattice.plans.catalog_rows import bearing_sql, haversine_sql, rounded
from skylattice.plans.oracle import r, rr, sql
from skylattice.session import materialize

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def cart(table: str) -> str:
    return (f"cart AS (SELECT *, (6371e0 + alt / 1000e0) * cos(radians(lat)) * cos(radians(lon)) AS x,"
            " (6371e0 + alt / 1000e0) * cos(radians(lat)) * sin(radians(lon)) AS y,"
            " (6371e0 + alt / 1000e0) * sin(radians(lat)) AS z,"
            f" lon * cos(radians(41.7e0)) AS px, lat AS py FROM {table})")


# The circle through a and b with its centre t steps along the normal holds no other station for
# t between the largest bound from the right and the smallest from the left. If both bounds are one,
# a and b lie on a circle with others, and are joined if one of them is first of it by name.
DELAUNAY = """bounds_of AS (SELECT ts, s, d, c, CASE WHEN abs(cr) > 1e-12 THEN q / (2 * cr) END AS t,
     CASE WHEN abs(cr) > 1e-12 THEN sign(cr) ELSE 0 END AS side, q
   FROM (SELECT a.ts, a.station_id AS s, b.station_id AS d, c.station_id AS c,
      (b.px - a.px) * (c.py - a.py) - (b.py - a.py) * (c.px - a.px) AS cr,
      pow(c.px - (a.px + b.px) / 2, 2) + pow(c.py - (a.py + b.py) / 2, 2)
        - (pow(b.px - a.px, 2) + pow(b.py - a.py, 2)) / 4 AS q
    FROM cart a JOIN cart b ON a.ts = b.ts AND a.station_id < b.station_id
    LEFT JOIN cart c ON c.ts = a.ts AND c.station_id <> a.station_id
      AND c.station_id <> b.station_id)),
 tested AS (SELECT ts, s, d, coalesce(max(t) FILTER (side < 0), -1e300) AS lo,
     coalesce(min(t) FILTER (side > 0), 1e300) AS hi, coalesce(bool_or(side = 0 AND q < 0), FALSE) AS blocked
   FROM bounds_of GROUP BY ts, s, d),
 free AS (SELECT *, hi - lo <= 1e-8 * (1 + abs(lo)) AS tied FROM tested
   WHERE hi - lo >= -1e-8 * (1 + abs(lo)) AND NOT blocked),
 sides AS (SELECT ts, s, d FROM free WHERE NOT tied UNION ALL
   SELECT f.ts, f.s, f.d FROM free f JOIN bounds_of b ON b.ts = f.ts AND b.s = f.s AND b.d = f.d
   WHERE tied AND abs(b.t - lo) <= 1e-8 * (1 + abs(lo)) GROUP BY f.ts, f.s, f.d HAVING f.s < min(b.c)),
 delaunay AS (SELECT ts, s AS src, d AS dst FROM sides UNION ALL SELECT ts, d, s FROM sides)"""

DIST = """dist AS (SELECT a.ts, a.station_id AS src, b.station_id AS dst,
   sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d,
   abs(a.alt - b.alt) / 1000e0 AS gap
   FROM cart a JOIN cart b ON a.ts = b.ts AND a.station_id <> b.station_id)"""

ADAPTIVE = """kth AS (SELECT ts, src, max(d) * 1.3e0 AS rad FROM (
   SELECT *, row_number() OVER (PARTITION BY ts, src ORDER BY d) AS rn FROM dist)
   WHERE rn <= 4 GROUP BY ts, src),
 adaptive AS (SELECT dist.ts, dist.src, dist.dst FROM dist JOIN kth ON dist.ts = kth.ts
   AND dist.src = kth.src WHERE d <= rad)"""

RADIUS = """quant AS (SELECT ts, quantile_cont(d, 0.55e0) AS rad FROM (SELECT ts, d FROM dist
   UNION ALL SELECT ts, 0e0 FROM cart) GROUP BY ts),
 radius AS (SELECT dist.ts, src, dst FROM dist JOIN quant ON dist.ts = quant.ts
   WHERE d <= rad * (1e0 + 1e-9))"""


def base(*parts: str) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
    return (f"base AS (SELECT u.ts, u.src, u.dst, count(*) AS m FROM ({union}) u JOIN dist"
            " ON dist.ts = u.ts AND dist.src = u.src AND dist.dst = u.dst WHERE gap <= 0.15e0"
            " GROUP BY u.ts, u.src, u.dst)")


RESCUED = f"""lonely AS (SELECT * FROM cart c WHERE NOT EXISTS (SELECT 1 FROM base
   WHERE base.ts = c.ts AND (src = c.station_id OR dst = c.station_id))),
 nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts, a ORDER BY km, b) AS rn
   FROM (SELECT l.ts, l.station_id AS a, c.station_id AS b,
       {haversine_sql('l', 'c', '1e-8')} AS km, abs(l.alt - c.alt) / 1000e0 AS gap
     FROM lonely l JOIN cart c ON l.ts = c.ts AND l.station_id <> c.station_id)
   WHERE km <= 80e0 AND gap <= 0.15e0) WHERE rn = 1),
 rescued AS (SELECT ts, a AS src, b AS dst FROM nearest UNION SELECT ts, b, a FROM nearest)"""

_diffs = ", ".join(f"a.{c} - b.{c} AS {n}" for n, c in EDGE_DIFFS.items())


def described(pairs: str) -> str:
    return f"""ends AS (SELECT e.ts, e.src, e.dst, e.m, e.saved,
     {haversine_sql('a', 'b', '1e-8')} AS km, abs(a.alt_norm - b.alt_norm) AS abs_alt, {_diffs},
     radians({bearing_sql('a', 'b')}) AS bearing
   FROM ({pairs}) e JOIN features a ON a.ts = e.ts AND a.station_id = e.src
   JOIN features b ON b.ts = e.ts AND b.station_id = e.dst),
 described AS (SELECT *, km / 100e0 AS dist_scaled,
   CASE WHEN km > 0 THEN abs_alt / km ELSE 0e0 END AS slope,
   sin(bearing) AS bearing_sin, cos(bearing) AS bearing_cos FROM ends)"""


_neg = ", ".join(
    (f"-{c} AS {c}" if c in gr.SIGNED else c) for c in EDGE_ATTRIBUTES
)
BOTH = f"""both_ways AS (
  SELECT ts, src, dst, m, 0 AS flipped, {', '.join(EDGE_ATTRIBUTES)} FROM described
  UNION ALL SELECT ts, dst, src, m, 1, {_neg} FROM described WHERE NOT saved)"""

FIRST = f"""kept AS (SELECT ts, src, dst, {', '.join(EDGE_ATTRIBUTES)},
   CAST(total AS BIGINT) AS multiplicity FROM (SELECT *,
     row_number() OVER (PARTITION BY ts, src, dst ORDER BY flipped) AS rn,
     sum(m) OVER (PARTITION BY ts, src, dst) AS total FROM both_ways WHERE src <> dst)
   WHERE rn = 1)"""

SUMMED = ("summed AS (SELECT ts, src, dst, "
          + ", ".join(f"sum({c} * m) AS {c}" for c in EDGE_ATTRIBUTES)
          + ", CAST(sum(m) AS BIGINT) AS multiplicity FROM both_ways WHERE src <> dst"
          " GROUP BY ts, src, dst)")

PLAIN = "SELECT ts, src, dst, 1 AS m, FALSE AS saved FROM delaunay"
ALL = ("SELECT ts, src, dst, m, FALSE AS saved FROM base UNION ALL"
       " SELECT ts, src, dst, 1, TRUE FROM rescued")
TWO = [cart("features"), DELAUNAY, DIST, ADAPTIVE, base("delaunay", "adaptive"), RESCUED]
GRAPH = [*TWO, described(ALL), BOTH, FIRST]


def plain_edges(features: DataFrame) -> DataFrame:
    return delaunay_edges(features).drop("alt_diff_km")


# --- structure -----------------------------------------------------------------------------


@query("delaunay_edges", sql("points", "SELECT ts, src, dst FROM delaunay", cart("points"), DELAUNAY))
def _(s, d):
    return delaunay_edges(materialize(ev.points(s, d))).select("ts", "src", "dst")


_TRIANGLES = """tri AS (SELECT x.ts, x.src AS a, x.dst AS b, y.dst AS c FROM delaunay x
   JOIN delaunay y ON x.ts = y.ts AND x.dst = y.src AND x.src < x.dst AND y.src < y.dst
   JOIN delaunay z ON z.ts = x.ts AND z.src = x.src AND z.dst = y.dst),
 placed AS (SELECT tri.*, p.px AS ax, p.py AS ay, q.px - p.px AS bx, q.py - p.py AS by_,
     r.px - p.px AS cx, r.py - p.py AS cy FROM tri
   JOIN cart p ON p.ts = tri.ts AND p.station_id = a JOIN cart q ON q.ts = tri.ts AND q.station_id = b
   JOIN cart r ON r.ts = tri.ts AND r.station_id = c),
 round AS (SELECT *, (cy * (bx * bx + by_ * by_) - by_ * (cx * cx + cy * cy)) / (2 * (bx * cy - by_ * cx)) AS ux,
     (bx * (cx * cx + cy * cy) - cx * (bx * bx + by_ * by_)) / (2 * (bx * cy - by_ * cx)) AS uy
   FROM placed WHERE abs(bx * cy - by_ * cx) > 1e-12),
 triangles AS (SELECT ts, a, b, c FROM round t WHERE NOT EXISTS (SELECT 1 FROM cart o
   WHERE o.ts = t.ts AND o.station_id NOT IN (t.a, t.b, t.c)
     AND pow(o.px - t.ax - ux, 2) + pow(o.py - t.ay - uy, 2) < (ux * ux + uy * uy) * (1 - 1e-9)))"""


@query("delaunay_triangles",
       sql("points", "SELECT ts, least(a, b, c) AS a, b, c FROM triangles", cart("points"), DELAUNAY,
           _TRIANGLES))
def _(s, d):
    found = delaunay_triangles(materialize(ev.points(s, d)))
    return found.select("ts", "a", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c"))


# Positions rounded to whole degrees: nearly every station has three others on a circle with it.
LATTICE = """lattice AS (SELECT * FROM (SELECT * REPLACE (round(lat) AS lat, round(lon) AS lon) FROM points)
   QUALIFY row_number() OVER (PARTITION BY ts, lat, lon ORDER BY station_id) = 1)"""


def lattice_points(spark, sf_dir) -> DataFrame:
    points = ev.points(spark, sf_dir)
    return materialize(points.withColumns({c: F.round(c) for c in ("lat", "lon")}))


@query("delaunay_edges_lattice",
       sql("points", "SELECT ts, src, dst FROM delaunay", LATTICE, cart("lattice"), DELAUNAY))
def _(s, d):
    return plain_edges(lattice_points(s, d))


@query("delaunay_triangles_lattice",
       sql("points", "SELECT ts, least(a, b, c) AS a, b, c FROM triangles", LATTICE, cart("lattice"),
           DELAUNAY, _TRIANGLES))
def _(s, d):
    found = delaunay_triangles(lattice_points(s, d))
    return found.select("ts", "a", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c"))


@query("adaptive_radius_edges",
       sql("points", "SELECT ts, src, dst FROM adaptive", cart("points"), DIST, ADAPTIVE))
def _(s, d):
    return gr.adaptive_radius_edges(materialize(ev.points(s, d))).select("ts", "src", "dst")


#: Cuts every hour of the test tables into several tiles.
SMALL_BLOCK = 4


@query("delaunay_edges_tiled", sql("points", "SELECT ts, src, dst FROM delaunay", cart("points"), DELAUNAY))
def _(s, d):
    found = delaunay_edges(materialize(ev.points(s, d)), max_block=SMALL_BLOCK)
    return found.drop("alt_diff_km")


@query("delaunay_edges_lattice_tiled",
       sql("points", "SELECT ts, src, dst FROM delaunay", LATTICE, cart("lattice"), DELAUNAY))
def _(s, d):
    return delaunay_edges(lattice_points(s, d), max_block=SMALL_BLOCK).drop("alt_diff_km")


@query("adaptive_radius_edges_tiled",
       sql("points", "SELECT ts, src, dst FROM adaptive", cart("points"), DIST, ADAPTIVE))
def _(s, d):
    found = gr.adaptive_radius_edges(materialize(ev.points(s, d)), max_block=SMALL_BLOCK)
    return found.select("ts", "src", "dst")


_WITHIN = sql("points", "SELECT ts, src, dst FROM dist WHERE d <= 60e0", cart("points"), DIST)


@query("radius_km_edges", _WITHIN)
def _(s, d):
    return gr.radius_km_edges(materialize(ev.points(s, d)), 60.0).select("ts", "src", "dst")


@query("radius_km_edges_tiled", _WITHIN)
def _(s, d):
    found = gr.radius_km_edges(materialize(ev.points(s, d)), 60.0, max_block=SMALL_BLOCK)
    return found.select("ts", "src", "dst")


@query("radius_edges", sql("points", "SELECT ts, src, dst FROM radius", cart("points"), DIST, RADIUS))
def _(s, d):
    return gr.radius_edges(materialize(ev.points(s, d)), 0.55).select("ts", "src", "dst")


_QUANTILE = sql("points", f"SELECT ts, {r('rad', 'radius')} FROM quant", cart("points"), DIST, RADIUS)


@query("radius_at_quantile", _QUANTILE)
def _(s, d):
    return gr.radius_at_quantile(materialize(ev.points(s, d)), 0.55)


@query("radius_at_quantile_cut", _QUANTILE)
def _(s, d):
    return gr.radius_at_quantile(materialize(ev.points(s, d)), 0.55, max_block=SMALL_BLOCK)


@query("max_alt_filter",
       sql("points", f"SELECT delaunay.ts, delaunay.src, delaunay.dst, {r('gap', 'alt_diff_km')}"
                     " FROM delaunay JOIN dist ON dist.ts = delaunay.ts AND dist.src = delaunay.src"
                     " AND dist.dst = delaunay.dst WHERE gap <= 0.15e0",
           cart("points"), DELAUNAY, DIST))
def _(s, d):
    return gr.max_alt_filter(delaunay_edges(materialize(ev.points(s, d))))


_WIDE = RESCUED.replace("80e0", "300e0").replace("base.ts", "low.ts").replace("FROM base", "FROM low")


_RESCUE = sql("points", "SELECT ts, src, dst FROM rescued", cart("points"), DELAUNAY, DIST,
              "low AS (SELECT delaunay.* FROM delaunay JOIN dist ON dist.ts = delaunay.ts AND"
              " dist.src = delaunay.src AND dist.dst = delaunay.dst WHERE gap <= 0.02e0)", _WIDE)


def _rescue(spark, sf_dir, **options) -> DataFrame:
    points = materialize(ev.points(spark, sf_dir))
    level = gr.max_alt_filter(delaunay_edges(points), 0.02)
    return gr.rescue_isolated(points, level, max_km=300.0, **options).select("ts", "src", "dst")


@query("rescue_isolated", _RESCUE)
def _(s, d):
    return _rescue(s, d)


@query("rescue_isolated_tiled", _RESCUE)
def _(s, d):
    return _rescue(s, d, max_block=SMALL_BLOCK)


# --- attributes --------------------------------------------------------------------------------

ATTRS = rr(*EDGE_ATTRIBUTES)
_DESCRIBED = [cart("features"), DELAUNAY, described(PLAIN)]


def _described(s, d) -> tuple[DataFrame, DataFrame]:
    nodes = materialize(ev.features(s, d))
    return nodes, gr.edge_attributes(plain_edges(nodes), nodes)


@query("edge_attributes", sql("features", f"SELECT ts, src, dst, {ATTRS} FROM described", *_DESCRIBED))
def _(s, d):
    return _described(s, d)[1]


_STRAIGHT = """straight AS (SELECT e.ts, e.src, e.dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS line
   FROM delaunay e JOIN cart a ON a.ts = e.ts AND a.station_id = e.src JOIN cart b ON b.ts = e.ts AND b.station_id = e.dst)"""


@query("edge_attributes_cartesian",
       sql("features", "SELECT d.ts, d.src, d.dst, "
           + rr(*[c for c in EDGE_ATTRIBUTES if c not in ("dist_scaled", "slope", "bearing_sin", "bearing_cos")])
           + f", {r('line / 100e0', 'dist_scaled')}, {r('CASE WHEN line > 0 THEN abs_alt / line ELSE 0e0 END', 'slope')},"
           " 0e0 AS bearing_sin, 0e0 AS bearing_cos FROM described d JOIN straight USING (ts, src, dst)",
           *_DESCRIBED, _STRAIGHT))
def _(s, d):
    nodes = materialize(ev.features(s, d))
    return gr.edge_attributes(plain_edges(nodes), nodes, cartesian=True)


@query("reverse_edges",
       sql("features", f"SELECT ts, src, dst, {ATTRS}, flipped = 1 AS flipped FROM both_ways",
           *_DESCRIBED, BOTH))
def _(s, d):
    return gr.reverse_edges(_described(s, d)[1])


@query("drop_self_loops",
       sql("points", "SELECT ts, src, dst FROM (SELECT * FROM delaunay UNION ALL"
                     " SELECT ts, station_id, station_id FROM points) WHERE src <> dst",
           cart("points"), DELAUNAY))
def _(s, d):
    points = materialize(ev.points(s, d))
    loops = points.select("ts", F.col("station_id").alias("src"), F.col("station_id").alias("dst"))
    edges = delaunay_edges(points).select("ts", "src", "dst").unionByName(loops)
    return gr.drop_self_loops(edges)


@query("coalesce_edges_first",
       sql("features", f"SELECT ts, src, dst, {ATTRS}, multiplicity FROM kept", *_DESCRIBED, BOTH, FIRST))
def _(s, d):
    return gr.coalesce_edges(gr.reverse_edges(_described(s, d)[1]), "first")


@query("coalesce_edges_sum",
       sql("features", f"SELECT ts, src, dst, {ATTRS}, multiplicity FROM summed",
           *_DESCRIBED, BOTH, SUMMED))
def _(s, d):
    return gr.coalesce_edges(gr.reverse_edges(_described(s, d)[1]), "sum")


@query("edge_weight",
       sql("features", f"SELECT ts, src, dst, {r('exp(-km / 75e0)', 'weight')},"
                       f" {r('exp(-dist_scaled / 75e0)', 'weight_scaled')} FROM described", *_DESCRIBED))
def _(s, d):
    edges = gr.edge_weight(_described(s, d)[1])
    scaled = gr.edge_weight(edges.withColumnRenamed("weight", "plain"), scaled=True)
    return scaled.select(
        "ts", "src", "dst", F.col("plain").alias("weight"), F.col("weight").alias("weight_scaled")
    )


@query("graph_metadata",
       sql("features", "SELECT n.ts, n.nodes, coalesce(e.directed, 0) // 2 AS edges, "
           + r("2e0 * (coalesce(e.directed, 0) // 2) / n.nodes", "mean_degree") + ", "
           + r("coalesce(e.rad, 0e0)", "effective_radius")
           + " FROM (SELECT ts, count(*) AS nodes FROM features GROUP BY ts) n LEFT JOIN"
           " (SELECT ts, count(*) AS directed, avg(dist_scaled) AS rad FROM described GROUP BY ts) e"
           " ON n.ts = e.ts", *_DESCRIBED))
def _(s, d):
    nodes, edges = _described(s, d)
    return gr.graph_metadata(nodes, edges)


@query("neighbors",
       sql("features", f"SELECT ts, src, degree, CAST(rank AS INTEGER) AS rank, dst, {r('km')} FROM (SELECT *, count(*) OVER"
                       " (PARTITION BY ts, src) AS degree, row_number() OVER"
                       " (PARTITION BY ts, src ORDER BY dst) AS rank FROM described) WHERE rank <= 3",
           *_DESCRIBED))
def _(s, d):
    return gr.neighbors(_described(s, d)[1], k=3)


_MIX = ["temp", "humidity", "pressure"]


@query("propagate",
       sql("features", "SELECT x.ts, x.station_id, " + ", ".join(
           r(f"(coalesce(s.s_{c}, 0e0) + x.{c} / sqrt(x.deg)) / sqrt(x.deg)", f"nbr_{c}") for c in _MIX)
           + " FROM rooted x LEFT JOIN sums s ON s.ts = x.ts AND s.station_id = x.station_id",
           *_DESCRIBED,
           "rooted AS (SELECT f.*, 1e0 + coalesce(w, 0e0) AS deg FROM features f LEFT JOIN"
           " (SELECT ts AS t, dst, sum(dist_scaled) AS w FROM described GROUP BY ts, dst) i"
           " ON i.t = f.ts AND i.dst = f.station_id)",
           "sums AS (SELECT e.ts, e.dst AS station_id, " + ", ".join(
               f"sum(e.dist_scaled * x.{c} / sqrt(x.deg)) AS s_{c}" for c in _MIX)
           + " FROM described e JOIN rooted x ON x.ts = e.ts AND x.station_id = e.src"
           " GROUP BY e.ts, e.dst)"))
def _(s, d):
    nodes, edges = _described(s, d)
    return gr.propagate(nodes, materialize(edges), _MIX)


# --- whole graph ---------------------------------------------------------------------------------


@query("build_graph_edges",
       sql("features", f"SELECT ts, src, dst, {ATTRS}, multiplicity,"
                       f" {r('exp(-dist_scaled * 100e0 / 75e0)', 'weight')} FROM kept", *GRAPH))
def _(s, d):
    return gr.build_graph(ev.features(s, d)).edges


@query("build_graph_multiscale",
       sql("features", f"SELECT ts, src, dst, {ATTRS}, multiplicity,"
                       f" {r('exp(-dist_scaled / 75e0)', 'weight')} FROM summed",
           cart("features"), DELAUNAY, DIST, ADAPTIVE, RADIUS, base("delaunay", "adaptive", "radius"),
           RESCUED, described(ALL), BOTH, SUMMED))
def _(s, d):
    options = gr.GraphOptions(multiscale_quantile=0.55, coalesce="sum", scaled_weight=True)
    return gr.build_graph(ev.features(s, d), options).edges


@query("build_graph_meta",
       sql("features", "SELECT n.ts, n.nodes, coalesce(e.directed, 0) // 2 AS edges, "
           + r("2e0 * (coalesce(e.directed, 0) // 2) / n.nodes", "mean_degree") + ", "
           + r("coalesce(e.rad, 0e0)", "effective_radius")
           + " FROM (SELECT ts, count(*) AS nodes FROM features GROUP BY ts) n LEFT JOIN"
           " (SELECT ts, count(*) AS directed, avg(dist_scaled) AS rad FROM kept GROUP BY ts) e"
           " ON n.ts = e.ts", *GRAPH))
def _(s, d):
    return gr.build_graph(ev.features(s, d)).meta

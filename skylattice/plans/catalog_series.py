"""Queries on sequences, forecasts, scores and run logs, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylattice.constants import FEATURE_COLUMNS, METRICS, TARGET_COLUMNS
from skylattice.operators import evaluate as evl
from skylattice.operators import forecast as fc
from skylattice.operators import graph as gr
from skylattice.operators import runlog as rl
from skylattice.operators import stats as st
from skylattice.operators import windows as wn
from skylattice.operators.delaunay import delaunay_edges
from skylattice.plans import oracle as o
from skylattice.plans import station_events as ev
from skylattice.plans.catalog_graph import DELAUNAY, PLAIN, cart, described
from skylattice.plans.catalog_rows import corr_sql, rounded
from skylattice.plans.oracle import r, rr, sql
from skylattice.session import materialize

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None, places: int = 6):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), places)
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# --- indexes and sequences -------------------------------------------------------------------

INDEX = ("node_index AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS node_idx"
         " FROM (SELECT DISTINCT station_id FROM features))")
SNAPS = ("snaps AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i"
         " FROM (SELECT DISTINCT ts FROM features))")
WINDOWS = """starts AS (SELECT i AS start FROM snaps WHERE i % 12 = 0
   AND i + 54 <= (SELECT count(*) FROM snaps)),
 win AS (SELECT start, CAST(i - start AS INTEGER) AS step,
   CASE WHEN i - start < 48 THEN 'input' ELSE 'target' END AS role, ts
   FROM starts JOIN snaps ON i BETWEEN start AND start + 53)"""
NAMED = """seqs AS (SELECT start, max(ts) FILTER (WHERE role = 'input') AS input_end,
   strftime(min(ts), '%Y%m%d%H') || '_' || strftime(max(ts) FILTER (WHERE role = 'input'), '%Y%m%d%H')
     AS seq_id FROM win GROUP BY start),
 named AS (SELECT win.*, input_end, seq_id FROM win JOIN seqs ON win.start = seqs.start)"""
SEQ = [SNAPS, WINDOWS, NAMED]


def _named(features: DataFrame) -> DataFrame:
    return wn.sequence_id(wn.sliding_windows(features))


def _sequences(s, d) -> DataFrame:
    features = materialize(ev.features(s, d))
    return wn.sequence_rows(_named(features), features)


@query("node_index", sql("features", "SELECT station_id, node_idx FROM node_index", INDEX))
def _(s, d):
    return wn.node_index(ev.features(s, d))


@query("node_catalog",
       sql("obs", f"SELECT station_id, {rr('lat', 'lon', 'alt')} FROM (SELECT *, row_number() OVER"
                  " (PARTITION BY station_id ORDER BY ts, lat, lon, alt) AS k FROM obs) WHERE k = 1"))
def _(s, d):
    return wn.node_catalog(ev.obs(s, d))


@query("sliding_windows",
       sql("features", "SELECT start, step, role, ts FROM win", SNAPS, WINDOWS))
def _(s, d):
    return wn.sliding_windows(ev.features(s, d))


@query("sliding_windows_contiguous",
       sql("features", "SELECT start, step, role, ts FROM (SELECT *, max(ts) OVER (PARTITION BY start)"
                       " - min(ts) OVER (PARTITION BY start) AS span FROM win)"
                       " WHERE span = INTERVAL 53 HOUR", SNAPS, WINDOWS))
def _(s, d):
    return wn.sliding_windows(ev.features(s, d), contiguous=True)


@query("window_targets",
       sql("features", "SELECT start, step, role, ts FROM win WHERE step >= 48", SNAPS, WINDOWS))
def _(s, d):
    return wn.window_targets(wn.sliding_windows(ev.features(s, d)))


@query("sequence_id", sql("features", "SELECT seq_id, input_end, step, ts FROM named", *SEQ))
def _(s, d):
    return _named(ev.features(s, d)).select("seq_id", "input_end", "step", "ts")


@query("sequence_id_resume",
       sql("features", "SELECT seq_id, step, ts FROM named WHERE start % 24 <> 0", *SEQ))
def _(s, d):
    windows = materialize(wn.sliding_windows(ev.features(s, d)))
    finished = wn.sequence_id(windows).filter("start % 24 = 0").select("seq_id")
    return wn.sequence_id(windows, finished).select("seq_id", "step", "ts")


@query("densify",
       sql("features", f"SELECT m.seq_id, step, role, m.node_idx, f.station_id IS NOT NULL AS present,"
                       f" {r('coalesce(temp, 0e0)', 'temp')}, {r('coalesce(humidity, 0e0)', 'humidity')}"
                       " FROM members m JOIN named USING (seq_id) LEFT JOIN (SELECT f.*, node_idx AS k"
                       " FROM features f JOIN node_index USING (station_id)) f"
                       " ON f.ts = named.ts AND f.k = m.node_idx",
           INDEX, *SEQ, "members AS (SELECT DISTINCT seq_id, node_idx FROM named"
                        " JOIN features USING (ts) JOIN node_index USING (station_id))"))
def _(s, d):
    features = materialize(ev.features(s, d))
    cols = ["temp", "humidity"]
    dense = wn.densify(_named(features), features, wn.node_index(features), cols)
    return dense.select("seq_id", "step", "role", "node_idx", "present", *cols)


@query("reindex_edges",
       sql("features", "SELECT e.ts, a.node_idx AS src_idx, b.node_idx AS dst_idx FROM delaunay e"
                       " JOIN node_index a ON a.station_id = e.src JOIN node_index b ON b.station_id = e.dst",
           cart("features"), DELAUNAY, INDEX))
def _(s, d):
    nodes = materialize(ev.features(s, d))
    edges = delaunay_edges(nodes).select("ts", "src", "dst")
    return wn.reindex_edges(edges, wn.node_index(nodes))


_CHUNKS = ("chunks AS (SELECT seq_id, CAST((row_number() OVER (ORDER BY seq_id) - 1) // 50 + 1 AS INTEGER)"
           " AS chunk_id FROM seqs)")


@query("sequence_edges",
       sql("features", f"SELECT seq_id, step, a.node_idx AS src_idx, b.node_idx AS dst_idx, {rr('dist_scaled', 'slope')}"
                       " FROM named JOIN described e USING (ts) JOIN node_index a ON a.station_id = e.src"
                       " JOIN node_index b ON b.station_id = e.dst",
           cart("features"), DELAUNAY, described(PLAIN), INDEX, *SEQ))
def _(s, d):
    nodes = materialize(ev.features(s, d))
    edges = gr.edge_attributes(delaunay_edges(nodes).drop("alt_diff_km"), nodes)
    found = wn.sequence_edges(_named(nodes), edges, wn.node_index(nodes))
    return found.select("seq_id", "step", "src_idx", "dst_idx", "dist_scaled", "slope")


@query("chunk_sequences",
       sql("features", "SELECT named.seq_id, step, chunk_id FROM named JOIN chunks"
                       " ON chunks.seq_id = named.seq_id", *SEQ, _CHUNKS))
def _(s, d):
    return wn.chunk_sequences(_named(ev.features(s, d))).select("seq_id", "step", "chunk_id")


@query("chunk_manifest", sql("features", "SELECT chunk_id, seq_id FROM chunks", *SEQ, _CHUNKS))
def _(s, d):
    return wn.manifest(wn.chunk_sequences(_named(ev.features(s, d))))


SPLIT = ("CASE WHEN input_end + INTERVAL 1 HOUR < TIMESTAMP '2024-01-15' THEN 'train'"
         " WHEN input_end + INTERVAL 1 HOUR < TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END")
LIMITS = {"train_end": "2024-01-15", "val_end": "2024-01-22", "test_end": "2025-01-01"}


@query("chronological_split", sql("features", f"SELECT seq_id, step, {SPLIT} AS split FROM named", *SEQ))
def _(s, d):
    return wn.chronological_split(_named(ev.features(s, d)), **LIMITS).select("seq_id", "step", "split")


_IN = [0, 1, 2, 3, 4, 15, 16]
_OUT = [0, 1]


@query("select_channels_inputs",
       sql("features", "SELECT seq_id, step, station_id, " + rr(*[FEATURE_COLUMNS[i] for i in _IN])
           + " FROM named JOIN features USING (ts) WHERE role = 'input'", *SEQ))
def _(s, d):
    inputs, _ = wn.select_channels(_sequences(s, d), _IN, _OUT)
    return inputs.select("seq_id", "step", "station_id", *[FEATURE_COLUMNS[i] for i in _IN])


@query("select_channels_targets",
       sql("features", "SELECT seq_id, step, station_id, " + rr(*[FEATURE_COLUMNS[i] for i in _OUT])
           + " FROM named JOIN features USING (ts) WHERE role = 'target'", *SEQ))
def _(s, d):
    _, targets = wn.select_channels(_sequences(s, d), _IN, _OUT)
    return targets.select("seq_id", "step", "station_id", *[FEATURE_COLUMNS[i] for i in _OUT])


# --- forecasts -------------------------------------------------------------------------------------

_UNPIVOT = ", ".join(TARGET_COLUMNS)
ROWS = "rows_ AS (SELECT seq_id, step, role, station_id, f.* EXCLUDE (station_id, source) FROM named JOIN features f USING (ts))"
TRUTH = (f"truth AS (SELECT * FROM (SELECT seq_id, CAST(step - 47 AS INTEGER) AS h, ts AS ts_valid,"
         f" station_id, {_UNPIVOT} FROM rows_ WHERE role = 'target')"
         f" UNPIVOT (y_true FOR variable IN ({_UNPIVOT})))")


def _seen(step: int) -> str:
    return (f"seen AS (SELECT * FROM (SELECT seq_id, station_id, {_UNPIVOT} FROM rows_ WHERE step = {step})"
            f" UNPIVOT (y_pred FOR variable IN ({_UNPIVOT})))")


_JOINED = ("cube AS (SELECT truth.*, y_pred FROM truth LEFT JOIN seen ON seen.seq_id = truth.seq_id AND"
           " seen.station_id = truth.station_id AND seen.variable = truth.variable)")
CUBE_SQL = f"SELECT seq_id, h, ts_valid, station_id, variable, {rr('y_true', 'y_pred')} FROM cube"


@query("persistence", sql("features", CUBE_SQL, *SEQ, ROWS, TRUTH, _seen(47), _JOINED))
def _(s, d):
    return fc.persistence(_sequences(s, d))


@query("persistence_first_target", sql("features", CUBE_SQL, *SEQ, ROWS, TRUTH, _seen(48), _JOINED))
def _(s, d):
    return fc.persistence(_sequences(s, d), reference="first_target")


_CLIMATE = f"params AS ({o.params('features', TARGET_COLUMNS, o.TRAIN)})"
_MEANS = ("cube AS (SELECT truth.*, mean AS y_pred FROM truth JOIN params ON feature = variable)")


@query("climatology", sql("features", CUBE_SQL, *SEQ, ROWS, TRUTH, _CLIMATE, _MEANS))
def _(s, d):
    features = materialize(ev.features(s, d))
    seq = wn.sequence_rows(_named(features), features)
    params = st.fit_norm_params(features, TARGET_COLUMNS, ev.training_rows())
    return fc.climatology(fc.true_cube(seq), params)


@query("valid_times",
       sql("features", "SELECT seq_id, CAST(h AS INTEGER) AS h, input_end + to_hours(h) AS ts_valid"
                       " FROM seqs, (SELECT range AS h FROM range(1, 7))", *SEQ))
def _(s, d):
    return fc.valid_times(_named(ev.features(s, d)))


_UNITS = """CASE variable WHEN 'temp' THEN {x} - 273.15e0 WHEN 'humidity' THEN {x} * 100e0
   WHEN 'rain' THEN exp({x}) - 1e0 WHEN 'pressure' THEN {x} + 1013e0 ELSE {x} * 3.6e0 END"""


@query("to_physical_units",
       sql("features", "SELECT seq_id, h, station_id, variable, "
           + r(_UNITS.format(x="y_true"), "y_true") + ", " + r(_UNITS.format(x="y_pred"), "y_pred")
           + ", CASE variable WHEN 'temp' THEN '°C' WHEN 'humidity' THEN '%' WHEN 'rain' THEN 'mm'"
           " WHEN 'pressure' THEN 'hPa' ELSE 'km/h' END AS unit FROM cube",
           *SEQ, ROWS, TRUTH, _seen(47), _JOINED))
def _(s, d):
    return fc.to_physical_units(fc.persistence(_sequences(s, d))).drop("ts_valid")


LAGS = 3
WIDTH = LAGS + 2


def _regression(s, d):
    """Training rows, design rows and truth of all sequences."""
    return _regression_tables(s, d)[:3]


def _regression_tables(s, d):
    """Training rows, design rows, truth, and the graph of each sequence's last input hour."""
    features = materialize(ev.features(s, d))
    params = st.fit_norm_params(features, TARGET_COLUMNS, ev.training_rows())
    scaled = st.normalize(features, params, TARGET_COLUMNS)
    windows = fc.lag_steps(wn.chronological_split(_named(features), **LIMITS), lags=LAGS)
    seq = materialize(
        wn.sequence_rows(windows, scaled.select("ts", "station_id", *TARGET_COLUMNS))
    )
    edges = gr.edge_attributes(delaunay_edges(features).drop("alt_diff_km"), features)
    mix = gr.propagate(scaled, edges.select("ts", "src", "dst", "dist_scaled"), TARGET_COLUMNS)
    design = materialize(fc.design_rows(seq, mix, lags=LAGS))
    truth = fc.true_cube(seq)
    train = seq.filter("split = 'train'").select("seq_id").distinct()
    rows = truth.join(train, "seq_id", "left_semi").join(design, ["seq_id", "station_id", "variable"])
    last = seq.filter("step = 47").select("seq_id", "ts").distinct()
    graph = edges.select("ts", "src", "dst", "dist_scaled").join(last, "ts").drop("ts")
    return rows, design, truth, graph


# the same in SQL: scaled features, neighbour mix, lags, targets
_SCALED = [
    f"norm AS ({o.params('features', TARGET_COLUMNS, o.TRAIN)})",
    "scaled AS (SELECT ts, station_id, "
    + ", ".join(f"({c} - (SELECT mean FROM norm WHERE feature = '{c}'))"
                f" / (SELECT std FROM norm WHERE feature = '{c}') AS {c}" for c in TARGET_COLUMNS)
    + " FROM features)",
]
_NEIGHBOURS = [
    cart("features"), DELAUNAY, described(PLAIN),
    "rooted AS (SELECT f.*, 1e0 + coalesce(w, 0e0) AS deg FROM scaled f LEFT JOIN"
    " (SELECT ts AS t, dst, sum(dist_scaled) AS w FROM described GROUP BY ts, dst) i"
    " ON i.t = f.ts AND i.dst = f.station_id)",
    "sums AS (SELECT e.ts, e.dst AS station_id, "
    + ", ".join(f"sum(e.dist_scaled * x.{c} / sqrt(x.deg)) AS s_{c}" for c in TARGET_COLUMNS)
    + " FROM described e JOIN rooted x ON x.ts = e.ts AND x.station_id = e.src GROUP BY e.ts, e.dst)",
    "mix AS (SELECT x.ts, x.station_id, "
    + ", ".join(f"(coalesce(s.s_{c}, 0e0) + x.{c} / sqrt(x.deg)) / sqrt(x.deg) AS {c}" for c in TARGET_COLUMNS)
    + " FROM rooted x LEFT JOIN sums s ON s.ts = x.ts AND s.station_id = x.station_id)",
]


def _long(table: str, keys: str, value: str) -> str:
    return (f"SELECT * FROM (SELECT {keys}, {_UNPIVOT} FROM {table}) UNPIVOT ({value} FOR variable IN ({_UNPIVOT}))")


_DESIGN = [
    *SEQ, *_SCALED, *_NEIGHBOURS,
    "steps_ AS (SELECT seq_id, input_end, step, role, s.* FROM named JOIN scaled s USING (ts))",
    f"inputs AS ({_long('steps_', 'seq_id, station_id, step, ts', 'v')}),"
    f" mixed AS ({_long('mix', 'ts, station_id', 'nbr')}),"
    " lagged AS (SELECT seq_id, station_id, variable, max(v) FILTER (step = 47) AS l0,"
    " max(v) FILTER (step = 46) AS l1, max(v) FILTER (step = 45) AS l2, max(ts) FILTER (step = 47) AS ts"
    " FROM inputs WHERE step BETWEEN 45 AND 47 GROUP BY ALL HAVING l0 IS NOT NULL),"
    " design AS (SELECT seq_id, station_id, variable, l0 AS x1, coalesce(l1, l0) AS x2,"
    " coalesce(l2, l0) AS x3, coalesce(nbr, l0) AS x4 FROM lagged LEFT JOIN mixed USING (ts, station_id, variable)),"
    f" truth AS ({_long('(SELECT *, CAST(step - 47 AS INTEGER) AS h, ts AS ts_valid FROM steps_ WHERE step >= 48)', 'seq_id, h, ts_valid, station_id, input_end', 'y_true')})",
]
_TRAIN_ROWS = ("train_rows AS (SELECT t.*, x1, x2, x3, x4 FROM truth t JOIN design USING (seq_id, station_id, variable)"
               " WHERE input_end + INTERVAL 1 HOUR < TIMESTAMP '2024-01-15')")
_XS = ["x1", "x2", "x3", "x4"]


@query("regression_moments",
       sql("features", "SELECT variable, h, n, " + rr("mean_y", *[f"mean_{x}" for x in _XS],
                                                     *[f"cov_{a}_{b}" for i, a in enumerate(_XS) for b in _XS[i:]],
                                                     *[f"cov_{x}_y" for x in _XS])
           + " FROM (SELECT variable, h, count(*) AS n, avg(y_true) AS mean_y, "
           + ", ".join([f"avg({x}) AS mean_{x}" for x in _XS]
                       + [f"covar_pop({a}, {b}) AS cov_{a}_{b}" for i, a in enumerate(_XS) for b in _XS[i:]]
                       + [f"covar_pop({x}, y_true) AS cov_{x}_y" for x in _XS])
           + " FROM train_rows GROUP BY variable, h)", *_DESIGN, _TRAIN_ROWS))
def _(s, d):
    rows, _, _ = _regression(s, d)
    return fc.regression_moments(rows, WIDTH)


@query("fit_forecaster",
       sql("features", "SELECT variable, h, n, CAST(i AS INTEGER) AS i, 0e0 AS gradient FROM (SELECT variable,"
                       " h, count(*) AS n FROM train_rows GROUP BY variable, h), range(5) t(i)",
           *_DESIGN, _TRAIN_ROWS))
def _(s, d):
    """The fitted models leave no gradient: the mean of residual times each column is zero."""
    rows, _, _ = _regression(s, d)
    models = fc.fit_forecaster(rows, WIDTH)
    left = rows.filter("y_true is not null").join(models, ["variable", "h"]).withColumn(
        "e", F.col("y_true") - fc._dot(F.col("coef"), F.col("x")))
    means = left.groupBy("variable", "h").agg(
        F.first("n").alias("n"), F.array(*[F.avg(F.col("e") * F.col("x")[i]) for i in range(WIDTH)]).alias("g"))
    return means.select("variable", "h", "n", F.posexplode("g").alias("i", "gradient"))


def _coef(variable: str, h: int) -> list[float]:
    """Fixed coefficients for checking predictions; any values would do."""
    k = TARGET_COLUMNS.index(variable)
    return [0.01 * h - 0.02 * k, 0.6 - 0.03 * h, 0.2 + 0.01 * k, 0.05, 0.1 + 0.005 * h]


def _fixed_models(spark) -> DataFrame:
    rows = [(v, h, _coef(v, h)) for v in TARGET_COLUMNS for h in range(1, 7)]
    return spark.createDataFrame(rows, "variable string, h int, coef array<double>")


_MODELS = ("models(variable, h, c0, c1, c2, c3, c4) AS (VALUES "
           + ", ".join(f"('{v}', {h}, " + ", ".join(f"{c!r}::DOUBLE" for c in _coef(v, h)) + ")"
                       for v in TARGET_COLUMNS for h in range(1, 7)) + ")")
_PREDICTED = ("predicted AS (SELECT seq_id, station_id, variable, h, c0 + c1 * x1 + c2 * x2 + c3 * x3 + c4 * x4"
              " AS y_pred FROM design JOIN models USING (variable))")
_CUBED = ("cube AS (SELECT seq_id, h, ts_valid, station_id, variable, y_true, y_pred FROM truth"
          " LEFT JOIN predicted USING (seq_id, station_id, variable, h))")
_ROLL = " UNION ALL ".join(
    f"SELECT seq_id, station_id, variable, {h} AS h, p{h} AS y_pred FROM rolled" for h in range(1, 7))


def _rolled() -> str:
    """One-hour models applied six times, each result the newest lag of the next."""
    parts, lags = ["r0 AS (SELECT design.*, c0, c1, c2, c3, c4 FROM design JOIN models USING (variable) WHERE h = 1)"], _XS[:3]
    for h in range(1, 7):
        parts.append(f"r{h} AS (SELECT *, c0 + c1 * {lags[0]} + c2 * {lags[1]} + c3 * {lags[2]} + c4 * x4 AS p{h} FROM r{h - 1})")
        lags = [f"p{h}", *lags[:2]]
    return ", ".join(parts) + f", rolled AS (SELECT * FROM r6), predicted AS ({_ROLL})"


@query("predict_forecaster", sql("features", CUBE_SQL, *_DESIGN, _MODELS, _PREDICTED, _CUBED))
def _(s, d):
    _, design, truth = _regression(s, d)
    return fc.forecast_cube(truth, fc.predict(_fixed_models(s), design))


@query("recursive_forecast", sql("features", CUBE_SQL, *_DESIGN, _MODELS, _rolled(), _CUBED))
def _(s, d):
    _, design, truth = _regression(s, d)
    return fc.forecast_cube(truth, fc.recursive_forecast(_fixed_models(s), design))


def _moved() -> str:
    """The same with the neighbours' predictions mixed again after every step."""
    parts = [
        "graph AS (SELECT n.seq_id, e.src, e.dst, e.dist_scaled AS w FROM described e JOIN"
        " (SELECT DISTINCT seq_id, ts FROM steps_ WHERE step = 47) n ON n.ts = e.ts)",
        "q0 AS (SELECT design.*, c0, c1, c2, c3, c4, sqrt(1e0 + coalesce(w, 0e0)) AS root, x4 AS m0"
        " FROM design JOIN models USING (variable) LEFT JOIN (SELECT seq_id, dst AS station_id, sum(w) AS w"
        " FROM graph GROUP BY seq_id, dst) USING (seq_id, station_id) WHERE h = 1)"]
    lags = _XS[:3]
    for h in range(1, 7):
        parts.append(f"r{h} AS (SELECT *, c0 + c1 * {lags[0]} + c2 * {lags[1]} + c3 * {lags[2]}"
                     f" + c4 * m{h - 1} AS p{h} FROM q{h - 1})")
        parts.append(
            f"q{h} AS (SELECT r.*, (coalesce(s.v, 0e0) + p{h} / root) / root AS m{h} FROM r{h} r LEFT JOIN"
            f" (SELECT g.seq_id, g.dst AS station_id, variable, sum(p{h} / root * w) AS v FROM graph g"
            f" JOIN r{h} x ON x.seq_id = g.seq_id AND x.station_id = g.src GROUP BY ALL) s"
            " USING (seq_id, station_id, variable))")
        lags = [f"p{h}", *lags[:2]]
    return ", ".join(parts) + f", rolled AS (SELECT * FROM r6), predicted AS ({_ROLL})"


@query("moving_forecast", sql("features", CUBE_SQL, *_DESIGN, _MODELS, _moved(), _CUBED))
def _(s, d):
    _, design, truth, graph = _regression_tables(s, d)
    return fc.forecast_cube(truth, fc.moving_forecast(_fixed_models(s), design, graph))


# --- scores --------------------------------------------------------------------------------------------

_VARS = ["temp", "humidity", "wind_speed", "pressure"]
CUBE = f"""cube AS (SELECT seq_id, h, ts AS ts_valid, station_id, variable, y_true,
     y_true + (event_id % 10 - 5) * 0.1e0 AS y_pred FROM (
   SELECT strftime(ts, '%Y%m%d') AS seq_id, CAST(hour(ts) % 6 + 1 AS INTEGER) AS h, * FROM obs)
   UNPIVOT INCLUDE NULLS (y_true FOR variable IN ({', '.join(_VARS)})))"""


def _cube(s, d) -> DataFrame:
    rows = ev.obs(s, d).select(
        F.date_format("ts", "yyyyMMdd").alias("seq_id"), (F.hour("ts") % 6 + 1).alias("h"),
        F.col("ts").alias("ts_valid"), "station_id", "event_id", *_VARS,
    )
    long = rows.unpivot(["seq_id", "h", "ts_valid", "station_id", "event_id"], _VARS, "variable", "y_true")
    shift = (F.col("event_id") % 10 - 5) * 0.1
    return long.withColumn("y_pred", F.col("y_true") + shift).drop("event_id")


@query("mask_invalid",
       sql("obs", f"SELECT seq_id, h, ts_valid, station_id, variable, {rr('y_true', 'y_pred')} FROM ("
                  "SELECT *, bool_or(y_true IS NULL) OVER (PARTITION BY seq_id, h, station_id) AS gone"
                  " FROM cube WHERE (seq_id, h, station_id) IN (SELECT (seq_id, h, station_id) FROM cube"
                  " WHERE hour(ts_valid) < 18)) WHERE NOT gone", CUBE))
def _(s, d):
    cube = _cube(s, d)
    mask = cube.filter(F.hour("ts_valid") < 18).select("seq_id", "h", "station_id")
    return evl.mask_invalid(cube, mask)


_SCORE = """count(y_true) AS n, sqrt(avg(pow(y_pred - y_true, 2))) AS rmse,
  avg(abs(y_pred - y_true)) AS mae,
  1e0 - sum(pow(y_pred - y_true, 2)) / nullif(var_pop(y_true) * count(y_true), 0) AS r2,
  avg(2e0 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred) + 1e-6)) * 100e0 AS smape"""
_FOUR = rr("rmse", "mae", "r2", "smape")


def _metric_query(name: str) -> None:
    @query(name, sql("obs", f"SELECT variable, {r(name)} FROM (SELECT variable, {_SCORE} FROM cube"
                            " GROUP BY variable)", CUBE))
    def _(s, d):
        column = getattr(evl.sc, name)("y_true", "y_pred").alias(name)
        return _cube(s, d).groupBy("variable").agg(column)


for _name in evl.SCORES:
    _metric_query(_name)


@query("evaluate",
       sql("obs", f"SELECT variable, h, n, {_FOUR} FROM (SELECT variable, h, n, rmse, mae, smape,"
                  " CASE WHEN variable IS NULL THEN avg(r2) FILTER (WHERE variable IS NOT NULL AND h IS NULL)"
                  " OVER () ELSE r2 END AS r2 FROM (SELECT variable, h, "
                  f"{_SCORE} FROM cube GROUP BY GROUPING SETS ((variable, h), (variable), ())))", CUBE))
def _(s, d):
    return evl.evaluate(_cube(s, d))


def _against(name: str, pred: str) -> str:
    return (f"{name} AS (SELECT coalesce(variable, 'all') AS variable, n, rmse, mae, smape, CASE WHEN"
            " variable IS NULL THEN avg(r2) FILTER (WHERE variable IS NOT NULL) OVER () ELSE r2 END AS r2"
            f" FROM (SELECT variable, {_SCORE} FROM ({pred}) GROUP BY GROUPING SETS ((variable), ())))")


_LAST = ("last_ AS (SELECT t.*, l0 AS y_pred FROM truth t LEFT JOIN lagged USING (seq_id, station_id, variable))")
_ZERO = ("mean_ AS (SELECT t.*, mean AS y_pred FROM truth t JOIN (" + o.params("scaled", TARGET_COLUMNS, o.TRAIN)
         + ") ON feature = variable)")
_SCORED = "(SELECT * FROM {} WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"


@query("compare_forecasts",
       sql("features", "SELECT m.variable, m.n, " + ", ".join(
           r(f"{a}.{x}", f"{x}_{n}") for a, n in (("m", "model"), ("p", "persistence"), ("c", "climatology"))
           for x in ("rmse", "mae", "r2", "smape"))
           + " FROM m JOIN p ON p.variable = m.variable JOIN c ON c.variable = m.variable",
           *_DESIGN, _MODELS, _PREDICTED, _CUBED, _LAST, _ZERO,
           _against("m", _SCORED.format("cube")), _against("p", _SCORED.format("last_")),
           _against("c", _SCORED.format("mean_"))))
def _(s, d):
    features = materialize(ev.features(s, d))
    params = st.fit_norm_params(features, TARGET_COLUMNS, ev.training_rows())
    scaled = materialize(st.normalize(features, params, TARGET_COLUMNS))
    seq = materialize(wn.sequence_rows(_named(features), scaled.select("ts", "station_id", *TARGET_COLUMNS)))
    edges = gr.edge_attributes(delaunay_edges(features).drop("alt_diff_km"), features)
    mix = gr.propagate(scaled, edges.select("ts", "src", "dst", "dist_scaled"), TARGET_COLUMNS)
    design = fc.design_rows(fc.lag_steps(seq, lags=LAGS), mix, lags=LAGS)
    truth = fc.true_cube(seq)
    means = st.fit_norm_params(scaled, TARGET_COLUMNS, ev.training_rows())
    return evl.compare_baselines(
        fc.forecast_cube(truth, fc.predict(_fixed_models(s), design)),
        {"persistence": fc.persistence(seq), "climatology": fc.climatology(truth, means)},
    )


@query("evaluate_persistence",
       sql("features", f"SELECT variable, h, n, {_FOUR} FROM (SELECT variable, h, n, rmse, mae, smape,"
                       " CASE WHEN variable IS NULL THEN avg(r2) FILTER (WHERE variable IS NOT NULL AND h IS NULL)"
                       " OVER () ELSE r2 END AS r2 FROM (SELECT variable, h, "
                       f"{_SCORE} FROM (SELECT * REPLACE (CASE WHEN y_pred IS NOT NULL THEN y_true END AS y_true)"
                       " FROM cube WHERE y_true IS NOT NULL) GROUP BY GROUPING SETS ((variable, h), (variable), ())))",
           *SEQ, ROWS, TRUTH, _seen(47), _JOINED))
def _(s, d):
    cube = fc.persistence(_sequences(s, d))
    present = cube.filter("y_true is not null").select("seq_id", "h", "station_id")
    return evl.evaluate(evl.mask_invalid(cube, present))


@query("compare_baselines",
       sql("obs", "SELECT m.variable, m.n, " + ", ".join(
           r(f"{a}.{x}", f"{x}_{n}") for a, n in (("m", "model"), ("p", "persistence"), ("c", "climatology"))
           for x in ("rmse", "mae", "r2", "smape"))
           + " FROM m JOIN p ON p.variable = m.variable JOIN c ON c.variable = m.variable", CUBE,
           _against("m", "SELECT * FROM cube"),
           _against("p", "SELECT * REPLACE (y_true * 1.1e0 AS y_pred) FROM cube"),
           _against("c", "SELECT * REPLACE (CASE WHEN y_true IS NOT NULL THEN 20e0 END AS y_pred) FROM cube")))
def _(s, d):
    cube = _cube(s, d)
    return evl.compare_baselines(
        cube,
        {
            "persistence": cube.withColumn("y_pred", F.col("y_true") * 1.1),
            "climatology": cube.withColumn("y_pred", F.when(F.col("y_true").isNotNull(), F.lit(20.0))),
        },
    )


# --- run logs ----------------------------------------------------------------------------------------------

RUNS = """run_log AS (SELECT event_type AS run_id, CAST(dayofmonth(ts) AS INTEGER) AS epoch,
   CASE WHEN user_id % 10 = 9 THEN 'test' WHEN user_id % 2 = 0 THEN 'train' ELSE 'val' END AS stage,
   avg(value) / 100e0 AS loss, sqrt(avg(value * value)) AS rmse, avg(abs(value - 100e0)) AS mae,
   1e0 - avg(value) / 1000e0 AS r2, avg(value) / (avg(value) + 1e0) AS smape
   FROM events GROUP BY 1, 2, 3)"""


def _runs(s, d) -> DataFrame:
    value = F.col("value")
    stage = (
        F.when(F.col("user_id") % 10 == 9, "test").when(F.col("user_id") % 2 == 0, "train")
        .otherwise("val")
    )
    events = ev.use_utc(s).read.parquet(f"{d}/events.parquet")
    return events.groupBy(
        F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch"), stage.alias("stage")
    ).agg(
        (F.avg(value) / 100.0).alias("loss"), F.sqrt(F.avg(value * value)).alias("rmse"),
        F.avg(F.abs(value - 100.0)).alias("mae"), (1.0 - F.avg(value) / 1000.0).alias("r2"),
        (F.avg(value) / (F.avg(value) + 1.0)).alias("smape"),
    )


@query("train_val_gap",
       f"WITH {RUNS} SELECT t.run_id, t.epoch, " + ", ".join(r(f"v.{m} - t.{m}", f"gap_{m}") for m in METRICS)
       + " FROM run_log t JOIN run_log v ON t.run_id = v.run_id AND t.epoch = v.epoch"
       " WHERE t.stage = 'train' AND v.stage = 'val'")
def _(s, d):
    return rl.train_val_gap(_runs(s, d))


@query("best_epoch",
       f"WITH {RUNS} SELECT run_id, epoch, {r('loss')} FROM (SELECT *, row_number() OVER"
       " (PARTITION BY run_id ORDER BY loss, epoch) AS k FROM run_log WHERE stage = 'val') WHERE k = 1")
def _(s, d):
    return rl.best_epoch(_runs(s, d))


@query("epoch_thirds_summary",
       f"WITH {RUNS}, span AS (SELECT run_id, min(epoch) AS e0, count(DISTINCT epoch) // 3 AS third"
       " FROM run_log WHERE stage = 'val' GROUP BY run_id HAVING count(DISTINCT epoch) >= 6),"
       " placed AS (SELECT l.run_id, CASE WHEN epoch - e0 < s.third THEN 'start'"
       " WHEN epoch - e0 < 2 * s.third THEN 'middle' ELSE 'end' END AS third, loss, rmse, mae, r2, smape"
       " FROM run_log l JOIN span s ON s.run_id = l.run_id WHERE stage = 'val')"
       f" SELECT run_id, third, metric, count(v) AS n, {r('min(v)', 'low', 9)},"
       f" {r('quantile_cont(v, 0.25)', 'q1', 9)}, {r('quantile_cont(v, 0.5)', 'median', 9)},"
       f" {r('quantile_cont(v, 0.75)', 'q3', 9)}, {r('max(v)', 'high', 9)} FROM placed"
       f" UNPIVOT (v FOR metric IN ({', '.join(METRICS)})) GROUP BY run_id, third, metric", places=9)
def _(s, d):
    return rl.epoch_thirds_summary(_runs(s, d))


@query("run_summary",
       f"WITH {RUNS} SELECT run_id, stage, {rr(*METRICS)} FROM (SELECT *, row_number() OVER"
       " (PARTITION BY run_id, stage ORDER BY CASE WHEN stage = 'test' THEN epoch ELSE -epoch END) AS k"
       " FROM run_log) WHERE k = 1")
def _(s, d):
    return rl.run_summary(_runs(s, d))


@query("metric_correlation",
       f"WITH {RUNS}, val AS (SELECT * FROM run_log WHERE stage = 'val'), t AS ({corr_sql('val', METRICS)})"
       f" SELECT var_a, var_b, {r('corr')} FROM t")
def _(s, d):
    return rl.metric_correlation(_runs(s, d), "val")

"""Queries over single rows, stations and whole-table statistics, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylattice.constants import FEATURE_COLUMNS, TARGET_COLUMNS, TEMPORAL_FEATURES
from skylattice.functions import calendar as cal, geodesy as geo, physics as ph
from skylattice.operators import clean as cl
from skylattice.operators import features as ft
from skylattice.operators import impute as im
from skylattice.operators import quality as qa
from skylattice.operators import stats as st
from skylattice.plans import oracle as o
from skylattice.plans import standard
from skylattice.plans import station_events as ev
from skylattice.plans.oracle import r, rr, sql

QUERIES = {}
ORACLES = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded as in the check SQL, negative zero normalised."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in doubles})


def query(name: str, oracle: str | None = None, into: dict | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


KEY = ["station_id", "ts"]
READ = ["temp", "humidity", "rain", "wind_dir", "wind_speed", "pressure"]
READ_SQL = rr(*READ)

# --- cleaning ------------------------------------------------------------------


@query("filter_sources", sql("raw", f"SELECT event_id, source FROM raw WHERE source IN ({o._sources})"))
def _(s, d):
    return cl.filter_sources(ev.raw(s, d), ev.SOURCES).select("event_id", "source")


@query(
    "select_canonical",
    sql("raw", f"SELECT station_id, source, {rr('temp', 'humidity', 'rain', 'alt')}, wind_dir,"
               f" wind_speed, {rr('pressure', 'lat', 'lon')}, ts FROM raw"),
)
def _(s, d):
    return cl.select_canonical(ev.raw(s, d))


@query(
    "to_numeric",
    sql("raw", f"SELECT event_id, {r('TRY_CAST(wind_speed AS DOUBLE)', 'wind_speed')},"
               f" {rr('temp')} FROM raw"),
)
def _(s, d):
    return cl.to_numeric(ev.raw(s, d), ["temp", "wind_speed"]).select(
        "event_id", "wind_speed", "temp"
    )


@query("fill_rain", sql("raw", f"SELECT event_id, {r('coalesce(rain, 0e0)', 'rain')} FROM raw"))
def _(s, d):
    return cl.fill_rain(ev.raw(s, d)).select("event_id", "rain")


@query(
    "compass_to_degrees",
    sql("raw", f"SELECT event_id, {r(f'CASE wind_dir {o._compass} ELSE NULL END', 'wind_dir')}"
               " FROM raw"),
)
def _(s, d):
    return cl.compass_to_degrees(ev.raw(s, d)).select("event_id", "wind_dir")


@query(
    "drop_empty_rows",
    sql("raw", "SELECT event_id FROM raw WHERE coalesce(temp, humidity, pressure,"
               " TRY_CAST(wind_speed AS DOUBLE)) IS NOT NULL"),
)
def _(s, d):
    typed = cl.to_numeric(ev.raw(s, d), ["temp", "humidity", "wind_speed", "pressure"])
    return cl.drop_empty_rows(typed, ["temp", "humidity", "wind_speed", "pressure"]).select(
        "event_id"
    )


@query(
    "hourly_rain",
    sql("epoched", f"SELECT station_id, ts, {r(o.RAIN, 'rain')} FROM epoched"),
)
def _(s, d):
    return im.hourly_rain(ev.obs(s, d)).select(*KEY, "rain")


@query(
    "nearest_valid",
    sql("epoched",
        f"SELECT station_id, ts, {r('temp_b.v', 'temp_back')},"
        " CAST(make_timestamp(temp_b.e * 1000000) AS TIMESTAMP) AS temp_back_ts,"
        f" {r('temp_f.v', 'temp_fwd')},"
        " CAST(make_timestamp(temp_f.e * 1000000) AS TIMESTAMP) AS temp_fwd_ts"
        f" FROM (SELECT *, {o.neighbours('temp')} FROM epoched)"),
)
def _(s, d):
    return im.nearest_valid(ev.obs(s, d), "temp").select(
        *KEY, "temp_back", "temp_back_ts", "temp_fwd", "temp_fwd_ts"
    )


_FIVE = o.FOUR + ["wind_dir"]


def _imputed_sql(vars: list[str]) -> str:
    return sql(
        "epoched",
        "SELECT station_id, ts, " + ", ".join(r(o.filled(v), v) for v in vars)
        + f" FROM (SELECT *, {', '.join(o.neighbours(v) for v in vars)} FROM epoched)",
    )


@query("impute_linear", _imputed_sql(o.FOUR))
def _(s, d):
    return im.impute_linear(ev.obs(s, d)).select(*KEY, *o.FOUR)


@query("impute_linear_with_direction", _imputed_sql(_FIVE))
def _(s, d):
    return im.impute_linear(ev.obs(s, d), _FIVE).select(*KEY, *_FIVE)


# neighbours come from the first reading of an hour while every reading of the hour is filled
@query(
    "impute_from_raw_view",
    sql(["typed", "epoched"],
        f"SELECT event_id, {r('rain_now', 'rain')}, "
        + ", ".join(r(o.filled(v), v) for v in o.FOUR) + " FROM joined",
        "view AS (SELECT station_id AS vs, e AS ve, last_value(rain IGNORE NULLS) OVER"
        " (PARTITION BY station_id ORDER BY e RANGE BETWEEN 3600 PRECEDING AND 3600 PRECEDING)"
        f" AS before, {', '.join(o.neighbours(v) for v in o.FOUR)} FROM epoched)",
        "joined AS (SELECT t.*, CAST(epoch(ts) AS BIGINT) AS e, view.* EXCLUDE (vs, ve),"
        " greatest(rain - CASE WHEN hour(ts) = 0 THEN 0e0 ELSE coalesce(before, 0e0) END, 0e0)"
        " AS rain_now FROM typed t JOIN view ON vs = station_id"
        " AND ve = CAST(epoch(ts) AS BIGINT))"),
)
def _(s, d):
    typed = im.typed_readings(cl.filter_sources(ev.raw(s, d), ev.SOURCES))
    filled = im.rain_and_imputation(typed, raw=im.first_readings(typed, "event_id"))
    return filled.select("event_id", "rain", *o.FOUR)


@query(
    "drop_incomplete",
    sql("obs", "SELECT event_id FROM obs WHERE temp IS NOT NULL AND humidity IS NOT NULL"
               " AND wind_dir IS NOT NULL AND wind_speed IS NOT NULL AND pressure IS NOT NULL"),
)
def _(s, d):
    return cl.drop_incomplete(ev.obs(s, d)).select("event_id")


@query(
    "clip_ranges",
    sql("obs",
        "SELECT event_id, "
        + r("CASE WHEN temp IS NOT NULL THEN least(greatest(temp * 5e0, 0e0), 100e0) END", "humidity")
        + ", "
        + r("CASE WHEN wind_speed IS NOT NULL THEN least(greatest(wind_speed * 5e0 - 20e0, 0e0), 200e0) END",
            "wind_speed")
        + ", "
        + r("CASE WHEN wind_dir IS NOT NULL THEN least(greatest(wind_dir + 30e0, 0e0), 360e0) END",
            "wind_dir")
        + " FROM obs"),
)
def _(s, d):
    stretched = ev.obs(s, d).select(
        "event_id",
        (F.col("temp") * 5.0).alias("humidity"),
        (F.col("wind_speed") * 5.0 - 20.0).alias("wind_speed"),
        (F.col("wind_dir") + 30.0).alias("wind_dir"),
    )
    return cl.clip_ranges(stretched)


@query(
    "require_position",
    sql("raw", "SELECT event_id FROM raw WHERE event_id % 7 <> 0 AND lat IS NOT NULL"
               " AND lon IS NOT NULL"),
)
def _(s, d):
    partial = ev.raw(s, d).select("event_id", "lat", "lon", F.col("temp").alias("alt"))
    return cl.require_position(partial).select("event_id")


@query(
    "dedupe_stations",
    sql("obs", "SELECT station_id, ts, event_id FROM (SELECT *, row_number() OVER"
               " (PARTITION BY station_id, ts ORDER BY event_id) AS rn FROM raw) WHERE rn = 1"),
)
def _(s, d):
    return cl.dedupe_stations(ev.raw(s, d), "event_id").select(*KEY, "event_id")


@query("within_bbox", sql("raw", f"SELECT event_id, {rr('lat', 'lon')} FROM raw WHERE {o._inside}"))
def _(s, d):
    return cl.within_bbox(ev.raw(s, d)).select("event_id", "lat", "lon")


@query(
    "drop_zero_humidity",
    sql("raw", f"SELECT event_id, {rr('humidity')} FROM raw WHERE humidity IS NULL OR humidity <> 0"),
)
def _(s, d):
    return cl.drop_zero_humidity(ev.raw(s, d)).select("event_id", "humidity")


@query(
    "wind_to_ms",
    sql("raw", "SELECT event_id, "
               + r("coalesce(TRY_CAST(wind_speed AS DOUBLE), 0e0) / 3.6e0", "wind_speed")
               + " FROM raw"),
)
def _(s, d):
    return cl.wind_to_ms(ev.raw(s, d)).select("event_id", "wind_speed")


@query(
    "min_stations",
    sql("points", "SELECT station_id, ts FROM points WHERE ts IN"
                  " (SELECT ts FROM points GROUP BY ts HAVING count(*) >= 8)"),
)
def _(s, d):
    return cl.min_stations(ev.points(s, d), 8).select(*KEY)


@query("require_columns", sql("raw", "SELECT event_id FROM raw"))
def _(s, d):
    return cl.require_columns(ev.raw(s, d), ["station_id", "ts", "pressure"]).select("event_id")


@query("clean_observations", sql("clean", f"SELECT station_id, ts, {READ_SQL} FROM clean"))
def _(s, d):
    return ev.clean(s, d).select(*KEY, *READ)


# --- audits ----------------------------------------------------------------------


@query(
    "cleaning_report",
    sql("raw",
        "SELECT source, ts, count(*) AS rows_before,"
        " count(*) FILTER (WHERE f = 'bbox') AS dropped_bbox,"
        " count(*) FILTER (WHERE f = 'humidity') AS dropped_humidity,"
        " count(*) FILTER (WHERE f = 'temp') AS dropped_temp,"
        " count(*) FILTER (WHERE f IS NULL) AS rows_after FROM judged GROUP BY source, ts",
        f"judged AS (SELECT *, CASE WHEN NOT ({o._inside}) THEN 'bbox'"
        " WHEN humidity = 0 THEN 'humidity' WHEN temp IS NULL THEN 'temp' END AS f FROM raw)"),
)
def _(s, d):
    lat, lon = o.BBOX["lat"], o.BBOX["lon"]
    rules = {
        "bbox": F.col("lat").between(*lat) & F.col("lon").between(*lon),
        "humidity": F.col("humidity").isNull() | (F.col("humidity") != 0),
        "temp": F.col("temp").isNotNull(),
    }
    return qa.cleaning_report(ev.raw(s, d), rules, ["source", "ts"])


def _coverage_sql(label: str) -> str:
    return sql(
        "obs",
        "SELECT p.period, station_id, present, snapshots, "
        + r("CAST(present AS DOUBLE) / snapshots", "coverage")
        + " FROM (SELECT period, station_id, count(DISTINCT ts) AS present FROM seen"
        " GROUP BY ALL) p JOIN (SELECT period, count(DISTINCT ts) AS snapshots FROM seen"
        " GROUP BY ALL) t ON p.period = t.period",
        f"seen AS (SELECT station_id, ts, {label} AS period FROM obs)",
    )


@query("graph_row_report",
       sql("clean", "SELECT CAST(ts AS DATE) AS day, count(*) AS rows_before,"
                    " count(*) FILTER (pos IS NULL) AS dropped_position,"
                    " count(*) FILTER (pos AND NOT inside) AS dropped_bbox,"
                    " count(*) FILTER (pos AND inside AND humidity = 0) AS dropped_zero_humidity,"
                    " count(*) FILTER (pos AND inside AND coalesce(humidity, 1) <> 0) AS rows_after"
                    " FROM (SELECT *, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL THEN TRUE END"
                    " AS pos, lat BETWEEN 37.843e0 AND 42.85e0 AND lon BETWEEN -1.533e0 AND 4.324e0 AS inside"
                    " FROM clean) GROUP BY 1"))
def _(s, d):
    return standard.graph_row_report(ev.clean(s, d))


@query("station_coverage", _coverage_sql("'all'"))
def _(s, d):
    return qa.station_coverage(ev.obs(s, d))


@query("station_coverage_day", _coverage_sql("strftime(ts, '%Y-%m-%d')"))
def _(s, d):
    return qa.station_coverage(ev.obs(s, d), "day")


@query("station_coverage_month", _coverage_sql("strftime(ts, '%Y-%m')"))
def _(s, d):
    return qa.station_coverage(ev.obs(s, d), "month")


# --- feature expressions -------------------------------------------------------------


def _feature_query(name: str, columns: dict[str, str], build) -> None:
    """One derived-column query over the typed readings."""
    text = sql("obs", "SELECT station_id, ts, "
               + ", ".join(r(e, a) for a, e in columns.items()) + " FROM obs")

    @query(name, text)
    def _(s, d):
        values = build()
        values = values if isinstance(values, tuple) else (values,)
        named = [v.alias(a) for v, a in zip(values, columns, strict=True)]
        return ev.obs(s, d).select(*KEY, *named)


_E = o.FEATURE_EXPRS
_feature_query("hour_cycle", {k: _E[k] for k in ("hour_sin", "hour_cos")},
               lambda: cal.hour_cycle("ts"))
_feature_query("day_cycle", {k: _E[k] for k in ("day_sin", "day_cos")},
               lambda: cal.day_cycle("ts"))
_feature_query("cos_zenith", {"cos_sza": _E["cos_sza"]},
               lambda: cal.cos_zenith("ts", "lat", "lon"))
_feature_query("wind_direction_xy", {k: _E[k] for k in ("wind_dir_sin", "wind_dir_cos")},
               lambda: ph.wind_direction_xy("wind_dir"))
_feature_query("wind_components", {k: _E[k] for k in ("wind_u", "wind_v")},
               lambda: ph.wind_components("wind_speed", "wind_dir"))
_feature_query("kelvin", {"temp_k": _E["temp"]}, lambda: ph.kelvin("temp"))
_feature_query("log_rain", {"log_rain": _E["rain"]}, lambda: ph.log_rain("rain"))
_feature_query("pressure_anomaly", {"pressure_anomaly": _E["pressure"]},
               lambda: ph.pressure_anomaly("pressure"))
_feature_query("dew_point", {"dew_point": _E["dew_point"]},
               lambda: ph.dew_point(ph.kelvin("temp"), "humidity"))
_feature_query("potential_temperature", {"potential_temp": _E["potential_temp"]},
               lambda: ph.potential_temperature(ph.kelvin("temp"), "pressure"))
_feature_query("humidity_fraction", {"humidity_fraction": _E["humidity"]},
               lambda: ph.humidity_fraction("humidity"))
_feature_query("alt_norm", {"alt_norm": _E["alt_norm"]}, lambda: ph.alt_norm("alt"))
_feature_query("wind_speed_from_uv", {"speed": "abs(wind_speed)"},
               lambda: F.when(F.col("wind_dir").isNotNull(), ph.wind_speed_from_uv(
                   *ph.wind_components("wind_speed", "wind_dir"))).otherwise(
                   F.abs("wind_speed")))


@query(
    "build_features",
    sql("features", f"SELECT station_id, ts, {rr(*FEATURE_COLUMNS)}, CAST(year(ts) AS INTEGER) AS year FROM features"),
)
def _(s, d):
    built = ft.build_features(ev.nodes(s, d), year=True)
    return built.select(*KEY, *FEATURE_COLUMNS, "year")


# --- geodesy ------------------------------------------------------------------------------

_X = "(6371e0 + alt / 1000e0) * cos(radians(lat)) * cos(radians(lon))"
_Y = "(6371e0 + alt / 1000e0) * cos(radians(lat)) * sin(radians(lon))"
_Z = "(6371e0 + alt / 1000e0) * sin(radians(lat))"


def haversine_sql(a: str, b: str, eps: str = "0e0") -> str:
    """Great-circle km between rows aliased ``a`` and ``b``."""
    return (
        f"2e0 * 6371e0 * asin(sqrt(least(1e0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2e0), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat))"
        f" * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2e0), 2) + {eps})))"
    )


def bearing_sql(a: str, b: str) -> str:
    dlam = f"radians({b}.lon - {a}.lon)"
    east = f"sin({dlam}) * cos(radians({b}.lat))"
    north = (f"cos(radians({a}.lat)) * sin(radians({b}.lat))"
             f" - sin(radians({a}.lat)) * cos(radians({b}.lat)) * cos({dlam})")
    angle = f"(degrees(atan2({east}, {north})) + 360e0)"
    return f"({angle} - 360e0 * floor({angle} / 360e0))"


_feature_query("to_cartesian", {"x": _X, "y": _Y, "z": _Z},
               lambda: geo.to_cartesian("lat", "lon", "alt"))
_feature_query("to_geodetic", {"lat_back": "lat", "lon_back": "lon", "alt_back": "alt"},
               lambda: geo.to_geodetic(*geo.to_cartesian("lat", "lon", "alt")))
_feature_query("scaled_lon", {"plane_x": "lon * cos(radians(41.7e0))"},
               lambda: geo.scaled_lon("lon"))

_CENTRE = "obs, (SELECT 41.4e0 AS lat, 2.2e0 AS lon) c"


@query("haversine_km",
       sql("obs", f"SELECT station_id, ts, {r(haversine_sql('obs', 'c'), 'km')},"
                  f" {r(haversine_sql('obs', 'c', '1e-8'), 'km_eps')} FROM {_CENTRE}"))
def _(s, d):
    at = (F.lit(41.4), F.lit(2.2))
    return ev.obs(s, d).select(
        *KEY,
        geo.haversine_km("lat", "lon", *at).alias("km"),
        geo.haversine_km("lat", "lon", *at, eps=1e-8).alias("km_eps"),
    )


@query("bearing_deg",
       sql("obs", f"SELECT station_id, ts, {r(bearing_sql('obs', 'c'), 'bearing')} FROM {_CENTRE}"))
def _(s, d):
    return ev.obs(s, d).select(
        *KEY, geo.bearing_deg("lat", "lon", F.lit(41.4), F.lit(2.2)).alias("bearing")
    )


# --- statistics ---------------------------------------------------------------------------------


@query(
    "fit_norm_params",
    sql("features", f"SELECT feature, {rr('mean', 'std')} FROM params",
        f"params AS ({o.params('features', FEATURE_COLUMNS, o.TRAIN)})"),
)
def _(s, d):
    return st.fit_norm_params(ev.features(s, d), FEATURE_COLUMNS, ev.training_rows())


_P = f"params AS ({o.params('features', FEATURE_COLUMNS, o.TRAIN)})"


def _scaled(col: str) -> str:
    return (f"({col} - (SELECT mean FROM params WHERE feature = '{col}'))"
            f" / (SELECT std FROM params WHERE feature = '{col}')")


_KEPT = [c for c in FEATURE_COLUMNS if c not in TEMPORAL_FEATURES]


@query(
    "normalize",
    sql("features", "SELECT station_id, ts, "
        + ", ".join(r(_scaled(c), c) for c in _KEPT) + ", " + rr(*TEMPORAL_FEATURES)
        + " FROM features", _P),
)
def _(s, d):
    rows = ev.features(s, d)
    params = st.fit_norm_params(rows, FEATURE_COLUMNS, ev.training_rows())
    return st.normalize(rows, params, exclude=TEMPORAL_FEATURES).select(
        *KEY, *_KEPT, *TEMPORAL_FEATURES
    )


@query("denormalize", sql("features", f"SELECT station_id, ts, {rr(*TARGET_COLUMNS)} FROM features"))
def _(s, d):
    rows = ev.features(s, d)
    params = st.fit_norm_params(rows, TARGET_COLUMNS, ev.training_rows())
    scaled = st.normalize(rows, params, TARGET_COLUMNS)
    return st.denormalize(scaled, params, TARGET_COLUMNS).select(*KEY, *TARGET_COLUMNS)


def _by_hour(c: str) -> str:
    std = f"coalesce(stddev_samp({c}) OVER (PARTITION BY ts), 0e0)"
    return f"({c} - avg({c}) OVER (PARTITION BY ts)) / CASE WHEN {std} = 0 THEN 1e0 ELSE {std} END"


@query(
    "normalize_per_snapshot",
    sql("features", "SELECT station_id, ts, "
        + ", ".join(r(_by_hour(c), c) for c in ("temp", "humidity", "wind_speed", "dew_point"))
        + " FROM features"),
)
def _(s, d):
    cols = ["temp", "humidity", "wind_speed", "dew_point"]
    return st.normalize_per_snapshot(ev.features(s, d), cols).select(*KEY, *cols)


def _hist_sql(cols: list[str], table: str, bins: int) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS feature, b.bin, lo + (hi - lo) / {bins}e0 * b.bin AS low,"
            f" lo + (hi - lo) / {bins}e0 * (b.bin + 1) AS high, coalesce(n, 0) AS n"
            f" FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) b"
            f" CROSS JOIN (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5e0 ELSE min({c}) END AS lo,"
            f" CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5e0 ELSE max({c}) END AS hi FROM {table}) l"
            f" LEFT JOIN (SELECT least(CAST(floor(({c} - lo2) / ((hi2 - lo2) / {bins}e0)) AS INTEGER),"
            f" {bins - 1}) AS bin, count(*) AS n FROM {table}, (SELECT"
            f" CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5e0 ELSE min({c}) END AS lo2,"
            f" CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5e0 ELSE max({c}) END AS hi2 FROM {table})"
            f" WHERE {c} IS NOT NULL GROUP BY 1) h ON h.bin = b.bin"
        )
    return " UNION ALL ".join(parts)


_HIST = ["temp", "humidity", "rain", "wind_speed", "pressure"]


@query(
    "histograms",
    sql("features", f"SELECT feature, bin, {rr('low', 'high')}, n FROM hist",
        f"hist AS ({_hist_sql(_HIST, 'features', 50)})"),
)
def _(s, d):
    return st.histograms(ev.features(s, d), _HIST)


@query(
    "target_stats",
    sql("features", f"SELECT feature, {r('mean')}, {r('greatest(std, 1e-6)', 'std')} FROM t",
        f"t AS ({o.params('features', TARGET_COLUMNS)})"),
)
def _(s, d):
    return st.target_stats(ev.features(s, d), TARGET_COLUMNS)


@query(
    "merge_stats",
    sql("features", f"SELECT feature, n, {rr('mean', 'std')} FROM t",
        "t AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std"
            " FROM features" for c in TARGET_COLUMNS) + ")"),
)
def _(s, d):
    days = ev.features(s, d).withColumn("day", F.to_date("ts"))
    return st.merge_stats(st.partial_stats(days, TARGET_COLUMNS, ["day"]))


def corr_sql(table: str, vars: list[str]) -> str:
    there = " AND ".join(f"{v} IS NOT NULL" for v in vars)
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, "
        + ("1e0" if a == b else f"corr({a}, {b})") + f" AS corr FROM {table} WHERE {there}"
        + (" HAVING count(*) > 1" if a == b else "")
        for a in vars for b in vars
    )


@query(
    "correlation_matrix",
    sql("features", f"SELECT var_a, var_b, {r('corr')} FROM t",
        f"t AS ({corr_sql('features', TARGET_COLUMNS)})"),
)
def _(s, d):
    return st.correlation_matrix(ev.features(s, d), TARGET_COLUMNS)

"""Queries on files: the events table written as an archive of hourly files and read back, audits of
it, and the round trip of every sink, with their check SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.constants import METRICS, RAW_HEADER, TARGET_COLUMNS
from skylattice.operators import forecast as fc
from skylattice.operators import graph as gr
from skylattice.operators import quality as qa
from skylattice.operators import stats as st
from skylattice.operators import windows as wn
from skylattice.plans import catalog_graph, catalog_rows, catalog_series
from skylattice.plans import oracle as o
from skylattice.plans import station_events as ev
from skylattice.plans.catalog_rows import rounded
from skylattice.plans.oracle import r, rr, sql
from skylattice.session import ensure_checkpoint_dir
from skylattice.sources import files as fl
from skylattice.sources import observations as ob
from skylattice.sources import tables as tb

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str, places: int = 6):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), places)
        ORACLES[name] = oracle
        return fn

    return register


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


# --- the archive ----------------------------------------------------------------------------------

# What is wrong with the file of an hour; the same cases in SQL below.
def _kind():
    h, d = F.hour("ts"), F.dayofmonth("ts")
    return (
        F.when((h == 5) & (d % 5 == 2), "empty").when((h == 6) & (d % 5 == 1), "bare")
        .when((h == 9) & (d % 7 == 3), "open").when((h == 10) & (d % 9 == 4), "blank")
        .when(h == 11, "nopressure").when(h == 3, "latin").otherwise("plain")
    )


_KIND_SQL = """CASE WHEN hour(ts) = 5 AND day(ts) % 5 = 2 THEN 'empty' WHEN hour(ts) = 6 AND day(ts) % 5 = 1
   THEN 'bare' WHEN hour(ts) = 9 AND day(ts) % 7 = 3 THEN 'open' WHEN hour(ts) = 10 AND day(ts) % 9 = 4
   THEN 'blank' WHEN hour(ts) = 11 THEN 'nopressure' WHEN hour(ts) = 3 THEN 'latin' ELSE 'plain' END"""
_PATH_SQL = """strftime(ts, '%Y/%m/%d/') || CASE WHEN hour(ts) = 13 AND day(ts) % 4 = 0 THEN 'HTML' ELSE
   strftime(ts, '%H') END || '/' || strftime(ts, '%Y%m%d%H') || 'dadesPC_utc.csv'"""
_FILES = (f"files AS (SELECT ts, {_PATH_SQL} AS path, {_KIND_SQL} AS kind FROM (SELECT DISTINCT ts FROM raw))")
_CELLS = {
    "nu": "event_id", "id": "station_id", "Font": "source", "lat": "lat", "lon": "lon", "Temp": "temp",
    "VentDir": "wind_dir", "VentFor": "wind_speed", "Humitat": "humidity", "Pluja": "rain", "Alt": "alt",
    "Patm": "pressure",
}
_PLACE = ["Lleidà", 'Sant "Pol", Vell', "Vall\nd'Aran"]


def _line(columns: list[str]):
    def cell(name: str):
        if name == "Poblacio":
            text = F.element_at(F.array(*[F.lit(p) for p in _PLACE]), (F.col("event_id") % 3 + 1).cast("int"))
        else:
            text = F.coalesce(F.col(_CELLS[name]).cast("string"), F.lit("")) if name in _CELLS else F.lit("")
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    return F.concat_ws(",", *[cell(c) for c in columns])


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: one file per hour. A file holds the readings of one hour, as the archive's."""
    short = [c for c in RAW_HEADER if c != "Patm"]
    lines = ev.raw(spark, sf_dir).withColumn("kind", _kind()).withColumn(
        "line", F.when(F.col("kind") == "nopressure", _line(short)).otherwise(_line(RAW_HEADER)))
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    hours = lines.groupBy("ts", "kind").agg(body.alias("body"))
    head = F.when(F.col("kind") == "nopressure", ",".join(f'"{c}"' for c in short)).otherwise(fl.KNOWN_HEADER)
    text = (
        F.when(F.col("kind") == "empty", "").when(F.col("kind") == "bare", F.col("body"))
        .when(F.col("kind") == "blank", " \n\n")
        .when(F.col("kind") == "open", F.concat(head, F.lit("\n"), "body", F.lit('"')))
        .otherwise(F.concat(head, F.lit("\n"), "body", F.lit("\n")))
    )
    hour = F.when((F.hour("ts") == 13) & (F.dayofmonth("ts") % 4 == 0), "HTML").otherwise(F.date_format("ts", "HH"))
    path = F.concat(F.date_format("ts", "yyyy/MM/dd/"), hour, F.lit("/"),
                    F.date_format("ts", "yyyyMMddHH"), F.lit("dadesPC_utc.csv"))
    code = F.when(F.col("kind") == "latin", F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return hours.select(path.alias("path"), code.alias("content"))


def _archive(spark: SparkSession, sf_dir: str) -> str:
    root = _folder(spark, "archive")
    fl.write_files(archive_rows(spark, sf_dir), root)
    return root


def _below(root: str, col: str = "path"):
    return F.substring_index(F.col(col), root.rsplit("/", 1)[1] + "/", -1)


_NUMBERS = ["lat", "lon", "alt", "temp", "humidity", "rain"]


@query("read_observations",
       sql("raw", f"SELECT raw.ts, station_id, source, {rr(*_NUMBERS)}, wind_dir, wind_speed, "
           + r("CASE WHEN kind <> 'nopressure' THEN pressure END", "pressure")
           + ", kind <> 'nopressure' AS has_pressure FROM raw JOIN files ON files.ts = raw.ts"
           " WHERE kind IN ('plain', 'latin', 'nopressure') AND path NOT LIKE '%HTML%'", _FILES))
def _(s, d):
    found = ob.read_observations(s, _archive(s, d))
    return found.select("ts", "station_id", "source", *[F.col(c).cast("double").alias(c) for c in _NUMBERS],
                        "wind_dir", "wind_speed", F.col("pressure").cast("double").alias("pressure"),
                        "has_pressure")


@query("decoded_text",
       sql("raw", "SELECT strftime(raw.ts, '%Y%m%d%H') AS hour, count(*) FILTER (event_id % 3 = 0) AS accents"
                  " FROM raw JOIN files ON files.ts = raw.ts WHERE kind NOT IN ('empty', 'blank') GROUP BY 1",
           _FILES))
def _(s, d):
    contents = fl.archive_files(s, _archive(s, d))
    name = F.regexp_extract("path", r"(\d{10})dadesPC", 1)
    words = F.regexp_count(fl.decoded(), F.lit("Lleidà"))
    return contents.filter(fl.decoded().rlike(r"\S")).select(name.alias("hour"), words.alias("accents"))


@query("rejected_files",
       sql("raw", "SELECT path, CASE kind WHEN 'open' THEN 'open_quote' ELSE 'no_header' END AS reason"
                  " FROM files WHERE kind IN ('bare', 'open', 'blank')", _FILES))
def _(s, d):
    root = _archive(s, d)
    return ob.rejected_files(fl.archive_files(s, root)).select(_below(root).alias("path"), "reason")


_STATUS = ("audit AS (SELECT path, CASE WHEN kind = 'empty' THEN 'empty' WHEN kind IN ('open', 'blank')"
           " THEN 'unreadable' ELSE 'ok' END AS status FROM files)")


def _audit(s, root: str) -> DataFrame:
    return fl.audit_files(fl.inventory(s, root), fl.archive_files(s, root))


@query("audit_files",
       sql("raw", "SELECT path, status, CASE WHEN status <> 'ok' THEN row_number() OVER"
                  " (PARTITION BY status ORDER BY path) END AS number FROM audit", _FILES, _STATUS))
def _(s, d):
    root = _archive(s, d)
    return _audit(s, root).withColumn("path", _below(root))


@query("audit_counts",
       sql("raw", "SELECT status, count(*) AS files FROM audit GROUP BY status", _FILES, _STATUS))
def _(s, d):
    return fl.audit_counts(_audit(s, _archive(s, d)))


@query("audit_headers",
       sql("raw", "SELECT path, CASE WHEN kind IN ('plain', 'latin', 'open') THEN 'has_header'"
                  " ELSE 'missing_header' END AS status FROM files WHERE kind <> 'empty'", _FILES))
def _(s, d):
    root = _archive(s, d)
    return fl.audit_headers(fl.archive_files(s, root)).withColumn("path", _below(root))


# paths as they occur beside the archive: other folders, hour 24, impossible dates, stray names
_NAMES = {
    "spark": "concat('/arxiu/', CASE event_id % 7 WHEN 0 THEN 'tauladades' WHEN 1 THEN '2014' WHEN 2 THEN"
             " '12_old' WHEN 3 THEN 'clima mensual' ELSE date_format(ts, 'yyyy') END, '/',"
             " CASE event_id % 5 WHEN 0 THEN 'x' ELSE '' END, date_format(ts, 'yyyyMM'),"
             " lpad(CAST(event_id % 33 AS STRING), 2, '0'), lpad(CAST(event_id % 26 AS STRING), 2, '0'),"
             " 'dadesPC_utc.csv')",
    "duck": "concat('/arxiu/', CASE event_id % 7 WHEN 0 THEN 'tauladades' WHEN 1 THEN '2014' WHEN 2 THEN"
            " '12_old' WHEN 3 THEN 'clima mensual' ELSE strftime(ts, '%Y') END, '/',"
            " CASE event_id % 5 WHEN 0 THEN 'x' ELSE '' END, strftime(ts, '%Y%m'),"
            " lpad(CAST(event_id % 33 AS VARCHAR), 2, '0'), lpad(CAST(event_id % 26 AS VARCHAR), 2, '0'),"
            " 'dadesPC_utc.csv')",
}
_NAMED = (f"named AS (SELECT event_id, event_id % 7 AS dir, {_NAMES['duck']} AS path,"
          " event_id % 5 = 0 AS stray, event_id % 33 AS d, event_id % 26 AS h, ts FROM raw)")
_STAMP = ("CASE WHEN NOT stray AND h < 24 THEN try_strptime(strftime(ts, '%Y-%m-') || lpad(CAST(d AS VARCHAR), 2, '0')"
          " || ' ' || lpad(CAST(h AS VARCHAR), 2, '0'), '%Y-%m-%d %H') END")


def _named(spark, sf_dir) -> DataFrame:
    return ev.raw(spark, sf_dir).selectExpr("event_id", f"{_NAMES['spark']} AS path")


@query("exclude_paths_cleaning",
       sql("raw", "SELECT event_id FROM named WHERE dir NOT IN (0, 2, 3)", _NAMED))
def _(s, d):
    return qa.exclude_paths(_named(s, d), "cleaning", root="/arxiu").select("event_id")


@query("exclude_paths_audit", sql("raw", "SELECT event_id FROM named WHERE dir NOT IN (0, 1)", _NAMED))
def _(s, d):
    return qa.exclude_paths(_named(s, d), "audit").select("event_id")


@query("with_file_timestamp", sql("raw", f"SELECT event_id, {_STAMP} AS ts FROM named", _NAMED))
def _(s, d):
    return qa.with_file_timestamp(_named(s, d)).select("event_id", "ts")


@query("audit_filenames",
       sql("raw", f"SELECT path, CASE WHEN stray THEN 'bad_name' WHEN h >= 24 THEN 'bad_hour' WHEN {_STAMP}"
                  " IS NULL THEN 'bad_date' ELSE 'ok' END AS status FROM named", _NAMED))
def _(s, d):
    return qa.audit_filenames(_named(s, d))


# --- sinks read back -------------------------------------------------------------------------------

_OBS = ["lat", "lon", "alt", "temp", "humidity", "rain", "pressure"]


@query("write_observations",
       sql("obs", f"SELECT station_id, ts, {rr(*_OBS)}, CAST(year(ts) AS INTEGER) AS year,"
                  " CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM obs"))
def _(s, d):
    path = _folder(s, "clean")
    ob.write_observations(ev.obs(s, d), path)
    return ob.read_clean(s, path).select("station_id", "ts", *_OBS, "year", "month", "day")


@query("save_norm_params",
       sql("features", f"SELECT feature, {rr('mean', 'std')} FROM params",
           f"params AS ({o.params('features', TARGET_COLUMNS, o.TRAIN)})"))
def _(s, d):
    path = _folder(s, "params")
    tb.save_norm_params(st.fit_norm_params(ev.features(s, d), TARGET_COLUMNS, ev.training_rows()), path)
    return tb.load_norm_params(s, path)


@query("write_graph", catalog_graph.ORACLES["build_graph_edges"])
def _(s, d):
    path = _folder(s, "graph")
    tb.write_graph(gr.build_graph(ev.features(s, d)), path)
    return tb.read_graph(s, path).edges.drop("date")


@query("write_chunks", catalog_series.ORACLES["chunk_manifest"])
def _(s, d):
    return tb.write_chunks(catalog_series._named(ev.features(s, d)), _folder(s, "chunks"))


@query("write_report", catalog_rows.ORACLES["station_coverage"])
def _(s, d):
    path = _folder(s, "report")
    coverage = rounded(qa.station_coverage(ev.obs(s, d)))
    tb.write_report(coverage, path)
    return s.read.schema(coverage.schema).csv(path, header=True)


_PLACES = ("places AS (SELECT * FROM (SELECT station_id, lat, lon, alt, row_number() OVER"
           " (PARTITION BY station_id ORDER BY ts, lat, lon, alt) AS k FROM features) WHERE k = 1)")


@query("write_prediction_cube",
       sql("features", "SELECT c.seq_id, c.h, c.ts_valid, c.station_id, c.variable, "
           + r(catalog_series._UNITS.format(x="y_true"), "y_true") + f", {rr('lat', 'lon', 'alt')},"
           " CASE variable WHEN 'temp' THEN '°C' WHEN 'humidity' THEN '%' WHEN 'rain' THEN 'mm'"
           " WHEN 'pressure' THEN 'hPa' ELSE 'km/h' END AS unit, y_true IS NOT NULL AS valid,"
           " strftime(ts_valid, '%Y-%m-%dT%H:%MZ') AS time_str FROM cube c JOIN places USING (station_id)",
           *catalog_series.SEQ, catalog_series.ROWS, catalog_series.TRUTH, catalog_series._seen(47),
           catalog_series._JOINED, _PLACES))
def _(s, d):
    path, features = _folder(s, "cube"), ev.features(s, d)
    cube = fc.to_physical_units(fc.persistence(catalog_series._sequences(s, d)))
    tb.write_prediction_cube(cube, wn.node_catalog(features), path)
    return s.read.parquet(path).select("seq_id", "h", "ts_valid", "station_id", "variable", "y_true",
                                       "lat", "lon", "alt", "unit", "valid", "time_str")


@query("read_run_log",
       f"WITH {catalog_series.RUNS} SELECT run_id, epoch, stage, {', '.join(r(m, None, 9) for m in METRICS)}"
       " FROM run_log", places=9)
def _(s, d):
    # a test row names no epoch of its own: it has that of the row before, so epochs are repeated
    runs = catalog_series._runs(s, d)
    line = F.concat_ws(",", F.col("epoch").cast("string"), "stage", *METRICS)
    rows = F.array_sort(F.collect_list(F.struct("epoch", "stage", line.alias("line"))))
    head = F.lit("run_timestamp,1\nlr,1\ntrain,1\n# epoch, stage," + ",".join(m.upper() for m in METRICS) + "\n")
    body = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    logs = runs.groupBy("run_id").agg(F.concat(head, body).alias("text")).select(
        F.concat("run_id", F.lit("/run.csv")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    root = _folder(s, "logs")
    fl.write_files(logs, root)
    found = tb.read_run_log(s, root)
    return found.select(F.regexp_replace("run_id", "/run.csv$", "").alias("run_id"), "epoch", "stage", *METRICS)

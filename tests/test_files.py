"""Archive reading, audits and sinks on small generated files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skylattice.constants import RAW_HEADER
from skylattice.operators import clean as cl, forecast as fc, graph as gr, impute as im
from skylattice.operators import quality as qa, stats as st, windows as wn
from skylattice.sources import files as fl, observations as ob, tables as tb


def line(**cells):
    return ",".join(f'"{cells.get(c.replace(".", "_"), "")}"' for c in RAW_HEADER)


STATION = dict(id="C1", Font="METEOCAT", lat="41.5", lon="2.1", Temp="10.5", VentDir="NE",
               VentFor="18", Humitat="60", Pluja="1.2", Alt="120", Patm="1010")


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")

    def put(folder, name, text, encoding="utf-8"):
        path = root / folder
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(text.encode(encoding))

    head = fl.KNOWN_HEADER
    put("2016/01/01/00", "2016010100dadesPC_utc.csv",
        "\n".join([head, line(**STATION), line(**{**STATION, "id": "C2", "Poblacio": "Vic, \"\"B\"\""}),
                   line(**STATION) + ',"extra"', '"9","C3","METEOCAT"', "", ""]))
    put("2016/01/01/01", "2016010101dadesPC_utc.csv",
        "\n".join([head, line(**{**STATION, "Poblacio": "Lleidà", "Pluja": "2.0", "Temp": " "})]), "latin-1")
    put("2016/01/01/02", "2016010102dadesPC_utc.csv", "")
    put("2016/01/01/03", "2016010103dadesPC_utc.csv", line(**STATION))
    put("2016/01/01/24", "2016010124dadesPC_utc.csv", "\n".join([head, line(**STATION)]))
    put("2016/01/01/04", "2016010104dadesPC_utc.csv", "\n".join([head, '"1","C1","METEO']))
    put("2016/01/02/00", "2016010200dadesPC_utc.csv", " \n\n")
    bare = [c for c in RAW_HEADER if c != "Patm"]
    row = dict(zip(RAW_HEADER, line(**STATION).split(","), strict=True))
    for year in ("2015", "2016"):
        put(f"{year}/05/01/00", f"{year}050100dadesPC_utc.csv",
            "\n".join([",".join(bare), ",".join(row[c] for c in bare)]))
    put("html/2016", "2016010105dadesPC_utc.csv", "\n".join([head, line(**STATION)]))
    put("2016/01/12_old", "2016010106dadesPC_utc.csv", "\n".join([head, line(**STATION)]))
    put("2016/01/01/05", "notes.txt", "nothing")
    return str(root)


def test_read_observations(spark, archive):
    rows = ob.read_observations(spark, archive).collect()
    got = {(r.ts.strftime("%Y%m%d%H"), r.station_id): r for r in rows}
    assert set(got) == {("2016010100", "C1"), ("2016010100", "C2"), ("2016010100", "C3"),
                        ("2016010101", "C1"), ("2015050100", "C1"), ("2016050100", "C1")}
    first = got["2016010100", "C1"]
    assert (first.temp, first.wind_dir, first.pressure, first.source) == ("10.5", "NE", "1010", "METEOCAT")
    assert len([r for r in rows if r.ts == datetime(2016, 1, 1)]) == 3
    assert got["2016010100", "C3"].temp is None
    assert got["2016010101", "C1"].temp is None
    assert got["2015050100", "C1"].pressure is None and got["2015050100", "C1"].temp == "10.5"
    assert not got["2016050100", "C1"].has_pressure


def test_years_and_canonical_columns(spark, archive):
    only = ob.read_observations(spark, archive, years=[2015])
    assert {r.ts.year for r in only.collect()} == {2015}
    kept = cl.select_canonical(ob.read_observations(spark, archive)).collect()
    assert datetime(2016, 5, 1) not in {r.ts for r in kept}
    assert datetime(2015, 5, 1) in {r.ts for r in kept}


def test_clean_from_files_and_back(spark, archive, tmp_path):
    raw = cl.filter_sources(cl.select_canonical(ob.read_observations(spark, archive)))
    typed = im.typed_readings(raw)
    filled = im.rain_and_imputation(typed, raw=im.first_readings(typed, "path", "line_no"))
    ob.write_observations(filled, str(tmp_path / "clean"))
    back = ob.read_clean(spark, str(tmp_path / "clean"))
    assert {"year", "month", "day"} <= set(back.columns)
    rain = {r.ts.hour: r.rain for r in back.filter("station_id = 'C1' and month = 1").collect()}
    assert rain[0] == 1.2 and rain[1] == pytest.approx(0.8)


def test_quoted_line_breaks_and_rejections(spark):
    text = "\n".join([fl.KNOWN_HEADER, line(**{**STATION, "Poblacio": "Vic\nNord\r\n, \"\"B\"\""}), line(**{**STATION, "id": "C2"})])
    files = [("/a/2016010100dadesPC_utc.csv", text), ("/a/2016010101dadesPC_utc.csv", text + '\n"'),
             ("/a/2016010102dadesPC_utc.csv", line(**STATION)), ("/a/notes.csv", text)]
    contents = spark.createDataFrame([(p, t.encode()) for p, t in files], "path string, content binary")
    rows = ob.parse_observations(contents).collect()
    assert [(r.station_id, r.lat, r.line_no) for r in rows] == [("C1", "41.5", 1), ("C2", "41.5", 2)]
    assert {(r.path[3:13], r.reason) for r in ob.rejected_files(contents).collect()} == {
        ("2016010101", "open_quote"), ("2016010102", "no_header"), ("notes.csv", "no_hour")}


def test_quoted_commas_and_very_long_lines(spark):
    """A comma inside quotes is text, however many commas a line has."""
    town = "a, b" + "," * 300_000
    cells = {**STATION, "Poblacio": f'{town}""x""', "Font": "METEOCAT"}
    text = "\n".join([fl.KNOWN_HEADER, line(**cells), line(**STATION) + "," * 300_000, line(**STATION)])
    contents = spark.createDataFrame(
        [("/a/2016010100dadesPC_utc.csv", bytearray(text.encode()))], "path string, content binary")
    rows = ob.parse_observations(contents).select("line_no", "station_id", "temp").collect()
    assert sorted(rows) == [(1, "C1", "10.5"), (3, "C1", "10.5")]
    quoted = ob._fields(ob._lines(F.lit('1,"a, b\n""c""",,"d"'))[0])
    assert spark.range(1).select(quoted.alias("f")).first()["f"] == ["1", 'a, b\n"c"', "", "d"]


def test_roots_without_a_scheme_lie_where_spark_reads(spark, archive):
    plain, full = (fl.inventory(spark, root).collect() for root in (archive, "file:" + archive))
    assert plain and sorted(plain) == sorted(full)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.viewfs.mounttable.shared.link./data", "file:" + archive)
    hadoop.set("fs.defaultFS", "viewfs://shared/")
    try:
        assert fl._qualified(spark, "/data/x") == "viewfs://shared/data/x"
        assert fl._qualified(spark, "file:/data/x") == "file:/data/x"
    finally:
        hadoop.set("fs.defaultFS", before)


def test_audits(spark, archive):
    listed = fl.inventory(spark, archive)
    contents = fl.archive_files(spark, archive)
    audit = qa.exclude_paths(fl.audit_files(listed, contents), "cleaning", root=archive)
    got = {r.path.split("/")[-1][:10]: (r.status, r.number) for r in audit.collect()}
    assert got["2016010102"] == ("empty", 1)
    assert got["2016010104"] == ("unreadable", 1) and got["2016010200"] == ("unreadable", 2)
    assert got["2016010101"] == ("ok", None)
    assert listed.count() == 11
    counts = {r.status: r.files for r in fl.audit_counts(fl.audit_files(listed, contents)).collect()}
    assert counts == {"empty": 1, "unreadable": 2, "ok": 8}
    headers = {r.path.split("/")[-1][:10]: r.status for r in fl.audit_headers(contents).collect()}
    assert headers["2016010100"] == "has_header" and headers["2016010101"] == "has_header"
    assert headers["2016010103"] == "missing_header" and headers["2015050100"] == "missing_header"


def test_audit_filenames(spark):
    names = ["2016010123dadesPC_utc.csv", "2016010124dadesPC_utc.csv", "2016023000dadesPC_utc.csv",
             "x2016010100dadesPC_utc.csv"]
    df = spark.createDataFrame([(f"/a/{n}",) for n in names], "path string")
    got = [r.status for r in qa.audit_filenames(df).collect()]
    assert got == ["ok", "bad_hour", "bad_date", "bad_name"]
    assert qa.with_file_timestamp(df).first().ts == datetime(2016, 1, 1, 23)


def test_norm_params_json(spark, tmp_path):
    params = spark.createDataFrame([("temp", 280.0, 7.5), ("rain", 0.1, 0.5)], "feature string, mean double, std double")
    tb.save_norm_params(params, str(tmp_path / "p"))
    text = "".join(f.read_text() for f in (tmp_path / "p").glob("part-*"))
    assert json.loads(text) == {"temp": {"mean": 280.0, "std": 7.5}, "rain": {"mean": 0.1, "std": 0.5}}
    assert {tuple(r) for r in tb.load_norm_params(spark, str(tmp_path / "p")).collect()} == {
        ("temp", 280.0, 7.5), ("rain", 0.1, 0.5)}
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps({"temp": {"mean": 1.0, "std": 2.0}}, indent=4))
    assert tuple(tb.load_norm_params(spark, str(pretty)).first()) == ("temp", 1.0, 2.0)


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(datetime(2024, 1, 1), "A")], "ts timestamp, station_id string")
    edges = spark.createDataFrame([(datetime(2024, 1, 1), "A", "B")], "ts timestamp, src string, dst string")
    tb.write_graph(gr.Graph(nodes, edges, nodes), str(tmp_path / "g"))
    back = tb.read_graph(spark, str(tmp_path / "g"))
    assert back.edges.select("ts", "src", "dst").first() == edges.first()
    assert "date" in back.nodes.columns


def test_chunks_and_manifest(spark, tmp_path):
    seqs = spark.createDataFrame([(f"20240101{i:02d}_x", s) for i in range(5) for s in range(2)], "seq_id string, step int")
    listing = tb.write_chunks(seqs, str(tmp_path / "c"), chunk_size=2)
    assert sorted((r.chunk_id, r.seq_id[8:10]) for r in listing.collect()) == [
        (1, "00"), (1, "01"), (2, "02"), (2, "03"), (3, "04")]
    assert spark.read.parquet(str(tmp_path / "c/sequences")).count() == 10


def test_prediction_cube(spark, tmp_path):
    cube = spark.createDataFrame(
        [("s", 1, datetime(2024, 1, 3, 5), "A", "temp", 283.15, 284.15), ("s", 1, datetime(2024, 1, 3, 5), "A", "rain", None, 0.0)],
        "seq_id string, h int, ts_valid timestamp, station_id string, variable string, y_true double, y_pred double")
    catalog = spark.createDataFrame([("A", 41.0, 2.0, 50.0)], "station_id string, lat double, lon double, alt double")
    tb.write_prediction_cube(fc.to_physical_units(cube), catalog, str(tmp_path / "cube"))
    got = {r.variable: r for r in spark.read.parquet(str(tmp_path / "cube")).collect()}
    assert got["temp"].y_pred == pytest.approx(11.0) and got["temp"].unit == "°C"
    assert got["temp"].time_str == "2024-01-03T05:00Z" and got["temp"].lat == 41.0
    assert got["temp"].valid and not got["rain"].valid


def test_report(spark, tmp_path):
    tb.write_report(st.correlation_matrix(spark.range(5).selectExpr("id * 1.0 a", "id * -2.0 b"), ["a", "b"]), str(tmp_path / "r"))
    files = list((tmp_path / "r").glob("*.csv"))
    assert len(files) == 1
    assert files[0].read_text().splitlines()[0] == "var_a,var_b,corr"


def test_run_log(spark, tmp_path):
    text = "\n".join([
        "run_timestamp,20250603", "lr,1e-5", "train,10", "# epoch, stage,loss,RMSE,MAE,R2,SMAPE",
        "1,train,0.5,1.0,0.8,0.1,30", "1,val,0.6,1.1,0.9,0.05,31", "2,train,0.4,0.9,0.7,0.2,29",
        "2,val,0.55,bad,0.85,0.1,30", ",test,,1.2,0.95,0.0,32", ",persistència,,1,1,1,1", "",
        "Detall", "Variable,RMSE_model", "Temp,1.0"])
    (tmp_path / "run.csv").write_text(text, encoding="utf-8")
    rows = tb.read_run_log(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.epoch, r.stage) for r in rows] == [(1, "train"), (1, "val"), (2, "train"), (2, "val"), (2, "test")]
    assert rows[3].rmse is None and rows[4].loss is None and rows[4].smape == 32.0
    assert rows[0].run_id == "run.csv"


def test_window_resume_skips_finished(spark):
    hours = spark.range(12).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    windows = wn.sliding_windows(hours, 3, 3, 1)
    named = wn.sequence_id(windows)
    done = named.select("seq_id").distinct().orderBy("seq_id").limit(1)
    assert wn.sequence_id(windows, done).select("seq_id").distinct().count() == 2
    assert "1970010100_1970010102" in {r.seq_id for r in named.collect()}


def test_materialized_tables_can_be_dropped(spark):
    from skylattice import session

    session._TABLES.clear()
    kept = session.materialize(spark.range(3))
    assert kept.count() == 3 and session.drop_materialized(spark) == 1
    assert not session._TABLES and session.drop_materialized(spark) == 0

"""The whole way from archive files to graphs."""

import random
from datetime import datetime

import pytest

from skylattice.constants import FEATURE_COLUMNS, RAW_HEADER
from skylattice.plans import standard
from skylattice.sources import files as fl, observations as ob

PLACES = {f"C{i}": (41.0 + 0.13 * i, 1.2 + 0.29 * ((i * 7) % 5), 40 * i) for i in range(7)}


@pytest.fixture(scope="module")
def cleaned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    rng = random.Random(4)
    for hour in range(6):
        lines = [fl.KNOWN_HEADER]
        for name, (lat, lon, alt) in PLACES.items():
            cells = dict(id=name, Font="avamet", lat=lat, lon=lon, Alt=alt, Temp=round(rng.uniform(5, 20), 1),
                         VentDir=rng.choice(["N", "SW", "ENE"]), VentFor=rng.randint(0, 40), Humitat=rng.randint(30, 99),
                         Pluja=hour * 0.5, Patm=1000 + rng.randint(0, 30))
            if name == "C3" and hour == 2:
                cells["Temp"] = ""
            if name == "C4" and hour == 3:
                cells["Humitat"] = 0
            if name == "C5":
                cells["Font"] = "unknown"
            lines.append(",".join(f'"{cells.get(c, "")}"' for c in RAW_HEADER))
        # a second report of C1 outside the study area must not replace the first
        lines.append(lines[2].replace(f'"{PLACES["C1"][0]}"', '"10.0"'))
        folder = root / f"2016/03/01/{hour:02d}"
        folder.mkdir(parents=True)
        (folder / f"20160301{hour:02d}dadesPC_utc.csv").write_text("\n".join(lines), encoding="utf-8")
    return standard.clean_readings(ob.read_observations(spark, str(root))).cache()


def test_cleaned(cleaned):
    rows = cleaned.collect()
    assert {r.station_id for r in rows} == set(PLACES) - {"C5"}
    assert len(rows) == 6 * 7
    at = {(r.station_id, r.ts.hour): r for r in rows if r.lat != 10.0}
    middle = (at["C3", 1].temp + at["C3", 3].temp) / 2
    assert at["C3", 2].temp == pytest.approx(middle)
    assert at["C0", 0].rain == 0.0 and at["C0", 4].rain == pytest.approx(0.5)


def test_graph(cleaned):
    params = standard.training_params(cleaned)
    assert {r.feature for r in params.collect()} == set(FEATURE_COLUMNS)
    graph = standard.hourly_graphs(cleaned, params)
    nodes = {(r.ts.hour, r.station_id) for r in graph.nodes.collect()}
    assert len(nodes) == 6 * 6 - 1 and (3, "C4") not in nodes
    edges = graph.edges.collect()
    assert edges and all((e.ts.hour, e.src) in nodes and (e.ts.hour, e.dst) in nodes for e in edges)
    pairs = {(e.ts, e.src, e.dst) for e in edges}
    assert all((ts, b, a) in pairs for ts, a, b in pairs) and all(a != b for _, a, b in pairs)
    assert all(abs(PLACES[e.src][2] - PLACES[e.dst][2]) <= 150 for e in edges)
    meta = {r.ts: r for r in graph.meta.collect()}
    assert sum(r.edges for r in meta.values()) == len(pairs) // 2
    assert meta[datetime(2016, 3, 1)].nodes == 6


def test_per_hour_normalisation(cleaned):
    graph = standard.hourly_graphs(cleaned, exclude_temporal=True)
    by_hour = {}
    for r in graph.nodes.collect():
        by_hour.setdefault(r.ts, []).append(r.temp)
    assert all(sum(v) == pytest.approx(0.0, abs=1e-9) for v in by_hour.values())


def test_sequences_from_graphs(spark, cleaned):
    graph = standard.hourly_graphs(cleaned)
    found = standard.hourly_sequences(graph, ["temp"], window=2, stride=1, horizon=1, chunk_size=2)
    names = {r.node_idx: r.station_id for r in found.index.collect()}
    assert list(names) and sorted(names) == list(range(len(names)))
    nodes = found.nodes.collect()
    steps = {(r.seq_id, r.step) for r in nodes}
    assert {step for _, step in steps} == {0, 1, 2} and all(r.chunk_id >= 1 for r in nodes)
    edges = found.edges.collect()
    assert {(r.seq_id, r.step) for r in edges} <= steps
    assert {r.src_idx for r in edges} | {r.dst_idx for r in edges} <= set(names)


def test_report_counts_every_reading_once(spark, cleaned):
    report = standard.graph_row_report(cleaned).collect()
    assert sum(r.rows_before for r in report) == cleaned.count()
    assert all(r.rows_before == r.rows_after + r.dropped_position + r.dropped_bbox + r.dropped_zero_humidity
               for r in report)

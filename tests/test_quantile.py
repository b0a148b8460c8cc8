"""Quantile of all distances of crowded snapshots against the plain matrix."""

import numpy as np
import pytest

from skylattice.operators import graph as gr
from skylattice.operators import quantile as qt


@pytest.fixture(scope="module")
def crowded(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t, m in ((1, 200), (2, 35), (3, 90)):
        for i in range(m):
            place = (40 + float(rng.random()), 1 + float(rng.random()), float(rng.integers(0, 1500)))
            if t == 3 and i < 40:
                place = (40.5, 1.5, 100.0)
            rows.append((t, f"S{i:03}", *place))
    return spark.createDataFrame(rows, "ts long, station_id string, lat double, lon double, alt double")


@pytest.mark.parametrize("share", [0.0, 0.1, 0.65, 1.0])
def test_quantile_equals_that_of_the_whole_matrix(crowded, share):
    want = {r.ts: r.radius for r in gr.radius_at_quantile(crowded, share).collect()}
    got = {r.ts: r.radius for r in gr.radius_at_quantile(crowded, share, max_block=30).collect()}
    assert got == {t: pytest.approx(r, abs=1e-9) for t, r in want.items()} and len(got) == 3


def test_only_straddling_parts_are_opened():
    rng = np.random.default_rng(2)
    a, b = (qt._Parts(rng.random((512, 3)) * [1, 1, 0] + [shift, 0, 0], np.ones(512, dtype=np.int64)) for shift in (0, 1))
    row = {"lo": 1.0, "hi": 1.01, "times": 2}
    opened = sum(len(d) for d, _ in qt._distances(a, b, row["lo"], row["hi"]))
    assert 0 < opened < 0.7 * 512 * 512
    d = np.sqrt(((a.at[:, None] - b.at) ** 2).sum(axis=2)).ravel()
    found = qt._count(a, b, row)
    counts = dict(zip(found["bin"].tolist(), found["n"].tolist()))
    assert counts[-1] == 2 * (d < 1.0).sum()
    inside = sum(n for k, n in counts.items() if 0 <= k < qt.BINS)
    assert inside == 2 * ((d >= 1.0) & (d < 1.01)).sum()


def test_a_refuted_guess_is_given_up(crowded, monkeypatch):
    want = {r.ts: r.radius for r in gr.radius_at_quantile(crowded, 0.3).collect()}
    monkeypatch.setattr(qt, "CLOSE", -1e-12)
    got = {r.ts: r.radius for r in gr.radius_at_quantile(crowded, 0.3, max_block=30).collect()}
    assert got == {t: pytest.approx(r, abs=1e-9) for t, r in want.items()}


def test_two_nodes_give_few_rows_however_many_their_distances():
    rng = np.random.default_rng(3)
    a, b = (qt._Parts(rng.random((2000, 3)), rng.integers(1, 3, 2000)) for _ in range(2))
    row = {"lo": 0.3, "hi": 0.9, "times": 2}
    found = qt._count(a, b, row)
    assert len(found["bin"]) <= 4098
    d = np.sqrt(((a.at[:, None] - b.at) ** 2).sum(axis=2)).ravel()
    w = np.outer(a.weight[a.weight > 0], b.weight[b.weight > 0]).sum()
    assert found["n"][found["bin"] < 0].sum() > 0 and found["n"].sum() < 2 * w
    assert (d > 0.9).any()

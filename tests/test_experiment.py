from dataclasses import replace

import numpy as np
from test_operators import make_panel

from tallycast.plans import experiment as X
from tallycast.plans.params import CITY, FAST, SCENARIOS, STATION


def test_published_settings():
    assert (CITY.horizon, STATION.horizon, STATION.steps_per_day) == (96, 48, 48)
    assert len(SCENARIOS) == 11 and FAST.samples == 1


def test_runs_are_stored_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    panel = make_panel(spark, {s: rng.poisson(m, 8 * 24) for s, m in (("a", 4), ("b", 9))}).cache()
    base = replace(CITY, samples=40, windows=2, test_start="2024-01-02 00:00:00", test_end="2024-01-02 23:45:00")
    path = str(tmp_path / "metrics")
    first = X.run_pending(panel, [(replace(base, model="gauss"), 0)], path)
    assert {r.metrics for r in first.collect()} == {"CRPS", "MSE", "CRPS-Sum", "MSE-Sum"}
    ran = []
    original = X.run
    monkeypatch.setattr(X, "run", lambda *a: ran.append(a[1].model) or original(*a))
    runs = [(replace(base, model=m), rep) for m in ("gauss", "nb_series") for rep in (0,)]
    table = X.run_pending(panel, runs, path)
    assert ran == ["nb_series"] and table.select("run_id", "model").distinct().count() == 2
    assert table.filter("metrics = 'CRPS' AND values < 1").count() == 2

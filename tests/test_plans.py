import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import T0, make_panel

from tallycast.operators.covariates import replicate_over_series
from tallycast.plans import backtest as B
from tallycast.plans import features as T
from tallycast.plans import forecast as M
from tallycast.plans import metrics as E
from tallycast.plans import sweep as S


def step_windows(n: int, spec: B.Rolling):
    """Origins by the definition: cut the test span back from its end while a horizon fits."""
    length, out = n - spec.test_start, []
    while length >= spec.horizon and len(out) < spec.windows:
        out.append(spec.test_start + length - spec.horizon)
        length -= spec.step
    return out


@pytest.mark.parametrize("spec", [
    B.Rolling(4, 4, 6, 10), B.Rolling(6, 2, 9, 20), B.Rolling(3, 5, 2, 0), B.Rolling(30, 5, 6, 5), B.Rolling(7, 3, 31, 33), B.Rolling(50, 5, 6, 0),
])
def test_origins_follow_the_definition(spark, spec):
    n = 40
    p = make_panel(spark, {"a": range(n), "b": range(n)})
    want = step_windows(n, spec)
    rows = B.forecast_rows(p, spec).filter("sid = 'a'").toPandas()
    got = rows.groupby("roll").origin.first()
    assert got.tolist() == want and got.index.tolist() == list(range(len(want)))
    for roll, origin in enumerate(want):
        part = rows[rows.roll == roll].sort_values("h")
        assert part.idx.tolist() == list(range(origin, origin + spec.horizon)) and part.h.tolist() == list(range(1, spec.horizon + 1))
    if want:
        assert B.train_rows(p, spec).agg(F.max("idx")).first()[0] == (min(want) - 1 if min(want) else None)
        ctx = B.context_rows(p, spec, 3).filter("sid = 'b'").groupBy("roll").agg(F.min("idx"), F.max("idx")).orderBy("roll").collect()
        assert [(r[1], r[2]) for r in ctx] == [(max(o - 3, 0), o - 1) for o in want if o]


def test_seasonal_error_per_origin(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 9, 60)
    spec = B.Rolling(6, 4, 5, 20)
    got = {r.roll: r.seasonal_error for r in B.seasonal_error(make_panel(spark, {"a": y}), spec, 7).collect()}
    for roll, origin in enumerate(step_windows(60, spec)):
        assert got[roll] == pytest.approx(np.abs(y[7:origin] - y[:origin - 7]).mean())


@pytest.mark.parametrize("horizon,period", [(4, 4), (3, 5), (9, 4)])
def test_seasonal_samples_stay_before_the_origin(spark, horizon, period):
    n = 60
    spec = B.Rolling(horizon, 3, 4, 30)
    p = make_panel(spark, {"a": range(n)})  # the value is its own index
    one = M.seasonal_forecast(p, spec, period, 5).toPandas()
    two = M.seasonal_sampler(p, B.forecast_rows(p, spec), period, 5, horizon).toPandas()
    for out in (one, two):
        assert len(out) == len(step_windows(n, spec)) * horizon
        for r in out.itertuples():
            first = max(k for k in range(r.idx % period, r.origin, period))
            assert [int(v) for v in r.samples] == [first - period * k for k in range(5)]


def test_scenarios_take_the_span_up_to_each_end(spark):
    p = make_panel(spark, {"a": range(20)})
    out = B.at_scenarios(p, [("x", "2024-01-01 01:00:00"), ("y", "2024-01-01 01:15:00"), ("late", "2025-01-01 00:00:00")], 3, 15).toPandas()
    assert out[out.scenario == "x"].idx.sort_values().tolist() == [2, 3, 4]
    assert out[out.scenario == "y"].idx.sort_values().tolist() == [3, 4, 5]
    assert "late" not in set(out.scenario)


# --- metrics --------------------------------------------------------------------------------------


def make_forecast(spark, items=3, horizon=4, samples=20, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(items):
        for h in range(horizon):
            rows.append((f"s{k}", 0, 50, h + 1, T0 + dt.timedelta(minutes=15 * h), 50 + h, float(rng.poisson(6)), [float(v) for v in rng.poisson(5, samples)]))
    return spark.createDataFrame(rows, "sid string, roll int, origin long, h int, ts timestamp_ntz, idx long, y double, samples array<double>"), rows


def nearest(samples, q):
    return sorted(samples)[int(np.round((len(samples) - 1) * q))]


def by_hand(rows):
    """(crps, nd, mse) over items."""
    y = np.array([r[6] for r in rows])
    total = np.abs(y).sum()
    losses = []
    for q in E.LEVELS:
        at = np.array([nearest(r[7], q) for r in rows])
        losses.append(2 * np.abs((at - y) * ((y <= at) - q)).sum() / total)
    med, mean = np.array([nearest(r[7], 0.5) for r in rows]), np.array([np.mean(r[7]) for r in rows])
    return np.mean(losses), np.abs(y - med).sum() / total, ((y - mean) ** 2).mean()


def test_metrics_by_hand(spark):
    fc, rows = make_forecast(spark)
    scored = E.scored_rows(fc)
    for q in E.LEVELS:
        got = [r[0] for r in scored.orderBy("sid", "h").select(E.level_name(q)).collect()]
        assert got == [nearest(r[7], q) for r in rows]
    items = E.item_metrics(scored)
    m = E.aggregate_metrics(items).first()
    crps, nd, mse = by_hand(rows)
    assert (m.CRPS, m.ND, m.MSE) == pytest.approx((crps, nd, mse))
    assert items.count() == 3 and m.RMSE == pytest.approx(mse**0.5)
    one = items.filter("sid = 's1'").first()
    assert (one.ND, one.MSE) == pytest.approx(by_hand([r for r in rows if r[0] == "s1"])[1:])


def test_sum_metrics_by_hand(spark):
    fc, rows = make_forecast(spark)
    summed = []
    for h in range(1, 5):
        part = [r for r in rows if r[3] == h]
        summed.append((None,) * 6 + (sum(r[6] for r in part), list(np.sum([r[7] for r in part], axis=0))))
    m = E.aggregate_metrics(E.item_metrics(E.scored_rows(E.sum_over_series(fc)), keys=["roll"]))
    assert tuple(m.select("CRPS", "ND", "MSE").first()) == pytest.approx(by_hand(summed))
    head = E.headline(E.aggregate_metrics(E.item_metrics(E.scored_rows(fc))), m).collect()
    assert [r.metrics for r in head] == list(E.KEPT)


def test_zero_targets_give_null_not_an_error(spark):
    fc, _ = make_forecast(spark, items=1)
    m = E.aggregate_metrics(E.item_metrics(E.scored_rows(fc.withColumn("y", F.lit(0.0))))).first()
    assert m.ND is None and m.CRPS is None and m.MAPE is None and m.MSE is not None


def test_bands_and_intervals(spark):
    assert E.interval_levels((50.0, 90.0)) == [0.05, 0.25, 0.5, 0.75, 0.95]
    fc, rows = make_forecast(spark)
    b = E.bands(fc, E.interval_levels((80.0,))).orderBy("sid", "h").toPandas()
    assert list(b.columns) == ["sid", "roll", "h", "ts", "y", "p10", "p50", "p90"]
    assert (b.p10 <= b.p50).all() and (b.p50 <= b.p90).all()
    wide = E.mean_wide(fc, ["s0", "s1", "s2"]).orderBy("h").toPandas()
    assert wide.s1.tolist() == pytest.approx([np.mean(r[7]) for r in rows if r[0] == "s1"])


# --- forecasters ----------------------------------------------------------------------------------

SETTINGS = M.Settings(rolling=B.Rolling(8, 8, 2, 400), samples=200, seed="t", context=40, rank=2, conditioning=60)


@pytest.fixture(scope="module")
def count_panel(spark):
    rng = np.random.default_rng(11)
    load = 1 + np.sin(np.arange(480) / 15) ** 2
    p = make_panel(spark, {s: rng.poisson(m * load) for s, m in (("a", 4), ("b", 9), ("c", 15))})
    return p.cache()


@pytest.mark.parametrize("model", sorted(M.MODELS))
def test_forecasters_share_one_shape(spark, count_panel, model):
    fc = M.forecast(model, count_panel, SETTINGS)
    assert fc.columns == ["sid", "roll", "origin", "h", "ts", "idx", "y", "samples"]
    out = fc.toPandas()
    assert len(out) == 3 * 2 * 8 and (out.samples.map(len) == 200).all()
    assert np.isfinite(np.stack(out.samples)).all()
    m = E.aggregate_metrics(E.item_metrics(E.scored_rows(fc))).first()
    assert m.ND < 0.6  # far better than forecasting zero, whose ND is 1
    level = out.assign(m=out.samples.map(np.mean)).groupby("sid").m.mean()
    assert level["a"] < level["b"] < level["c"]
    if model.startswith(("nb", "copula")):
        values = np.stack(out.samples)
        assert (values >= 0).all() and (values == np.rint(values)).all()


def test_split_forecast_totals_follow_the_total_model(spark, count_panel):
    out = M.forecast("nb_share", count_panel, SETTINGS).toPandas()
    sums = out.groupby(["origin", "h"]).samples.apply(lambda s: np.sum(np.stack(list(s)), axis=0))
    assert min(v.min() for v in sums) >= 1  # a drawn total of zero counts as one
    truth = out.groupby(["origin", "h"]).y.sum()
    assert abs(np.mean([v.mean() for v in sums]) / truth.mean() - 1) < 0.35


def test_hook_and_slots(spark, count_panel):
    hooked = M.Settings(**{**SETTINGS.__dict__, "hook": lambda df: df.filter("h = 1"), "samples": 3})
    assert M.forecast("gauss", count_panel, hooked).count() == 6
    assert M.with_slot(count_panel, "week").agg(F.max("slot")).first()[0] == 479  # five days of quarter hours from a Monday
    with pytest.raises(ValueError):
        M.slot(F.col("ts"), "month")


def test_dirichlet_moments_recover_alpha(spark):
    rng = np.random.default_rng(5)
    n, alpha = 4000, np.array([2.0, 3.0, 5.0])
    counts = np.array([rng.multinomial(5000, p) for p in rng.dirichlet(alpha, n)])
    p = make_panel(spark, {s: counts[:, k] for k, s in enumerate("abc")}).withColumn("slot", F.lit(0))
    got = {r.sid: r.alpha for r in M.dirichlet_moments(p).collect()}
    assert [got[s] for s in "abc"] == pytest.approx(alpha, rel=0.08)


def test_city_features_columns(spark):
    times = make_panel(spark, {"a": range(96)}).select("ts", "idx")
    weather = spark.createDataFrame([("2024-01-01", h, -1.0 * h, 0.0) for h in range(12)], "date string, hrr int, temp double, precip double")
    f = T.city_features(times, weather)
    assert f.columns == ["ts", "idx", *T.CALENDAR, "w_temp", "w_precip", "temp", "precip"]
    rows = f.orderBy("idx").toPandas()
    assert rows.w_temp.tolist()[44:52] == [11.0] * 4 + [0.0] * 4 and rows.precip.isna().all()
    assert T.rolled_weight(f, 8).agg(F.sum("weight")).first()[0] > 0


# --- sweeps ---------------------------------------------------------------------------------------


def test_grid_labels_and_resume(spark):
    base = spark.createDataFrame([("nb_share",), ("gauss",)], "model string")
    grid = S.repeated(S.with_grid(S.with_cell_pairs(base), dropout=list(S.DROPOUTS)))
    assert grid.count() == 2 * 6 * 2 * 6
    pair = F.col("model") == "nb_share"
    label = S.run_label(model=F.col("model"), rep=F.col("rep"), dropout=F.col("dropout"), cells2=F.when(pair, F.col("cells2")), cells1=F.when(pair, F.col("cells1")))
    labels = {r[0] for r in grid.select(label).collect()}
    assert "cells1=64;cells2=16;dropout=0.05;model=nb_share;rep=3" in labels
    assert "dropout=0.1;model=gauss;rep=0" in labels
    done = grid.filter("rep < 2")
    assert S.pending(grid, done, ["model", "cells1", "cells2", "dropout", "rep"]).count() == 2 * 6 * 2 * 4
    assert S.stacked([base, base.withColumn("x", F.lit(1))]).count() == 4


def test_a_silent_slot_keeps_its_forecast_rows(spark):
    """Two series that are 0 in half of every day: every row to forecast gets samples from either count model."""
    hours = [10.0 if (i // 48) % 2 else 0.0 for i in range(96 * 6)]
    p = make_panel(spark, {"a": hours, "b": hours})
    spec = B.Rolling(horizon=96, step=96, windows=1, test_start=96)
    for model in ("nb_share", "nb_series"):
        got = M.forecast(model, p, M.Settings(rolling=spec, samples=5, last=96 * 6 - 1)).collect()
        assert len(got) == 2 * 96 and all(len(r.samples) == 5 for r in got)


@pytest.mark.parametrize("model", sorted(M.MODELS))
def test_a_short_history_loses_no_forecast_row(spark, model):
    """Half a day of training rows: most slots of the forecast day have none."""
    p = make_panel(spark, {"a": [float(i % 5) for i in range(48 + 96)], "b": [float(i % 3) for i in range(48 + 96)]})
    spec = B.Rolling(horizon=96, step=96, windows=1, test_start=48)
    got = M.forecast(model, p, M.Settings(rolling=spec, samples=4, last=143, rank=1, context=48, conditioning=40)).collect()
    assert len(got) == 2 * 96 and all(len(r.samples) == 4 for r in got)


def test_covariates_follow_the_target(spark):
    p = make_panel(spark, {"a": range(4)})
    cov = spark.range(1, 9).selectExpr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 15 * CAST(id AS INT)) AS ts", "id AS x")
    got = replicate_over_series(p, cov, ["x"]).orderBy("ts").collect()
    assert [r.x for r in got] == [None, 1, 2, 3]


def test_seasonal_rows_without_history_are_kept(spark):
    panel = spark.createDataFrame([("a", i, float(i)) for i in range(120)] + [("b", i, 5.0) for i in range(110, 120)], "sid string, idx long, y double").withColumn(
        "ts", F.timestamp_seconds(F.col("idx") * 900))
    spec = B.Rolling(horizon=96, step=96, windows=1, test_start=0)
    for out in (M.seasonal_forecast(panel, spec, 96, 3), M.seasonal_sampler(panel, B.forecast_rows(panel, spec), 96, 3, 96)):
        got = {(r.sid, r.idx): r.samples for r in out.collect()}
        assert len(got) == 96 + 10
        assert got["a", 96] == [0.0] and got["a", 119] == [23.0]
        assert got["a", 30] == [23.0, 22.0, 21.0]
        assert got["b", 115] == [0.0]

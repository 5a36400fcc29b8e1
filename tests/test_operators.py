import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallycast.operators import calendar as C
from tallycast.operators import covariance as K
from tallycast.operators import covariates as V
from tallycast.operators import draws as R
from tallycast.operators import instances as I
from tallycast.operators import marginal as M
from tallycast.operators import panel as P
from tallycast.operators import weights as W
from tallycast.operators.blocks import sorted_codes

T0 = dt.datetime(2024, 1, 1)


def make_panel(spark, series: dict[str, list]):
    rows = [(s, T0 + dt.timedelta(minutes=15 * i), i, None if v is None else float(v)) for s, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "sid string, ts timestamp_ntz, idx long, y double")


def steps(spark, columns: dict[str, list]):
    n = len(next(iter(columns.values())))
    rows = [(T0 + dt.timedelta(minutes=15 * i), i, *[float(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, idx long, " + ", ".join(f"{c} double" for c in columns))


# --- panel --------------------------------------------------------------------------------------


def test_grid_is_never_broadcast(spark, tmp_path):
    """Without gaps the join is an inner one, and the grid is estimated as small as its series list; it must not go through the driver."""
    rows = [(T0 + dt.timedelta(hours=h, minutes=5), u, float(h)) for u in range(3) for h in range(u, 20, 5)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, value double").write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    for p in (P.value_panel(events, "user_id", "value", minutes=60).filter("y IS NOT NULL"), P.event_panel(events, "user_id", minutes=60).filter("y > 0")):
        assert "BroadcastHashJoin" not in p._jdf.queryExecution().executedPlan().toString()
        assert sorted((int(r.sid), r.ts.hour) for r in p.collect()) == sorted((u, t.hour) for t, u, _ in rows)


def test_densify_fills_gaps_over_several_grid_blocks(spark):
    events = spark.createDataFrame(
        [("a", T0), ("a", T0 + dt.timedelta(minutes=1)), ("b", T0 + dt.timedelta(days=30, minutes=14))], "k string, ts timestamp_ntz")
    p = P.event_panel(events, "k").toPandas()
    assert len(p) == 2 * (30 * 96 + 1)
    assert p.groupby("sid").y.sum().to_dict() == {"a": 2.0, "b": 1.0}
    assert (p.ts == pd.Timestamp(T0) + pd.to_timedelta(p.idx * 15, unit="min")).all()


@pytest.mark.parametrize("fill", [0.0, None])
def test_grid_is_made_in_place(spark, monkeypatch, fill):
    """Only counts and a row for each series and block are shuffled; the result is that of a join of the whole grid with the counts."""
    monkeypatch.setattr(P, "GRID_BLOCK", 4)
    at = lambda i, s=0: T0 + dt.timedelta(minutes=15 * i, seconds=s)
    given = [("a", at(0), 1.0), ("a", at(3), 2.0), ("a", at(4), None), ("a", at(9), 3.0), ("b", at(6), 4.0), ("b", at(10), 5.0), ("b", at(6), 6.0),
             ("x", at(1), 7.0), (None, at(2), 8.0), ("c", None, 9.0), ("c", at(11), 9.0), ("c", at(-1), 9.0), ("c", at(2, 30), 9.0)]
    counts = spark.createDataFrame(given, "sid string, ts timestamp_ntz, n double")
    series = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sid string")
    bounds = spark.createDataFrame([(at(0), at(10))], "a timestamp_ntz, b timestamp_ntz")
    p = P.densify(counts, series, bounds, fill=fill)
    above = p._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Exchange" not in above and "Join" not in above
    values = {}
    for sid, ts, n in given:
        values.setdefault((sid, ts), []).append(n)
    want = [(s, at(i), i, fill if n is None else n) for s in "abcd" for i in range(11) for n in values.get((s, at(i)), [None])]
    assert sorted(((r.sid, r.ts, r.idx, r.y) for r in p.collect()), key=str) == sorted(want, key=str)


def test_wide_and_long_are_inverse(spark):
    p = make_panel(spark, {"a": [1, 2, 3], "b": [4, 5, 6]})
    wide = P.to_wide(p)
    assert wide.columns == ["ts", "a", "b"]
    back = P.to_long(wide, ["a", "b"]).toPandas().sort_values(["sid", "ts"]).y.tolist()
    assert back == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        P.level_list(p, "sid", limit=1)


def test_sorted_codes_over_many_ranges(spark):
    words = [str(random.Random(i).random()) for i in range(3000)]
    df = spark.createDataFrame([(w,) for w in words + words[:50]], "s string")
    got = {r.s: r.code for r in sorted_codes(df, "s", splits=17).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def test_closed_and_half_open_slices(spark):
    p = make_panel(spark, {"a": range(10)})
    assert P.closed_slice(p, T0 + dt.timedelta(minutes=15), T0 + dt.timedelta(minutes=45)).count() == 3
    assert P.history_before(p, T0 + dt.timedelta(minutes=45)).count() == 3
    train, test = P.train_test(p, T0 + dt.timedelta(minutes=60), T0 + dt.timedelta(minutes=45))
    assert (train.count(), test.count()) == (5, 7)  # overlap allowed
    assert sorted(r.idx for r in P.tail(p, 4).collect()) == [6, 7, 8, 9]


def test_zero_total_steps_do_not_count(spark):
    p = make_panel(spark, {"a": [1, 0, 3], "b": [1, 0, 0]})
    assert P.nonzero_total_mean(p).first()[0] == 5 / 2 + 1
    assert P.nonzero_total_mean(make_panel(spark, {"a": [0, 0]})).first()[0] is None


# --- calendar and covariates ----------------------------------------------------------------------


def test_overlapping_breaks_do_not_duplicate_rows(spark):
    cal = spark.createDataFrame(
        [("Paris", "-", "2018-2019", "2024-01-01", "2024-01-02"), ("Paris", "-", "2019-2020", "2024-01-02", "2024-01-03"),
         ("Paris", "Enseignants", "2019-2020", "2024-01-05", "2024-01-06"), ("Lyon", "-", "2019-2020", "2024-01-05", "2024-01-06"),
         ("Paris", "-", "2017-2018", "2024-01-05", "2024-01-06"), ("Paris", "-", "2020-2021", "2024-01-09", "2024-01-08")],
        "zone string, population string, school_year string, a string, b string")
    days = C.expand_days(C.school_breaks(cal, "Paris", "Enseignants", 2018), "a", "b")
    times = spark.range(7).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"))
    out = C.flag_days(times, days, "day", "hol").orderBy("day").toPandas()
    assert out.hol.tolist() == [1, 1, 1, 0, 0, 0, 0]


def test_unknown_frequency_is_refused(spark):
    with pytest.raises(ValueError):
        C.fourier_date_attributes(steps(spark, {"w": [1]}), "Q")


def test_attach_fills_and_keeps_rows(spark):
    left = spark.createDataFrame([("d1", 1.0), ("d1", 2.0)], "date string, hr double")
    side = spark.createDataFrame([("d1", 2.0, 7)], "date string, hr double, v int")
    out = V.attach(left, side, ["date", "hr"], ["v"], fill=0).orderBy("hr")
    assert [r.v for r in out.collect()] == [0, 7]


def test_onehot_discovers_levels_and_drops_the_first(spark):
    df = spark.createDataFrame([(0, 1.5), (2, 1.0), (1, 1.5)], "c int, v double")
    out = V.onehot(df, ["c"])
    assert out.columns == ["v", "c_1", "c_2"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0), (0, 1), (1, 0)]


def test_max_of_zero_gives_null(spark):
    df = spark.createDataFrame([(-3.0, 0.0), (6.0, 0.0)], "t double, p double")
    assert [tuple(r) for r in V.max_normalise(df, ["t", "p"]).collect()] == [(-0.5, None), (1.0, None)]


def test_inverse_frequency_of_empty_indicator_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0), (1, 0)], "a int, b int")
    out = V.inverse_frequency(df, ["a", "b"]).collect()
    assert [(r.w_a, r.w_b) for r in out] == [(2.0, 0.0), (0.0, 0.0), (0.0, 0.0), (2.0, 0.0)]


def test_works_mask_takes_largest_level(spark):
    works = spark.createDataFrame([("d", 1.0, "Z1"), ("d", 1.0, "Z1"), ("d", 2.0, "Z9")], "date string, hr double, zone string")
    mapping = spark.createDataFrame([("Z1", "A"), ("Z1", "B")], "zone string, branch string")
    service = spark.createDataFrame(
        [("d", 1.0, "A", 5.0), ("d", 1.0, "A", 0.2), ("d", 1.0, "C", 0.4), ("d", 1.0, "C", 0.9), ("d", 2.0, "A", 3.0)],
        "date string, hr double, branch string, value double")
    out = V.masked_service(service, V.branch_mask(works, mapping)).collect()
    assert {(r.hr, r.branch): r.value for r in out} == {(1.0, "A"): 1.0, (1.0, "C"): 0.9, (2.0, "A"): 3.0}


def test_override_in_periods(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-03",), ("2024-01-09",), ("2024-01-11",)], "d string")
    v = V.override_in_periods(F.col("d"), F.lit(9.0), ["2024-01-02"], [("2024-01-09", "2024-01-10")])
    assert [r[0] for r in df.select(v).collect()] == [1.0, 9.0, 1.0, 9.0]


# --- weights and cuts -----------------------------------------------------------------------------


@pytest.mark.parametrize("block", [None, 37, 64])
def test_rolling_weight_equals_loop(spark, block):
    rng = random.Random(5)
    w1, w2 = [rng.randint(-8, 8) / 4 for _ in range(300)], [rng.randint(0, 8) / 4 for _ in range(300)]
    length = 30
    want = [0] * 300
    for i in range(length, 300 - length):
        want[i] = int(np.round(sum(w1[i - length:i]) + sum(w2[i - length:i])))
    out = W.rolling_past_weight(steps(spark, {"w1": w1, "w2": w2}), ["w1", "w2"], length, block=block).orderBy("idx")
    assert [r.weight for r in out.collect()] == want


def cut_weights(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "sid string, idx long, weight double")


def test_cut_table_is_a_partition_of_the_unit_interval(spark):
    ws = [5, -1, 0, 2, 2, 9, 9, 9]
    t = W.cut_table(cut_weights(spark, ws), min_past=1, min_future=2, block=2).orderBy("idx").toPandas()
    assert t.idx.tolist() == [1, 2, 3, 4, 5]
    assert t.p_hi.tolist() == pytest.approx(np.cumsum([1, 0, 2, 2, 9]) / 14)
    assert t.p_lo.tolist() == pytest.approx([0, *(np.cumsum([1, 0, 2, 2, 9]) / 14)[:-1]])
    zero = W.cut_table(cut_weights(spark, [0] * 8), 0, 0, length=8, block=3).toPandas()
    assert (zero.p_hi - zero.p_lo).tolist() == pytest.approx([1 / 8] * 8)


def test_draws_follow_the_weights(spark):
    n = 8000
    table = W.cut_table(cut_weights(spark, [1, 2, 0, 5]), 0, 0)
    got = W.draw_cuts(table, n, "seed").groupBy("cut").count().toPandas().set_index("cut")["count"]
    assert got.sum() == n and 2 not in got.index
    for cut, p in ((0, 1 / 8), (1, 2 / 8), (3, 5 / 8)):
        assert abs(got[cut] / n - p) < 4 * math.sqrt(p * (1 - p) / n)
    again = W.draw_cuts(table, n, "seed").groupBy("cut").count().toPandas().set_index("cut")["count"]
    assert got.sort_index().equals(again.sort_index())


def test_uniform_cuts_keep_the_expected_number(spark):
    p = make_panel(spark, {f"s{k}": [0] * 500 for k in range(8)})
    a = W.uniform_cuts(p, 100, 20, 30, "x").toPandas()
    assert a.cut.min() >= 20 and a.cut.max() <= 470
    assert abs(len(a) - 800) < 4 * math.sqrt(800)
    assert W.uniform_cuts(p, 100, 20, 30, "x", length=500).count() == len(a)


def test_series_subset_has_distinct_members_and_is_even(spark):
    cuts = spark.range(600).withColumnRenamed("id", "cut")
    codes = P.series_codes(spark.createDataFrame([(f"s{k:02d}",) for k in range(12)], "sid string"))
    got = W.series_subset(cuts, codes, 4, "z").toPandas()
    assert (got.groupby("cut").sid.nunique() == 4).all() and len(got) == 2400
    share = got.sid.value_counts() / 600
    assert (abs(share - 4 / 12) < 4 * math.sqrt((1 / 3) * (2 / 3) / 600)).all()
    assert W.series_subset(cuts.limit(1), codes, 99, "z").count() == 12


# --- instances ------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [None, 7])
def test_lags_cross_block_edges(spark, block):
    ys = list(range(50))
    out = I.lag_features(make_panel(spark, {"a": ys, "b": ys[::-1]}), [5, 1], block=block).orderBy("sid", "idx").toPandas()
    a = out[out.sid == "a"].reset_index()
    assert a.lag_1.tolist()[1:] == ys[:-1] and a.lag_5.tolist()[5:] == ys[:-5]
    assert a.lag_5.isna().sum() == 5 and len(out) == 100


def test_lag_checks():
    assert I.check_lags([4, 1, 2]) == [1, 2, 4]
    for bad in ([1, 1], [-1, 2]):
        with pytest.raises(ValueError):
            I.check_lags(bad)
    with pytest.raises(ValueError):
        I.check_lags([10], subsequence=5, length=14)


def test_windows_pad_and_stop_at_the_ends(spark):
    p = make_panel(spark, {"a": range(20)})
    cuts = spark.createDataFrame([("a", 2), ("a", 18)], "sid string, cut long")
    rows = I.windows_at(cuts, p, past=4, future=3, lead=1, dummy=-9.0)
    nested = {r.cut: r for r in I.nest_windows(rows).collect()}
    assert nested[2].past == [-9.0, -9.0, 0.0, 1.0] and nested[2].past_is_pad == [1, 1, 0, 0] and nested[2].future == [3.0, 4.0, 5.0]
    assert nested[18].past == [14.0, 15.0, 16.0, 17.0] and nested[18].future == [19.0]
    with pytest.raises(ValueError):
        I.windows_at(cuts, p, past=4, future=0)


def test_windows_keep_unobserved_future_rows(spark):
    p = make_panel(spark, {"a": [0, 1, None, 3]})
    rows = I.windows_at(spark.createDataFrame([("a", 1)], "sid string, cut long"), p, past=1, future=3)
    assert [r.y for r in rows.filter("part = 'future'").orderBy("pos").collect()] == [1.0, None, 3.0]


def test_scale_rules(spark):
    p = make_panel(spark, {"a": [1, -3, None], "b": [None, None, None], "z": [0, 0, 0]})
    s = {r.sid: r.scale for r in I.mean_scale(p, ["sid"]).collect()}
    assert s == {"a": 2.0, "b": 4 / 5, "z": 1e-10}
    s = {r.sid: r.scale for r in I.mean_scale(p, ["sid"], default=7.0).collect()}
    assert s["b"] == 7.0
    assert I.total_scale(I.mean_scale(p, ["sid"])).first()[0] == pytest.approx(2.8)


def test_padding_is_unobserved_and_imputed_zero(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 0), (5.0, 1)], "y double, pad int")
    seen = I.observed(F.col("y"), F.col("pad"))
    assert [r[0] for r in df.select(seen).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(I.impute(F.col("y"), seen, F.col("pad"), F.lit(8.0))).collect()] == [1.0, 8.0, 0.0]


def test_masked_average(spark):
    df = spark.createDataFrame([(2.0, 1.0), (float("nan"), 0.0), (6.0, 3.0)], "x double, w double")
    a, b = df.agg(I.masked_average(F.col("x"), F.col("w")), I.masked_average(F.col("x"), F.col("w"), True)).first()
    assert a == 5.0 and b == pytest.approx(20 / 3)


def test_short_series_fail_prediction_and_drop_from_validation(spark):
    lengths = spark.createDataFrame([("long", 50), ("short", 12)], "sid string, length long")
    assert [tuple(r) for r in I.last_cut(lengths, 10, 5).collect()] == [("long", 45)]
    with pytest.raises(Exception, match="series too short: short"):
        I.last_cut(lengths, 10, 5, allow_empty=False).collect()


def test_violations_name_the_rule(spark):
    p = make_panel(spark, {"ok": [1] * 10, "neg": [-1] + [1] * 9, "gone": [None] * 10})
    p = p.unionByName(make_panel(spark, {"short": [1, 2]}))
    got = {tuple(r) for r in I.violations(p, I.mean_scale(p, ["sid"]), max_lag=5, horizon=2).collect()}
    assert got == {("neg", "support"), ("gone", "observed"), ("short", "history")}


# --- marginal and dependence ------------------------------------------------------------------------


def test_marginal_round_trip(spark):
    ys = [random.Random(i).randint(0, 30) for i in range(60)]
    p = make_panel(spark, {"a": ys})
    recent = M.sorted_recent(p, 60)
    z = M.to_gaussian(p, recent, 60)
    back = M.from_gaussian(z.drop("y"), recent).orderBy("idx").toPandas().y.tolist()
    margin = M.clip_margin(60)
    share = {y: sum(v <= y for v in ys) / 60 for y in ys}
    inner = [(b, y) for b, y in zip(back, ys) if margin < share[y] < 1 - margin]  # outside, ranks are clipped
    assert len(inner) > 40 and all(b == y for b, y in inner)
    zs = z.orderBy("y").toPandas().z
    assert zs.is_monotonic_increasing and abs(zs.min()) < 4


@pytest.mark.parametrize("width", [2, 3, 256])
def test_covariance_by_blocks(spark, width):
    rng = np.random.default_rng(1)
    data = rng.poisson(5, (80, 7)) + rng.poisson(2, (80, 1))
    p = make_panel(spark, {f"s{k}": data[:, k] for k in range(7)})
    got = K.covariance(p, width=width).toPandas()
    assert len(got) == 28
    cov, corr = np.cov(data.T), np.corrcoef(data.T)
    for r in got.itertuples():
        i, j = int(r.sid_a[1:]), int(r.sid_b[1:])
        assert r.cov == pytest.approx(cov[i, j]) and r.corr == pytest.approx(corr[i, j])


@pytest.mark.parametrize("width", [1, 256])
def test_pairs_of_series_are_not_shuffled(spark, width):
    """Several blocks to a strip, or several tasks to a pair; the result's pairs come from the tasks that multiply."""
    rng = np.random.default_rng(3)
    data = rng.poisson(4, (600, 40)) + rng.poisson(2, (600, 1))
    data[:, 7] = 3
    rows = [(f"s{k:02}", i, i, float(data[i, k])) for k in range(40) for i in range(600)]
    found = K.covariance(spark.createDataFrame(rows, "sid string, ts long, idx long, y double"), width=width)
    above = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(above) > 1 and "Exchange" not in above[0]
    got = found.toPandas()
    i, j = got.sid_a.str[1:].astype(int).to_numpy(), got.sid_b.str[1:].astype(int).to_numpy()
    assert sorted(zip(i, j)) == [(a, b) for a in range(40) for b in range(a, 40)]
    cov = np.cov(data.T)
    assert got["cov"].to_numpy() == pytest.approx(cov[i, j], abs=1e-9)
    flat = (i == 7) | (j == 7)
    assert got["corr"].isna().to_numpy().tolist() == flat.tolist()
    scale = np.sqrt(np.diag(cov))
    assert got["corr"][~flat].to_numpy() == pytest.approx((cov[i, j] / np.maximum(scale[i] * scale[j], 1e-300))[~flat])


def test_covariance_writes_and_shuffles_packed_runs_only(spark):
    """Cells of a dense panel go to runs where they are made: some bytes for 256 cells, and no row for each of them afterwards."""
    from tallycast.operators.tiles import panel_runs

    grid = spark.range(0, 60, 1, 4).select(F.format_string("s%02d", "id").alias("sid"), "id").select("sid", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))).alias("idx"))
    panel = grid.select("sid", "idx", ((F.col("idx") * 7 + F.col("id") * F.col("idx")) % 11 == 0).cast("double").alias("y"))
    runs = panel_runs(panel)
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    got = runs.select("sid", "rows", "n", F.length("data").alias("bytes")).collect()
    assert sorted((r.sid, r.rows, r.n) for r in got) == [(f"s{k:02}", b, n) for k in range(60) for b, n in enumerate((256, 256, 208))]
    assert sum(r.bytes for r in got) < 60 * 720 / 2
    found = K.covariance(panel)
    assert found.count() == 60 * 61 // 2


@pytest.mark.parametrize("scale, shift", [(1, 0), (1, -300), (0.1, 1e6), (1, 70_000)])
def test_covariance_of_cells_in_any_order(spark, monkeypatch, scale, shift):
    """Runs of few cells that come out of order, values of every packed type, absent cells at their mean, series that do not vary."""
    from tallycast.operators import tiles

    monkeypatch.setattr(tiles, "RUN_CELLS", 100)
    rng = np.random.default_rng(4)
    data = (rng.poisson(3, (300, 9)) + rng.poisson(2, (300, 1))) * scale + shift
    data[:, 4] = 0.1
    there = np.ones((300, 9), bool)
    there[290:, 5] = there[10:200:7, 2] = False
    rows = [(f"s{k}", i, float(data[i, k])) for k in range(9) for i in range(300) if there[i, k]]
    random.Random(1).shuffle(rows)
    got = K.covariance(spark.createDataFrame(rows, "sid string, idx long, y double"), width=4).toPandas()
    assert len(got) == 45
    mean = np.array([data[there[:, k], k].mean() for k in range(9)])
    off = np.where(there, data - mean, 0.0)
    off[:, 4] = 0.0
    sd = np.array([data[there[:, k], k].std(ddof=1) for k in range(9)])
    for r in got.itertuples():
        i, j = int(r.sid_a[1:]), int(r.sid_b[1:])
        cov = off[:, i] @ off[:, j] / 299
        assert r.cov == pytest.approx(cov, rel=1e-8, abs=1e-9)
        assert np.isnan(r.corr) if 4 in (i, j) else r.corr == pytest.approx(cov / (sd[i] * sd[j]), rel=1e-8, abs=1e-9)


def test_rounding_of_many_rows_is_that_of_one(spark):
    from tallycast.catalog.registry import rounded

    drawn = spark.range(200_000).select((F.rand(1) * F.pow(F.lit(10.0), F.rand(2) * 14 - 8) * F.when(F.rand(3) < 0.5, -1).otherwise(1)).alias("x"))
    ties = spark.range(200_000).select(((F.col("id") - 100_000) * 0.5e-6).alias("x"))
    odd = spark.sql("SELECT explode(array(double('NaN'), double('Infinity'), -double('Infinity'), NULL, -0.0D, -1e-9D, 1e300D, 1e-320D, 999.9999995D)) AS x")
    both = drawn.union(ties).union(odd).select("x", F.col("x").alias("y"))
    found = rounded(rounded(both, "x"), "y", many=True)
    assert found.filter(~F.col("x").eqNullSafe(F.col("y"))).count() == 0 and found.count() == 400_009


def test_factors_reproduce_the_covariance(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 5)) + rng.normal(size=(200, 5)) * 0.1
    p = make_panel(spark, {f"s{k}": data[:, k] for k in range(5)})
    loadings, _ = K.factor_model(p, 5)
    L = np.array([r.loadings for r in loadings.orderBy("sid").collect()])
    assert L @ L.T == pytest.approx(np.cov(data.T), abs=1e-8)
    two, diag = K.factor_model(p, 2)
    L2 = np.array([r.loadings for r in two.orderBy("sid").collect()])
    d = np.array([r.diag for r in diag.orderBy("sid").collect()])
    assert np.diag(L2 @ L2.T) + d == pytest.approx(np.var(data, axis=0, ddof=1))
    assert np.abs(L2 @ L2.T - np.cov(data.T)).max() < 0.05
    values = np.sort(np.linalg.eigvalsh(np.cov(data.T)))[::-1]
    assert (L2**2).sum(axis=0) == pytest.approx(values[:2], rel=1e-6)
    flat = K.factor_model(p.withColumn("y", F.lit(3.0)), 2)
    assert all(r.diag == 0 for r in flat[1].collect())
    assert K.factor_model(p.filter("false"), 2)[0].count() == 0


def test_factors_of_a_flat_spectrum(spark):
    data = np.random.default_rng(5).poisson(3, (100, 150)).astype(float)
    rows = [(f"s{k:03}", i, float(data[i, k])) for k in range(150) for i in range(100)]
    p = spark.createDataFrame(rows, "sid string, ts int, y double")
    loadings, _ = K.factor_model(p, 3)
    got = np.array([r.loadings for r in loadings.orderBy("sid").collect()])
    values, vectors = np.linalg.eigh(np.cov(data.T))
    assert (got**2).sum(axis=0) == pytest.approx(values[::-1][:3], rel=0.005)
    assert np.trace(got @ got.T @ vectors[:, -3:] @ vectors[:, -3:].T) > 0.99 * values[-3:].sum()


def test_factor_noise_has_the_wanted_covariance(spark):
    rows = [("a", [1.0, 0.5], 0.25), ("b", [2.0, -1.0], 1.0)]
    df = spark.createDataFrame(rows, "sid string, loadings array<double>, diag double").withColumn("origin", F.lit(1))
    draws = {r.sid: np.array(r.e) for r in R.with_step_normals(df, 4000, "q", ["origin"]).withColumn("e", R.factor_noise(4000, "q", ["origin"])).collect()}
    got = np.cov(draws["a"], draws["b"])
    assert got == pytest.approx(np.array([[1.5, 1.5], [1.5, 6.0]]), abs=0.45)


# --- draws ----------------------------------------------------------------------------------------


def test_nb_draws_have_the_moments(spark):
    df = spark.createDataFrame([("a", 6.0, 2.0), ("b", 0.0, 5.0)], "sid string, mu double, shape double")
    got = {r.sid: np.array(r.samples) for r in R.nb_samples(df, 6000, "n", ["sid"]).collect()}
    assert abs(got["a"].mean() - 6) < 4 * math.sqrt(24 / 6000) and got["a"].var() == pytest.approx(24, rel=0.12)
    assert (got["a"] >= 0).all() and (got["a"] == np.rint(got["a"])).all() and (got["b"] == 0).all()
    forced = R.nb_samples(df, 100, "n", ["sid"], at_least_one=True).collect()
    assert all(min(r.samples) >= 1 for r in forced)


def split_frames(spark, n, total, alpha):
    alphas = spark.createDataFrame([(0, s, v) for s, v in alpha.items()], "slot int, sid string, alpha double")
    rows = spark.range(n).select(F.lit(0).alias("slot"), F.col("id").alias("step"), F.array(F.lit(float(total)), F.lit(0.0)).alias("counts"))
    return rows, alphas


@pytest.mark.parametrize("fan_out", [2, 3, 256])
def test_split_adds_up_and_has_dirichlet_multinomial_moments(spark, fan_out):
    alpha = {"a": 1.0, "b": 2.0, "c": 0.5, "d": 4.0, "e": 2.5}
    n, total = 3000, 20
    draws, alphas = split_frames(spark, n, total, alpha)
    out = R.dm_split(draws, alphas, ["step"], "slot", "k", fan_out=fan_out).toPandas()
    assert all(c[1] == 0 for c in out.counts)
    out["y_hat"] = [c[0] for c in out.counts]
    wide = out.pivot(index="step", columns="sid", values="y_hat")
    assert len(wide) == n and (wide.sum(axis=1) == total).all() and wide.min().min() >= 0
    a0 = sum(alpha.values())
    for s, v in alpha.items():
        p = v / a0
        var = total * p * (1 - p) * (total + a0) / (1 + a0)
        assert abs(wide[s].mean() - total * p) < 4.5 * math.sqrt(var / n)
        assert wide[s].var() == pytest.approx(var, rel=0.2)
    pair = np.cov(wide["a"], wide["d"])[0, 1]
    assert pair == pytest.approx(-total * 0.1 * 0.4 * (total + a0) / (1 + a0), rel=0.25)


def test_split_does_not_depend_on_the_fan_out(spark):
    rng = np.random.default_rng(1)
    alpha = {f"s{i:03d}": float(a) for i, a in enumerate(rng.gamma(1.0, 2.0, 37) + 0.01)}
    draws, alphas = split_frames(spark, 20, 500, alpha)
    found = []
    for fan_out in (2, 4, 64):
        out = R.dm_split(draws, alphas, ["step"], "slot", "k", fan_out=fan_out)
        found.append(sorted((r.step, r.sid, tuple(r.counts)) for r in out.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 20 * 37


def test_split_without_bound_on_the_concentration_is_multinomial(spark):
    draws, alphas = split_frames(spark, 2000, 1000, {"a": 3e12, "b": 1e12})
    out = R.dm_split(draws, alphas, ["step"], "slot", "k").toPandas()
    first = np.array([c[0] for c, s in zip(out.counts, out.sid) if s == "a"])
    assert first.var() == pytest.approx(1000 * 0.75 * 0.25, rel=0.12) and abs(first.mean() - 750) < 2


def test_draws_hold_no_table(spark):
    df = spark.createDataFrame([("a", 1e6, 1.0), ("b", 1e6, None)], "sid string, mu double, shape double")
    out = R.nb_samples(df, 400, "n", ["sid"])
    assert not any(w in out._jdf.queryExecution().optimizedPlan().toString() for w in ("_pmf", "explode"))
    got = {r.sid: np.array(r.samples) for r in out.collect()}
    assert abs(got["a"].mean() / 1e6 - 1) < 0.2 and got["a"].std() / 1e6 == pytest.approx(1, rel=0.2)
    assert abs(got["b"].mean() - 1e6) < 250 and got["b"].std() == pytest.approx(1000, rel=0.15)


def test_pmf_table_matches_closed_form(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0)], "sid string, mu double, shape double")
    t = R.nb_table(df, ["sid"]).orderBy("k").toPandas()
    want = (1 / 3) * (2 / 3) ** np.arange(len(t))  # shape 1 is geometric
    assert t.pmf.to_numpy() == pytest.approx(want) and t.cdf.to_numpy() == pytest.approx(np.cumsum(want))
    assert t.cdf.max() == pytest.approx(1.0, abs=1e-10)


@pytest.mark.parametrize("mean, shape", [(1e6, 1e6), (1e6, 50.0), (1e6, None), (0.01, 0.001), (3e4, 1e12)])
def test_support_holds_the_mass_at_any_size(spark, mean, shape):
    df = spark.createDataFrame([("a", mean, shape)], "sid string, mu double, shape double")
    t = R.nb_table(df, ["sid"]).toPandas()
    variance = mean + (mean * mean / shape if shape else 0.0)
    assert t.pmf.sum() == pytest.approx(1.0, abs=1e-7)
    assert (t.k * t.pmf).sum() == pytest.approx(mean, rel=1e-6)
    assert ((t.k - mean) ** 2 * t.pmf).sum() == pytest.approx(variance, rel=1e-5)
    drawn = np.array(R.nb_samples(df, 2000, "n", ["sid"]).first().samples)
    assert abs(drawn.mean() - mean) < 5 * math.sqrt(variance / 2000)

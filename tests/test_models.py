import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import make_panel

from tallycast.functions import numeric as N
from tallycast.operators import covariance as K
from tallycast.operators import tiles
from tallycast.plans import backtest as B
from tallycast.plans import forecast as M


def test_derivatives_of_log_gamma(spark):
    gamma, pi = 0.5772156649015329, math.pi
    known = {0.5: (-gamma - 2 * math.log(2), pi**2 / 2), 1.0: (-gamma, pi**2 / 6), 2.5: (8 / 3 - gamma - 2 * math.log(2), pi**2 / 2 - 40 / 9),
             1e5: (math.log(1e5) - 0.5e-5 - 1e-10 / 12, 1e-5 + 0.5e-10 + 1e-15 / 6), 1e-3: (-1000.5755719318, 1000001.642533)}
    got = spark.createDataFrame([(v,) for v in known], "x double").select(N.digamma(F.col("x")), N.trigamma(F.col("x"))).collect()
    for (first, second), want in zip(got, known.values()):
        assert first == pytest.approx(want[0], rel=1e-9) and second == pytest.approx(want[1], rel=1e-9)


def test_rolled_forward_values_enter_the_next_ones(spark):
    """Without noise: a panel that follows its own recursion is continued exactly."""
    def path(first, second):
        y = [first, second]
        while len(y) < 60:
            y.append(1.0 + 0.5 * y[-1] + 0.3 * y[-2])
        return y

    p = make_panel(spark, {"a": path(9.0, 2.0), "b": path(1.0, 7.0)})
    spec = B.Rolling(horizon=10, step=10, windows=2, test_start=30)
    rows = M.forecast("lag_recursive", p, M.Settings(rolling=spec, samples=2, last=59, lags=(1, 2))).collect()
    assert len(rows) == 2 * 2 * 10
    assert all(v == pytest.approx(r.y, abs=1e-6) for r in rows for v in r.samples)


def test_recursive_noise_grows_with_the_horizon(spark):
    rng = np.random.default_rng(1)
    y = [0.0]
    for _ in range(800):
        y.append(0.9 * y[-1] + rng.standard_normal())
    p = make_panel(spark, {"a": y})
    spec = B.Rolling(horizon=20, step=20, windows=1, test_start=700)
    rows = {r.h: np.array(r.samples) for r in M.forecast("lag_recursive", p, M.Settings(rolling=spec, samples=3000, last=800, lags=(1,))).collect()}
    assert rows[1].var() == pytest.approx(1.0, rel=0.15) and rows[20].var() == pytest.approx(1 / (1 - 0.81), rel=0.25)
    assert np.corrcoef(rows[19], rows[20])[0, 1] > 0.8


def test_moments_of_every_origin_equal_those_of_its_history(spark):
    rng = np.random.default_rng(2)
    p = make_panel(spark, {s: rng.poisson(4, 400) for s in "ab"})
    s = M.Settings(rolling=B.Rolling(horizon=20, step=33, windows=5, test_start=200), last=399)
    got = {(r.sid, r.slot, r.roll): (r.n, r.mu, r["var"]) for r in M.origin_moments(M.with_slot(p), s).collect()}
    frame = M.with_slot(p).toPandas()
    assert {k[2] for k in got} == set(range(5))
    for (sid, slot, roll), (n, mu, var) in got.items():
        own = frame[(frame.sid == sid) & (frame.slot == slot) & (frame.idx < 380 - 33 * roll)].y
        assert n == len(own) and mu == pytest.approx(own.mean()) and (var is None or var == pytest.approx(own.var(), abs=1e-9))


def test_count_regression_recovers_its_parameters(spark):
    rng = np.random.default_rng(3)
    x, z = rng.standard_normal(20_000), rng.integers(0, 2, 20_000)
    mu = np.exp(1.0 + 0.5 * x - 0.7 * z)
    y = rng.negative_binomial(3.0, 3.0 / (3.0 + mu))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "y": y.astype(float)}))
    beta, theta = M.nb_regression(df, [F.lit(1.0), F.col("x"), F.col("z")], F.col("y"))
    assert beta == pytest.approx([1.0, 0.5, -0.7], abs=0.05) and math.exp(theta) == pytest.approx(3.0, rel=0.1)
    # at the maximum the derivatives vanish
    m = np.exp(beta[0] + beta[1] * x + beta[2] * z)
    r = math.exp(theta)
    for column in (np.ones_like(x), x, z):
        assert abs((column * (y - m) * r / (r + m)).sum()) < 1e-4


def test_counts_without_excess_become_poisson(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"y": rng.binomial(10, 0.5, 2000).astype(float)}))
    beta, theta = M.nb_regression(df, [F.lit(1.0)], F.col("y"))
    assert theta == M.LOG_SHAPE_BOUNDS[1] and math.exp(beta[0]) == pytest.approx(5, rel=0.05)
    assert M.nb_regression(df.filter("false"), [F.lit(1.0)], F.col("y"))[1] == M.LOG_SHAPE_BOUNDS[1]


def wide_panel(spark, series, steps, factors, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((steps, factors)) @ rng.standard_normal((factors, series)) * 2 + rng.standard_normal((steps, series))
    frame = pd.DataFrame({"sid": np.tile([f"s{i:04d}" for i in range(series)], steps), "t": np.repeat(np.arange(steps), series), "y": x.ravel()})
    return x, spark.createDataFrame(frame).withColumn("ts", F.timestamp_seconds(F.col("t") * 900)).drop("t")


@pytest.mark.parametrize("series, steps", [(300, 330), (40, 25)])
def test_whole_factors_give_the_covariance(spark, series, steps, monkeypatch):
    x, p = wide_panel(spark, series, steps, 3)
    for limit in (2048, 10):
        monkeypatch.setattr(K, "WHOLE_LIMIT", limit)
        loadings, diag = K.factor_model(p, 10**9)
        rows = np.stack(loadings.orderBy("sid").toPandas().loadings)
        assert np.allclose(rows @ rows.T + np.diag(diag.orderBy("sid").toPandas()["diag"]), np.cov(x.T), atol=1e-8)


def test_leading_factors_of_many_series_equal_numpy(spark):
    x, p = wide_panel(spark, 300, 280, 4)
    loadings, _ = K.factor_model(p, 4)
    rows = np.stack(loadings.orderBy("sid").toPandas().loadings)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    top = vectors[:, -4:] * np.sqrt(values[-4:])
    assert rows.shape == (300, 4) and np.abs(rows @ rows.T - top @ top.T).max() < 0.02 * np.abs(top @ top.T).max()


def test_tiles_multiply_as_matrices(spark):
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((300, 290)), rng.standard_normal((290, 3))
    cells = spark.createDataFrame(pd.DataFrame({"step": np.repeat(np.arange(300), 290), "code": np.tile(np.arange(290), 300), "v": x.ravel()}))
    t = tiles.panel_tiles(cells, 290).cache()
    basis = tiles.blocks_of(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "code long, q array<double>"))
    ahead = tiles.times(t, basis, 3, "columns")
    got = {r.code: r.q for r in tiles.rows_of(ahead, 3).collect()}
    assert np.allclose([got[i] for i in range(300)], x @ q)
    back = {r.code: r.q for r in tiles.rows_of(tiles.times(t, ahead, 3, "rows"), 3).collect()}
    assert np.allclose([back[i] for i in range(290)], x.T @ x @ q) and np.allclose(tiles.inner_products(basis, 3), q.T @ q)
    assert not tiles.inner_products(basis.filter("false"), 3).any()


@pytest.mark.parametrize("a, y", [(0.3, 2.0), (19.0, 5.0), (25.0, 40.0), (999.0, 3.0), (2000.0, 7.0), (1e9, 12.0), (5.0, 0.0)])
def test_rises_of_the_derivatives_equal_their_sums(spark, a, y):
    first, second = spark.range(1).select(N.digamma_rise(F.lit(y), F.lit(a)), N.trigamma_rise(F.lit(y), F.lit(a))).first()
    j = a + np.arange(int(y))
    assert first == pytest.approx((1 / j).sum(), rel=1e-7, abs=1e-18) and second == pytest.approx(-(1 / j**2).sum(), rel=1e-5, abs=1e-24)


def test_concentrations_by_likelihood(spark):
    rng = np.random.default_rng(7)
    truth = {0: np.array([2.0, 3.0, 0.5]), 1: np.array([40.0, 10.0, 25.0])}
    frames = []
    for slot, alpha in truth.items():
        counts = np.array([rng.multinomial(rng.integers(0, 60), p) for p in rng.dirichlet(alpha, 3000)])
        frames.append(pd.DataFrame({"slot": slot, "idx": np.repeat(np.arange(3000) + 3000 * slot, 3), "sid": ["a", "b", "c"] * 3000, "y": counts.ravel().astype(float)}))
    panel = spark.createDataFrame(pd.concat(frames)).withColumn("ts", F.timestamp_seconds(F.col("idx") * 900))
    got = {(r.slot, r.sid): r.alpha for r in M.dirichlet_likelihood(panel).collect()}
    for slot, alpha in truth.items():
        assert [got[slot, s] for s in "abc"] == pytest.approx(alpha, rel=0.1)
    # the likelihood is flat there: the fixed point of the derivatives
    frame = pd.concat(frames)
    wide = frame[frame.slot == 0].pivot(index="idx", columns="sid", values="y").to_numpy()
    wide = wide[wide.sum(1) > 0]
    a = np.array([got[0, s] for s in "abc"])
    rise = lambda n, x: sum((1 / (x + np.arange(int(v)))).sum() for v in n)
    assert all(abs(rise(wide[:, k], a[k]) - rise(wide.sum(1), a.sum())) < 1e-3 for k in range(3))


def test_concentrations_of_odd_panels(spark):
    flat = make_panel(spark, {"a": [6.0] * 50, "b": [3.0] * 50, "c": [0.0] * 50}).withColumn("slot", F.lit(0))
    got = {r.sid: r.alpha for r in M.dirichlet_likelihood(flat).collect()}
    assert got["c"] == M.ALPHA_FLOOR and got["a"] / got["b"] == pytest.approx(2.0, rel=1e-3) and got["a"] > 1e4
    empty = make_panel(spark, {"a": [0.0] * 5}).withColumn("slot", F.lit(0))
    assert M.dirichlet_likelihood(empty).count() == 0


def test_sweep_ranks_come_from_one_basis(spark):
    """Every rank's cross-series variance against numpy, by the score of the sums."""
    from tallycast.plans import sweep as S

    x, p = wide_panel(spark, 6, 300, 2, seed=8)
    p = p.withColumn("idx", (F.col("ts").cast("long") / 900).cast("long"))
    s = M.Settings(rolling=B.Rolling(horizon=10, step=10, windows=3, test_start=200), last=299, slot_kind="hour")
    ranks, contexts = (0, 1, 3, 6), (5, 40)
    got = {(r.context, r.rank): r for r in S.gaussian_sweep(p, s, contexts, ranks).collect()}
    hours = (np.arange(300) // 4) % 24
    train = x[:270]
    mu = np.array([[train[hours[:270] == k, j].mean() if (hours[:270] == k).any() else train[:, j].mean() for j in range(6)] for k in range(24)])
    residual = train - mu[hours[:270]]
    cov = np.cov(residual.T)
    values, vectors = np.linalg.eigh(cov)
    score = lambda y, m, sd: (lambda z: sd * (z * math.erf(z / 2**0.5) + 2 * math.exp(-z * z / 2) / (2 * math.pi) ** 0.5 - math.pi**-0.5))((y - m) / sd)
    for context in contexts:
        for rank in ranks:
            shared = vectors[:, 6 - rank :] * np.sqrt(np.maximum(values[6 - rank :], 0))
            sums, single = [], []
            for origin in (290, 280, 270):
                f = np.abs(x[origin - context : origin]).mean(0) / np.abs(train).mean(0)
                for t in range(origin, origin + 10):
                    m = mu[hours[t]] * f
                    own = np.maximum(np.diag(cov) - (shared**2).sum(1), 0)
                    sums.append(score(x[t].sum(), m.sum(), math.sqrt(((shared * f[:, None]).sum(0) ** 2).sum() + (own * f * f).sum())))
                    single += [score(x[t, j], m[j], math.sqrt(cov[j, j]) * f[j]) for j in range(6)]
            r = got[context, rank]
            assert (r.n, r.n_sum) == (180, 30) and r.crps == pytest.approx(np.mean(single), rel=1e-6)
            assert r.sum_crps == pytest.approx(np.mean(sums), rel=1e-3)
    assert len({round(r.sum_crps, 6) for r in got.values()}) == 8


def test_stream_scores_equal_the_batch(spark, tmp_path):
    from tallycast.streaming.buckets import stream_bucket_counts, write_buckets
    from tallycast.streaming.scores import score_buckets, score_stream

    rng = np.random.default_rng(9)
    minutes = np.sort(rng.integers(0, 3 * 24 * 60, 3000))
    late = minutes.copy()
    swap = rng.integers(0, 2900, 300)
    late[swap], late[swap + 20] = minutes[swap + 20], minutes[swap]  # out of order within the allowed lateness
    rows = pd.DataFrame({"k": rng.choice(["a", "b"], 3000), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(late, "m")})
    schema = "k string, ts timestamp_ntz"
    files = tmp_path / "events"
    files.mkdir()
    events = spark.readStream.schema(schema).parquet(str(files))
    buckets = f"file://{tmp_path}/buckets"
    out, counted = f"{tmp_path}/scores", stream_bucket_counts(events, "k", minutes=15, lateness="12 hours")
    for part in np.array_split(np.arange(3000), 3):
        spark.createDataFrame(rows.iloc[part]).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(files))
        write_buckets(counted, buckets, f"{tmp_path}/c1", once=True).awaitTermination()
        stream = spark.readStream.schema("sid string, ts timestamp, n bigint").parquet(buckets)
        score_stream(stream, "n").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).toPandas().sort_values(["sid", "ts"]).reset_index(drop=True)
    want = score_buckets(spark.read.parquet(buckets), "n").toPandas().sort_values(["sid", "ts"]).reset_index(drop=True)
    assert len(got) > 300 and got[["sid", "ts", "y", "seen"]].equals(want[["sid", "ts", "y", "seen"]])
    assert np.allclose(got["mean"].astype(float), want["mean"].astype(float), equal_nan=True) and np.allclose(got["z"].astype(float), want["z"].astype(float), equal_nan=True)


@pytest.mark.parametrize("model", sorted(M.FITTED))
def test_saved_tables_give_the_same_forecast(spark, tmp_path, model):
    from tallycast.sources.writers import load_parameters, save_parameters

    rng = np.random.default_rng(10)
    p = make_panel(spark, {s: rng.poisson(m, 300) for s, m in (("a", 3), ("b", 8))}).cache()
    s = M.Settings(rolling=B.Rolling(horizon=8, step=8, windows=2, test_start=250), samples=4, last=299, rank=1, context=16, conditioning=40, lags=(1, 8))
    fit, predict = M.FITTED[model]
    tables = fit(p, s)
    save_parameters(tables, str(tmp_path))
    loaded = predict(p, load_parameters(spark, str(tmp_path), list(tables)), s).collect()
    direct = M.forecast(model, p, s).collect()
    key = lambda r: (r.sid, r.origin, r.h)
    assert {key(r): r.samples for r in loaded} == {key(r): pytest.approx(r.samples, abs=1e-6) for r in direct} and len(loaded) == 2 * 2 * 8
    assert sorted(M.FITTED) == sorted(M.MODELS)


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_affine_scan_equals_a_loop_across_block_edges(spark, block):
    from tallycast.operators.blocks import affine_scan

    rng = np.random.default_rng(11)
    rows, want = [], {}
    for sid, x in (("a", 2.0), ("b", -1.0)):
        value = x
        for i in range(300):
            if sid == "b" and 40 <= i < 90:  # rows that are not there: whole blocks are missing
                continue
            shift, factor = float(rng.standard_normal()), float(rng.choice([0.0, 0.5, 1.0, -0.9]))
            value = shift + factor * value
            want[sid, i] = value
            rows.append((sid, i, shift, factor, x))
    df = spark.createDataFrame(rows, "sid string, idx long, shift double, factor double, x double").repartition(5)
    got = {(r.sid, r.idx): r.value for r in affine_scan(df, F.col("x"), block=block).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(got) == 550
    assert affine_scan(df.filter("false"), F.col("x")).count() == 0


def test_imputed_values_feed_the_next_gap(spark):
    from tallycast.operators.instances import impute_forward

    p = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 4.0, None, None, 8.0])], "sid string, idx long, y double")
    got = [r.filled for r in impute_forward(p, F.lit(2.0), 0.5, block=2).orderBy("idx").collect()]
    assert got == [1.0, 4.0, 3.0, 2.5, 8.0]

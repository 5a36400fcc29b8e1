import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.functions import distributions as D
from tallycast.functions import numeric as N
from tallycast.functions import timekeys as K


def column(spark, values, expression):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_lgamma(spark):
    xs = [1e-6, 0.01, 0.5, 1, 1.5, 2, 7, 33.3, 1e3, 1e4, 1e6]
    for x, got in zip(xs, column(spark, xs, N.lgamma)):
        assert got == pytest.approx(math.lgamma(x), abs=1e-8, rel=1e-12)


def test_normal_functions(spark):
    xs = np.linspace(-8, 8, 161)
    for x, got in zip(xs, column(spark, xs, N.norm_cdf)):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-14)
    ps = [1e-12, 1e-6, 0.001, 0.074, 0.076, 0.3, 0.5, 0.7, 0.925, 0.926, 0.999999]
    for p, got in zip(ps, column(spark, ps, N.norm_ppf)):
        assert got == pytest.approx(NormalDist().inv_cdf(p), abs=1e-9)
    back = column(spark, ps[1:], lambda c: N.norm_cdf(N.norm_ppf(c)))
    assert back == pytest.approx(ps[1:], rel=1e-9)


def test_small_functions(spark):
    xs = [-800.0, -1.0, 0.0, 2.0, 800.0]
    assert column(spark, xs, N.softplus) == pytest.approx([0.0, math.log1p(math.exp(-1)), math.log(2), math.log1p(math.exp(2)), 800.0])
    assert column(spark, xs[1:4], N.exp_linear) == pytest.approx([math.exp(-1), 1.0, 3.0])
    assert column(spark, [0.5, 1.5, 2.5, -0.5], N.half_even) == [0.0, 2.0, 2.0, 0.0]
    assert column(spark, [0.0], N.log_positive) == [None]
    assert column(spark, [0.0, 4.0], lambda c: N.safe_div(F.lit(2.0), c)) == [None, 0.5]


def test_nb_pmf_sums_to_one_and_matches_moments(spark):
    k = np.arange(0, 2000)
    p = np.exp(column(spark, k, lambda y: D.nb_logpmf(y, F.lit(12.5), F.lit(1.7))))
    assert p.sum() == pytest.approx(1.0, abs=1e-9)
    assert (k * p).sum() == pytest.approx(12.5, rel=1e-8)
    assert (k**2 * p).sum() - 12.5**2 == pytest.approx(12.5 + 12.5**2 / 1.7, rel=1e-7)


def test_nb_shape_rules(spark):
    rows = spark.createDataFrame([(4.0, 8.0), (4.0, 4.0), (4.0, 2.0), (4.0, 4.0000001), (0.0, 0.0)], "m double, v double")
    got = [r[0] for r in rows.select(D.nb_shape(F.col("m"), F.col("v"))).collect()]
    assert got[0] == 4.0 and got[1:3] == [None, None] and got[3] == pytest.approx(1.6e8, rel=1e-6) and got[4] is None


def test_large_shapes_are_not_capped(spark):
    """Mean 1e6 and variance 2e6 give r = 1e6; the density then has that variance."""
    k = np.arange(990_000, 1_010_001, dtype=float)
    p = np.exp(column(spark, k, lambda y: D.nb_logpmf(y, F.lit(1e6), D.nb_shape(F.lit(1e6), F.lit(2e6)))))
    assert p.sum() == pytest.approx(1.0, abs=1e-7)
    assert ((k - 1e6) ** 2 * p).sum() == pytest.approx(2e6, rel=1e-5)
    near = column(spark, [0.0, 3.0, 40.0], lambda y: D.nb_logpmf(y, F.lit(7.0), F.lit(1e13)))
    assert near == pytest.approx(column(spark, [0.0, 3.0, 40.0], lambda y: D.poisson_logpmf(y, F.lit(7.0))), abs=1e-9)
    both = [column(spark, [0.0, 5.0], lambda y, r=r: D.nb_logpmf(y, F.lit(3.0), F.lit(r))) for r in (9.999999999, 10.0)]
    assert both[0] == pytest.approx(both[1], abs=1e-8)


def test_hash_noise_is_uniform_and_normal(spark):
    df = spark.range(20000).select(N.hash_uniform("a", F.col("id")).alias("u"), N.hash_normal("b", F.col("id")).alias("z"))
    u, z = df.toPandas().to_numpy().T
    assert 0 < u.min() and u.max() < 1
    assert abs(u.mean() - 0.5) < 4 * math.sqrt(1 / 12 / 20000)
    assert abs(z.mean()) < 4 / math.sqrt(20000) and abs(z.std() - 1) < 0.03


def test_hour_24_is_midnight_of_the_same_day(spark):
    df = spark.createDataFrame([("2020-05-01", 24.0), ("2020-05-01", 0.5), ("2020-05-01", 23.5)], "d string, hr double")
    text = [r[0] for r in df.select(K.compose_text(F.col("d"), F.col("hr"))).collect()]
    assert text == ["2020-05-01 00:00", "2020-05-01 00:30", "2020-05-01 23:30"]
    ts = df.select(K.compose_timestamp(F.col("d"), F.col("hr")).alias("t"))
    assert [r[0] for r in ts.select(K.decimal_hour(F.col("t"))).collect()] == [24.0, 24.5, 23.5]


def test_default_lags():
    assert K.default_lags("H") == [1, 24, 168]
    assert K.default_lags("H", 2) == [1, 24]
    assert K.default_lags("Q") == [1]

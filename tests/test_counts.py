import math

import numpy as np
import pytest

from tallycast.functions import counts as C


def masses(mean, shape, top):
    k = np.arange(top)
    if shape is None:
        logs = k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])
    else:
        logs = np.array([math.lgamma(x + shape) - math.lgamma(shape) - math.lgamma(x + 1) for x in k]) + shape * math.log(shape / (shape + mean)) + k * math.log(mean / (shape + mean))
    return np.exp(logs)


@pytest.mark.parametrize("mean, shape", [(0.01, 0.05), (0.3, None), (2.5, 0.7), (30.0, 4.0), (30.0, None), (400.0, 1e6), (900.0, 0.3), (3000.0, 90.0)])
def test_distribution_function_and_quantiles_equal_summed_masses(mean, shape):
    sd = math.sqrt(mean * (1 + (mean / shape if shape else 0)))
    table = np.cumsum(masses(mean, shape, int(mean + 45 * sd + 60)))
    r = np.nan if shape is None else shape
    k = np.unique(np.rint(np.linspace(0, mean + 8 * sd, 200)))
    assert np.allclose(C.nb_below(k, mean, r), table[k.astype(int)], rtol=1e-8, atol=1e-11)
    u = np.concatenate((np.random.default_rng(1).uniform(size=400), [1e-12, 1e-6, 1 - 1e-6]))
    clear = np.abs(table[:, None] - u).min(0) > 1e-9
    assert clear.sum() > 300 and (C.nb_quantile(u, mean, r)[clear] == np.searchsorted(table, u)[clear]).all()


@pytest.mark.parametrize("mean, shape", [(1e6, 100.0), (1e6, 1.0), (1e6, np.nan), (1e9, 1e9)])
def test_large_means_without_a_table(mean, shape):
    u = np.random.default_rng(2).uniform(size=300)
    k = C.nb_quantile(u, mean, shape)
    assert (C.nb_below(k, mean, shape) >= u).all() and (C.nb_below(k - 1, mean, shape) < u).all()
    sd = math.sqrt(mean * (1 + (0 if np.isnan(shape) else mean / shape)))
    assert abs(k.mean() - mean) < 4 * sd / math.sqrt(300)
    # masses between two counts, added up one by one, against the difference of the distribution function
    j = np.arange(mean + 0.3 * sd // 1, mean + 0.3 * sd // 1 + 5000)
    assert np.isclose(np.exp(C.nb_log_mass(j, mean, shape)).sum(), C.nb_below(j[-1:], mean, shape)[0] - C.nb_below(j[:1] - 1, mean, shape)[0], rtol=1e-6)


def test_edges():
    assert C.nb_quantile(np.array([0.3, 0.9]), 0.0, np.array([1.0, np.nan])).tolist() == [0, 0]
    assert C.nb_below(np.array([-1.0, 0.0, 3.0]), np.array([2.0, 0.0, 0.0]), np.nan).tolist() == [0, 1, 1]
    assert C.nb_quantile(np.array([]), 1.0, 1.0).tolist() == []
    assert C.beta_binomial_quantile(np.array([0.5, 0.9]), np.array([0.0, 0.0]), 1.0, 2.0).tolist() == [0, 0]


@pytest.mark.parametrize("n, a, b", [(1, 0.001, 0.002), (7, 0.5, 3.0), (40, 1.0, 1.0), (300, 20.0, 4.0), (50, 1e12, 3e12)])
def test_beta_binomial_inversion(n, a, b, monkeypatch):
    u = np.random.default_rng(3).uniform(size=300)
    if a > 1e9:  # the binomial limit
        p = a / (a + b)
        mass = np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    else:
        beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
        mass = np.exp([math.log(math.comb(n, k)) + beta(k + a, n - k + b) - beta(a, b) for k in range(n + 1)])
    want = np.minimum(np.searchsorted(np.cumsum(mass), u), n)
    assert (C.beta_binomial_quantile(u, n, a, b) == want).all()
    monkeypatch.setattr(C, "CELLS", 16)
    assert (C.beta_binomial_quantile(u, n, a, b) == want).all()

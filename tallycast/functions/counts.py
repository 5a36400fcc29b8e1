"""Distribution functions of counts and their inverses on numpy arrays, without a table over the support."""

from __future__ import annotations

import numpy as np

from tallycast.functions import numeric as N

SHIFT = 16  # from which on Stirling's series is exact to double precision
TINY = 1e-300
CELLS = 1 << 18  # masses of one call; a longer distribution is passed in pieces


def stirling_error(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1) minus (n + 1/2) ln n - n + ln(2 pi) / 2, for n > 0."""
    n = np.asarray(n, float)
    m = np.where(n < SHIFT, n + SHIFT, n)
    inverse = 1.0 / (m * m)
    rest = np.zeros_like(m)
    for c in reversed(N.STIRLING):
        rest = rest * inverse + c
    rest = rest / m
    small = n < SHIFT
    if small.any():
        s, t = n[small], m[small]
        # ln Gamma(s + 1) = ln Gamma(t + 1) - ln((s + 1) ... (s + 16)), and both in Stirling's form
        product = np.log(s[..., None] + np.arange(1, SHIFT + 1)).sum(-1)
        rest[small] += (t + 0.5) * np.log(t) - t - product - ((s + 0.5) * np.log(s) - s)
    return rest


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x without cancellation where they are close (x > 0)."""
    part = (x - mean) / (x + mean)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = x * np.log(x / mean) + mean - x
    square, term, total = part * part, 2 * x * part, (x - mean) * part
    for j in range(1, 30):
        term = term * square
        total = total + term / (2 * j + 1)
    return np.where(np.abs(part) < 0.1, total, plain)


def nb_log_mass(k: np.ndarray, mean: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Log-mass of the negative binomial, Poisson where ``shape`` is not a number; ``mean`` > 0, whole k >= 0."""
    k, mean, shape = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, mean, shape)))
    plain = np.isnan(shape)
    some = np.maximum(k, 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        poisson = np.where(k > 0, -stirling_error(some) - deviance(some, mean) - 0.5 * np.log(2 * np.pi * some), -mean)
        r = np.where(plain, 1.0, shape)
        n = r + some
        p, q = r / (r + mean), mean / (r + mean)
        wide = stirling_error(n) - stirling_error(r) - stirling_error(some) - deviance(r, n * p) - deviance(some, n * q)
        wide = wide + 0.5 * np.log(r / n) - 0.5 * np.log(2 * np.pi * some)
        binomial = np.where(k > 0, wide, -r * np.log1p(mean / r))
    return np.where(plain, poisson, binomial)


def _fraction(numerator, first: np.ndarray, denominator) -> np.ndarray:
    """Continued fraction first + n1 / (d1 + n2 / (d2 + ...)) by Lentz' method, each element until it settles."""
    value = np.where(np.abs(first) < TINY, TINY, first)
    out = np.array(value)
    c, d = np.array(value), np.zeros_like(value)
    left = np.arange(len(out))
    step = 0
    while len(left):
        step += 1
        n, m = numerator(step, left), denominator(step, left)
        d[left] = m + n * d[left]
        d[left] = 1.0 / np.where(np.abs(d[left]) < TINY, TINY, d[left])
        c[left] = m + n / c[left]
        c[left] = np.where(np.abs(c[left]) < TINY, TINY, c[left])
        change = c[left] * d[left]
        out[left] *= change
        left = left[np.abs(change - 1.0) > 1e-15] if step < 10**6 else left[:0]
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, best below (a + 1) / (a + b + 2)."""

    def numerator(step: int, at: np.ndarray) -> np.ndarray:
        m, a1, b1, x1 = (step - 1) // 2, a[at], b[at], x[at]
        if step == 1:
            return np.ones(len(at))
        if step % 2:  # even terms of the classic numbering
            return m * (b1 - m) * x1 / ((a1 + 2 * m - 1) * (a1 + 2 * m))
        m = step // 2 - 1
        return -(a1 + m) * (a1 + b1 + m) * x1 / ((a1 + 2 * m) * (a1 + 2 * m + 1))

    return _fraction(numerator, np.zeros(len(a)), lambda step, at: np.ones(len(at)))


def nb_below(k: np.ndarray, mean: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """P(X <= k) of the negative binomial (Poisson where ``shape`` is not a number); 0 below 0, 1 for mean 0."""
    k, mean, shape = (np.array(v, float) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (k, mean, shape))))
    out = np.where(k < 0, 0.0, 1.0)
    some = np.flatnonzero((k >= 0) & (mean > 0) & np.isfinite(k))
    if not len(some):
        return out
    k, mean, shape = np.floor(k[some]), mean[some], shape[some]
    found = np.empty(len(some))
    plain = np.isnan(shape)
    if plain.any():
        found[plain] = _poisson_below(k[plain], mean[plain])
    if not plain.all():
        # the regularised incomplete beta function of (shape, k + 1) at shape / (shape + mean)
        k, mean, r = k[~plain], mean[~plain], shape[~plain]
        p, q, b = r / (r + mean), mean / (r + mean), k + 1
        front = np.exp(nb_log_mass(k, mean, r)) * q * (r + k)
        direct = p < (r + 1) / (r + b + 2)
        part = front * _beta_fraction(np.where(direct, r, b), np.where(direct, b, r), np.where(direct, p, q)) / np.where(direct, r, b)
        found[~plain] = np.where(direct, part, 1.0 - part)
    out[some] = np.clip(found, 0.0, 1.0)
    return out


def _poisson_below(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function of (k + 1, mean): a series on one side, a fraction on the other."""
    mass, out = np.exp(nb_log_mass(k, mean, np.nan)), np.empty(len(k))
    near = mean < k + 2
    if near.any():  # 1 - P(X > k), the masses above k as a falling series
        m, a = mean[near], k[near] + 1
        term = mass[near] * m / a
        total, left, step = np.array(term), np.arange(len(a)), 0
        while len(left):
            step += 1
            term[left] *= m[left] / (a[left] + step)
            total[left] += term[left]
            left = left[term[left] > total[left] * 1e-17]
        out[near] = 1.0 - total
    if not near.all():
        m, a = mean[~near], k[~near] + 1
        first = m + 1 - a
        whole = _fraction(lambda step, at: -step * (step - a[at]), first, lambda step, at: first[at] + 2 * step)
        out[~near] = mass[~near] * m / whole
    return out


def norm_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution function, by the same coefficients as the column function."""
    q = p - 0.5
    poly = lambda c, x: np.polyval(c[::-1], x)
    r = 0.180625 - q * q
    s = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    centre = q * poly(N.PPF_CENTRE_NUM, r) / poly(N.PPF_CENTRE_DEN, r)
    near = poly(N.PPF_NEAR_NUM, s - 1.6) / poly(N.PPF_NEAR_DEN, s - 1.6)
    far = poly(N.PPF_FAR_NUM, s - 5.0) / poly(N.PPF_FAR_DEN, s - 5.0)
    return np.where(np.abs(q) <= 0.425, centre, np.sign(q) * np.where(s <= 5.0, near, far))


def nb_quantile(u: np.ndarray, mean: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Least count with P(X <= count) >= u, for 0 < u < 1.

    From a Cornish-Fisher start the bracket grows until it holds the answer and shrinks by interpolation and halving
    in turn.  The work per number grows with the logarithm of the spread, its memory not at all.
    """
    u, mean, shape = (np.array(v, float) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (u, mean, shape))))
    out = np.zeros(len(u))
    some = np.flatnonzero(mean > 0)
    if not len(some):
        return out
    u, mean, shape = u[some], mean[some], shape[some]
    ratio = np.where(np.isnan(shape), 0.0, mean / np.where(np.isnan(shape), 1.0, shape))
    sd = np.sqrt(mean * (1 + ratio))
    z = norm_quantile(u)
    start = np.maximum(np.rint(mean + sd * (z + (1 + 2 * ratio) / sd * mean / sd * (z * z - 1) / 6)), 0.0)
    below = lambda k, at: nb_below(k, mean[at], shape[at])
    every = np.arange(len(u))
    value = below(start, every)
    low, high = np.where(value >= u, -1.0, start), np.where(value >= u, start, np.inf)
    f_low, f_high = np.where(value >= u, 0.0, value), np.where(value >= u, value, 1.0)
    step, left = np.maximum(1.0, np.rint(sd * 0.02)), every
    up = ~(value >= u)
    while len(left):  # the other end of the bracket
        k = np.where(up[left], low[left] + step[left], np.maximum(high[left] - step[left], -1.0))
        value = below(k, left)
        reached = value >= u[left]
        high[left], f_high[left] = np.where(reached, k, high[left]), np.where(reached, value, f_high[left])
        low[left], f_low[left] = np.where(reached, low[left], k), np.where(reached, f_low[left], value)
        step[left] *= 4
        left = left[reached != up[left]]
    turn, left = 0, np.flatnonzero(high - low > 1)
    while len(left):
        turn += 1
        a, b = low[left], high[left]
        share = (u[left] - f_low[left]) / np.maximum(f_high[left] - f_low[left], TINY) if turn % 2 else 0.5
        k = np.clip(np.ceil(a + share * (b - a)), a + 1, b - 1)
        value = below(k, left)
        reached = value >= u[left]
        high[left], f_high[left] = np.where(reached, k, b), np.where(reached, value, f_high[left])
        low[left], f_low[left] = np.where(reached, a, k), np.where(reached, f_low[left], value)
        left = left[high[left] - low[left] > 1]
    out[some] = high
    return out


def _log_ratios(j: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of mass(j) / mass(j - 1) of the beta-binomial; 0 for j = 0."""
    k = np.maximum(j, 1.0)
    ratio = (k - 1 + a) / np.where(j > 0, n - k + b, 1.0) * (np.where(j > 0, n - k + 1, 1.0) / k)
    return np.where(j > 0, np.log(ratio), 0.0)


def beta_binomial_quantile(u: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least count of n whose beta-binomial distribution function reaches u; ``a``, ``b`` > 0, n whole.

    Masses come from ratios of neighbours, so concentrations of any size lose nothing.  Time grows with n, memory
    does not: distributions are passed ``CELLS`` masses at a time.
    """
    u, n, a, b = (np.array(v, float) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (u, n, a, b))))
    out, at = np.zeros(len(u)), 0
    while at < len(u):
        if n[at] + 1 > CELLS:
            out[at] = _long_quantile(u[at], n[at], a[at], b[at])
            at += 1
            continue
        upto = at + max(1, int(np.searchsorted(np.cumsum(n[at:] + 1), CELLS, "right")))
        sizes = (n[at:upto] + 1).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        j = (np.arange(len(row)) - starts[row]).astype(float)
        logs = np.cumsum(_log_ratios(j, n[at:upto][row], a[at:upto][row], b[at:upto][row]))
        logs -= logs[starts][row]
        mass = np.exp(logs - np.maximum.reduceat(logs, starts)[row])
        upto_here = np.cumsum(mass)
        before = upto_here[starts] - mass[starts]
        total = upto_here[starts + sizes - 1] - before
        found = np.searchsorted(upto_here, before + u[at:upto] * total) - starts
        out[at:upto] = np.clip(found, 0, sizes - 1)
        at = upto
    return out


def _long_quantile(u: float, n: float, a: float, b: float) -> float:
    def blocks() -> tuple[float, np.ndarray]:
        log = 0.0
        for first in np.arange(0, n + 1, CELLS):
            j = np.arange(first, min(first + CELLS, n + 1))
            logs = log + np.cumsum(_log_ratios(j, n, a, b))
            log = logs[-1]
            yield first, logs

    top = max(logs.max() for _, logs in blocks())
    goal = u * sum(np.exp(logs - top).sum() for _, logs in blocks())
    for first, logs in blocks():
        mass = np.cumsum(np.exp(logs - top))
        if mass[-1] >= goal:
            return first + float(np.searchsorted(mass, goal))
        goal -= mass[-1]
    return n

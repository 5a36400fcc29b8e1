"""Log-densities and parameter rules of the supported families, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallycast.functions.numeric import lgamma, norm_cdf, stirling_rest

# Over-dispersion below this part of the mean is rounding of the moments: the Poisson limit.
LEAST_EXCESS = 1.0e-9
# From this shape on, differences of log-gammas are written out, so that they do not cancel.
WIDE_SHAPE = 10.0
# Support of a table: standard deviations around the mean, and geometric decay lengths above it.
SUPPORT_SD, SUPPORT_DECAY, SUPPORT_EXTRA = 12.0, 30.0, 30.0


def nb_shape(mean: Column, variance: Column) -> Column:
    """Moment estimate r = mean^2 / (var - mean); NULL, the Poisson limit, where the data are not over-dispersed."""
    excess = variance - mean
    return F.when(excess > mean * LEAST_EXCESS, mean * mean / excess)


def poisson_logpmf(y: Column, mean: Column) -> Column:
    """Mean 0 allows 0 only; other counts have no density (NULL)."""
    return F.when(mean > 0, y * F.log(mean) - mean - lgamma(y + 1.0)).when(y == 0, 0.0)


def nb_logpmf(y: Column, mean: Column, shape: Column) -> Column:
    """Negative binomial with mean ``mean`` and success probability shape / (shape + mean); Poisson where ``shape`` is NULL.

    For a large shape r, ln Gamma(y + r) - ln Gamma(r) and r ln(r / (r + mean)) nearly cancel; their Stirling forms
    are joined analytically instead, which holds for any r.
    """
    near = (
        lgamma(y + shape) - lgamma(y + 1.0) - lgamma(shape)
        + shape * F.log(shape / (shape + mean))
        + F.when(y > 0, y * F.log(mean / (shape + mean))).otherwise(0.0)
    )
    wide = (
        (shape - 0.5) * F.log1p(y / shape) - shape * F.log1p(mean / shape) - y + stirling_rest(y + shape) - stirling_rest(shape)
        - lgamma(y + 1.0) + y * F.log(mean * ((shape + y) / (shape + mean)))
    )
    return F.when(shape.isNull(), poisson_logpmf(y, mean)).when(shape >= WIDE_SHAPE, wide).otherwise(near)


def nb_support(mean: Column, shape: Column) -> tuple[Column, Column]:
    """Least and largest count of a table of the distribution: all but about 1e-12 of its mass lies between."""
    ratio = F.coalesce(mean / shape, F.lit(0.0))
    sd = F.sqrt(mean * (1.0 + ratio))
    low = F.greatest(F.floor(mean - SUPPORT_SD * sd - SUPPORT_EXTRA), F.lit(0).cast("bigint"))
    return low, F.ceil(mean + SUPPORT_SD * sd + SUPPORT_DECAY * (1.0 + ratio) + SUPPORT_EXTRA)


def log_rising(y: Column, a: Column) -> Column:
    """ln Gamma(a + y) - ln Gamma(a), joined analytically where both are large, so that no ``a`` makes it cancel."""
    wide = (a - 0.5) * F.log1p(y / a) + y * F.log(a + y) - y + stirling_rest(a + y) - stirling_rest(a)
    return F.when(a >= WIDE_SHAPE, wide).otherwise(lgamma(y + a) - lgamma(a))


def dm_item_term(y: Column, alpha: Column) -> Column:
    """Per-series term of the Dirichlet-multinomial log-likelihood; sum it over the series."""
    return log_rising(y, alpha) - lgamma(y + 1.0)


def dm_total_term(total: Column, alpha_total: Column) -> Column:
    """Once-per-step term of the Dirichlet-multinomial log-likelihood."""
    return lgamma(total + 1.0) - log_rising(total, alpha_total)


def gaussian_logpdf(y: Column, mean: Column, sd: Column) -> Column:
    z = (y - mean) / sd
    return -0.5 * z * z - F.log(sd) - F.lit(0.5 * math.log(2 * math.pi))


def gaussian_cdf(y: Column, mean: Column, sd: Column) -> Column:
    return norm_cdf((y - mean) / sd)


def gaussian_crps(y: Column, mean: Column, sd: Column) -> Column:
    """Continuous ranked probability score of a normal forecast; the absolute error for spread 0."""
    z = (y - mean) / sd
    score = sd * (z * (2.0 * norm_cdf(z) - 1.0) + 2.0 * F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) - 1.0 / math.sqrt(math.pi))
    return F.when(sd > 0, score).otherwise(F.abs(y - mean))

"""Numeric column functions that Spark does not ship: all built from codegen-able expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Published approximation coefficients.

# Stirling series of ln Gamma: coefficients of z^-1, z^-3, z^-5, z^-7, z^-9.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
STIRLING_SHIFT = 7

# Asymptotic series of the first and second derivative of ln Gamma behind their leading terms: coefficients of z^-2, z^-4, ... and of z^-3, z^-5, ...
DIGAMMA = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)
TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)

# Inverse normal distribution function, algorithm AS 241 (Wichura 1988): numerator and denominator
# for the centre, the near tail and the far tail, lowest power first.
PPF_CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
)
PPF_CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
)
PPF_NEAR_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
PPF_NEAR_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
PPF_FAR_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
PPF_FAR_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)

# Normal distribution function, Hart's rational approximation in West's form (2005), highest power first.
CDF_NUM = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DEN = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# ---------------------------------------------------------------------------------------------


def _poly(coefficients, x: Column) -> Column:
    """Horner evaluation, coefficients ordered from the highest power down."""
    value = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        value = value * x + F.lit(float(c))
    return value


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (numpy's NaN)."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def half_even(x: Column, digits: int = 0) -> Column:
    """Banker's rounding, as numpy rounds."""
    return F.rint(x) if digits == 0 else F.bround(x, digits)


def softplus(x: Column) -> Column:
    """ln(1 + e^x), written so that large x cannot overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def exp_linear(x: Column) -> Column:
    """x + 1 for x >= 0, e^x below: positive and continuous, used for concentration parameters."""
    return F.when(x >= 0, x + 1.0).otherwise(F.exp(x))


def log_positive(x: Column) -> Column:
    """ln x, NULL at zero; the log-scale static feature."""
    return F.log(F.when(x > 0, x))


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0 by a shifted Stirling series; absolute error below 1e-10 up to 1e6."""
    z = x + float(STIRLING_SHIFT)
    product = x
    for i in range(1, STIRLING_SHIFT):
        product = product * (x + float(i))
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + stirling_rest(z) - F.log(product)


def stirling_rest(z: Column) -> Column:
    """ln Gamma(z) minus (z - 1/2) ln z - z + ln(2 pi) / 2, for z >= 7."""
    return _poly(tuple(reversed(STIRLING)), 1.0 / (z * z)) * (1.0 / z)


def digamma(x: Column) -> Column:
    """Derivative of ln Gamma(x) for x > 0; absolute error below 1e-9."""
    z = x + float(STIRLING_SHIFT)
    inverse = 1.0 / (z * z)
    value = F.log(z) - 0.5 / z - _poly(tuple(reversed(DIGAMMA)), inverse) * inverse
    for i in range(STIRLING_SHIFT):
        value = value - 1.0 / (x + float(i))
    return value


def trigamma(x: Column) -> Column:
    """Second derivative of ln Gamma(x) for x > 0; absolute error below 1e-9."""
    z = x + float(STIRLING_SHIFT)
    inverse = 1.0 / (z * z)
    value = 1.0 / z + 0.5 * inverse + _poly(tuple(reversed(TRIGAMMA)), inverse) * inverse / z
    for i in range(STIRLING_SHIFT):
        value = value + 1.0 / ((x + float(i)) * (x + float(i)))
    return value


def digamma_rise(y: Column, a: Column) -> Column:
    """digamma(a + y) - digamma(a), from differences of the series' terms where ``a`` is large, so that nothing cancels."""
    b = a + y
    wide = F.log1p(y / a) + y / (a * b) * (0.5 + (a + b) / (a * b) * (1 / 12 - (1.0 / (a * a) + 1.0 / (b * b)) / 120))
    return F.when(a >= 20.0, wide).otherwise(digamma(b) - digamma(a))


def trigamma_rise(y: Column, a: Column) -> Column:
    """trigamma(a + y) - trigamma(a), written like :func:`digamma_rise`; at most 0."""
    b = a + y
    cubes = 1.0 / (a * a) + 1.0 / (a * b) + 1.0 / (b * b)
    wide = -(y / (a * b)) * (1.0 + 0.5 * (1.0 / a + 1.0 / b) + cubes / 6)
    return F.when(a >= 1000.0, wide).otherwise(trigamma(b) - trigamma(a))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, about 1e-15 accurate."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    body = density * _poly(CDF_NUM, a) / _poly(CDF_DEN, a)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    tail = F.when(a > 37.0, 0.0).when(a < 7.07106781186547, body).otherwise(density / fraction / 2.506628274631)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * _poly(PPF_CENTRE_NUM[::-1], r) / _poly(PPF_CENTRE_DEN[::-1], r)
    s = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    near = _poly(PPF_NEAR_NUM[::-1], s - 1.6) / _poly(PPF_NEAR_DEN[::-1], s - 1.6)
    far = _poly(PPF_FAR_NUM[::-1], s - 5.0) / _poly(PPF_FAR_DEN[::-1], s - 5.0)
    tail = F.when(s <= 5.0, near).otherwise(far)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * tail)


def hash_uniform(seed: str, *keys: Column) -> Column:
    """A uniform in (0, 1) that depends only on the seed and the keys.

    Reruns, lost executors and other engines see the same number: 52 bits of an MD5 over the key text.
    Keys must be integers or strings, whose text form is the same everywhere.
    """
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def hash_normal(seed: str, *keys: Column) -> Column:
    """A standard normal keyed like :func:`hash_uniform` (inverse transform)."""
    # bound once: the formula mentions its argument many times, and lambdas do not share subexpressions
    return F.transform(F.array(hash_uniform(seed, *keys)), norm_ppf)[0]

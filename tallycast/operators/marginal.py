"""Empirical copula transform of each series' recent values, and its inverse."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.numeric import norm_cdf, norm_ppf
from tallycast.operators.panel import tail


def clip_margin(n: int) -> float:
    """Truncation 1 / (4 n^(1/4) sqrt(pi ln n)) of the empirical distribution function."""
    return 1.0 / (4.0 * n**0.25 * math.sqrt(math.pi * math.log(n))) if n > 1 else 0.5


def sorted_recent(panel: DataFrame, length: int, last: Column | int | None = None) -> DataFrame:
    """``(sid, recent)``: the last ``length`` values of each series, sorted; the array is that long at most."""
    recent = tail(panel, length, last=last).filter(F.col("y").isNotNull())
    return recent.groupBy("sid").agg(F.array_sort(F.collect_list("y")).alias("recent"))


def _first_above(recent: Column, y: Column) -> Column:
    """How many sorted values are <= y."""
    return F.size(F.filter(recent, lambda v: v <= y))


def to_gaussian(df: DataFrame, recent: DataFrame, length: int, value: str = "y", out: str = "z") -> DataFrame:
    """Phi^-1 of the clipped empirical distribution function of the recent values, for any value of the series."""
    margin = clip_margin(length)
    share = _first_above(F.col("recent"), F.col(value)) / F.size("recent")
    clipped = F.least(F.greatest(share, F.lit(margin)), F.lit(1.0 - margin))
    return df.join(recent, "sid").withColumn(out, norm_ppf(clipped)).drop("recent")


def window_gaussian(panel: DataFrame, length: int, last: Column | int | None = None) -> DataFrame:
    """:func:`to_gaussian` of the recent window itself; ranks come from one window per series tail."""
    margin = clip_margin(length)
    share = F.cume_dist().over(Window.partitionBy("sid").orderBy("y"))
    clipped = F.least(F.greatest(share, F.lit(margin)), F.lit(1.0 - margin))
    return tail(panel, length, last=last).withColumn("z", norm_ppf(clipped))


def empirical_quantile(recent: Column, z: Column) -> Column:
    """Quantile of Phi(z): the smallest recent value whose distribution function reaches it."""
    n = F.size(recent)
    rank = F.ceil(F.round(norm_cdf(z) * n, 9)).cast("int")
    return F.element_at(recent, F.least(F.greatest(rank, F.lit(1)), n))


def from_gaussian(df: DataFrame, recent: DataFrame, value: str = "z", out: str = "y") -> DataFrame:
    """:func:`empirical_quantile` of each row's value in its own series."""
    return df.join(recent, "sid").withColumn(out, empirical_quantile(F.col("recent"), F.col(value))).drop("recent")

"""Accuracy of sample forecasts.

Quantiles are nearest-rank: the sorted sample at position rint((S - 1) q).  A forecast row carries its samples, so
per-row losses are narrow; sums over series, origins and levels are one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Evaluation levels 1/20 .. 19/20.
LEVELS = tuple(k / 20 for k in range(1, 20))
KEPT = ("CRPS", "MSE", "CRPS-Sum", "MSE-Sum")


def rank_position(size: Column, level: float) -> Column:
    return (F.rint((size - 1).cast("double") * F.lit(level)) + 1).cast("int")


def quantile(ordered: Column, level: float) -> Column:
    """Nearest-rank quantile of an already sorted sample array."""
    return F.element_at(ordered, rank_position(F.size(ordered), level))


def mean_of(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, v: a + v) / F.size(samples)


def level_name(level: float) -> str:
    return f"{level:.2f}".replace("0.", "q")


def _rank_sql(level: float) -> str:
    """:func:`quantile` of the sorted array ``_o`` as SQL text.

    The many per-level columns of this module are written as text: one parsed expression each instead of a
    dozen column calls.
    """
    return f"element_at(_o, cast(rint((size(_o) - 1) * {level!r}D) AS int) + 1)"


def scored_rows(forecast: DataFrame, levels: Sequence[float] = LEVELS, alpha: float = 0.05) -> DataFrame:
    """Per forecast value: mean, median, interval ends, and the quantile, loss and coverage of every level."""
    base = forecast.withColumn("_o", F.array_sort("samples")).selectExpr(
        "*",
        "aggregate(samples, 0D, (a, v) -> a + v) / size(samples) AS mean",
        f"{_rank_sql(0.5)} AS median", f"{_rank_sql(alpha / 2)} AS lower", f"{_rank_sql(1 - alpha / 2)} AS upper",
        *[f"{_rank_sql(q)} AS {level_name(q)}" for q in levels],
    )
    losses = []
    for q in levels:
        n = level_name(q)
        losses.append(f"2D * abs(({n} - y) * (CASE WHEN y <= {n} THEN 1D ELSE 0D END - {q!r}D)) AS ql_{n}")
        losses.append(f"CASE WHEN y < {n} THEN 1D ELSE 0D END AS cov_{n}")
    return base.selectExpr("*", *losses).drop("_o", "samples")


def item_metrics(
    scored: DataFrame, seasonal: DataFrame | None = None, levels: Sequence[float] = LEVELS, alpha: float = 0.05,
    keys: Sequence[str] = ("sid", "roll"),
) -> DataFrame:
    """One row per series and window."""
    names = [level_name(q) for q in levels]
    penalty = f"{2 / alpha!r}D"
    width = f"upper - lower + {penalty} * greatest(lower - y, 0D) + {penalty} * greatest(y - upper, 0D)"
    aggregates = [
        "avg((y - mean) * (y - mean)) AS MSE", "sum(abs(y - median)) AS abs_error", "sum(abs(y)) AS abs_target_sum",
        "avg(abs(y)) AS abs_target_mean", "avg(abs(y - median) / nullif(abs(y), 0D)) AS MAPE",
        "2D * avg(abs(y - median) / nullif(abs(y) + abs(median), 0D)) AS sMAPE", "avg(abs(y - median)) AS _mae",
        f"avg({width}) AS _width", "sum(abs(y - median)) / nullif(sum(abs(y)), 0D) AS ND",
        *[f"sum(ql_{n}) AS ql_{n}" for n in names], *[f"avg(cov_{n}) AS cov_{n}" for n in names],
    ]
    items = scored.groupBy(*keys).agg(*map(F.expr, aggregates))
    if seasonal is None:
        return items.drop("_mae", "_width")
    return items.join(seasonal, list(keys), "left").selectExpr(
        *[c for c in items.columns if c not in ("_mae", "_width")], "seasonal_error",
        "_mae / nullif(seasonal_error, 0D) AS MASE", "_width / nullif(seasonal_error, 0D) AS MSIS",
    )


def aggregate_metrics(items: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics over all items (or per ``keys``): losses pooled, errors averaged."""
    names = [level_name(q) for q in levels]
    extra = [c for c in ("seasonal_error", "MASE", "MSIS") if c in items.columns]
    averaged = ["MSE", "abs_target_mean", "MAPE", "sMAPE", *extra, *[f"cov_{n}" for n in names]]
    pooled = ["abs_error", "abs_target_sum", *[f"ql_{n}" for n in names]]
    sums = items.groupBy(*keys).agg(
        *[F.expr(f"avg({c}) AS {c}") for c in averaged], *[F.expr(f"sum({c}) AS {c}") for c in pooled]
    )
    loss = " + ".join(f"ql_{n}" for n in names)
    spread = " + ".join(f"abs(cov_{n} - {q!r}D)" for n, q in zip(names, levels))
    return sums.selectExpr(
        *keys, "MSE", "abs_error", "abs_target_sum", "abs_target_mean", "MAPE", "sMAPE", *extra,
        "sqrt(MSE) AS RMSE", "sqrt(MSE) / nullif(abs_target_mean, 0D) AS NRMSE", "abs_error / nullif(abs_target_sum, 0D) AS ND",
        f"({loss}) / nullif(abs_target_sum, 0D) / {float(len(names))}D AS CRPS",
        f"({loss}) / {float(len(names))}D AS mean_absolute_QuantileLoss", f"({spread}) / {float(len(names))}D AS MAE_Coverage",
        *[f"ql_{n} / nullif(abs_target_sum, 0D) AS wql_{n}" for n in names], *[f"cov_{n}" for n in names],
    )


def sum_over_series(forecast: DataFrame) -> DataFrame:
    """Forecast of the cross-series sum: samples added by sample position, targets added.

    The additions are keyed by (roll, h, sample), combined map-side; the arrays rebuilt afterwards are one
    sample set long.
    """
    # positions count from the oldest drawn path, every series of a step has the same number of them
    long = forecast.select("roll", "origin", "h", "ts", "y", F.posexplode("samples").alias("p", "v"))
    added = long.groupBy("roll", "origin", "h", "ts", "p").agg(F.sum("v").alias("v"), F.sum("y").alias("y"))
    return added.groupBy("roll", "origin", "h", "ts").agg(
        F.max("y").alias("y"),
        F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("samples"),
    )


def metrics_long(metrics: DataFrame, keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """``(keys, metrics, values)``."""
    names = list(names) if names is not None else [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, *names).unpivot(list(keys), names, "metrics", "values")


def headline(per_series: DataFrame, summed: DataFrame) -> DataFrame:
    """The four reported numbers: CRPS and MSE per series and for the sum."""
    a = per_series.select("CRPS", "MSE").unpivot([], ["CRPS", "MSE"], "metrics", "values")
    b = summed.select(F.col("CRPS").alias("CRPS-Sum"), F.col("MSE").alias("MSE-Sum")).unpivot(
        [], ["CRPS-Sum", "MSE-Sum"], "metrics", "values"
    )
    return a.unionByName(b)


def bands(forecast: DataFrame, levels: Sequence[float] = (0.05, 0.5, 0.95), keys=("sid", "roll", "h", "ts")) -> DataFrame:
    """Quantile columns per forecast value: the table behind an interval plot."""
    ordered = forecast.withColumn("_o", F.array_sort("samples"))
    return ordered.select(*keys, "y", *[quantile(F.col("_o"), q).alias(f"p{round(q * 100):02d}") for q in levels])


def interval_levels(intervals: Sequence[float]) -> list[float]:
    """Central intervals in percent to sorted distinct quantile levels, the median always included."""
    ends = {50.0} | {50.0 + sign * c / 2.0 for c in intervals for sign in (-1.0, 1.0)}
    return [p / 100.0 for p in sorted(ends)]


def mean_wide(forecast: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Mean forecast, horizon rows x series columns, per window."""
    return forecast.withColumn("mean", mean_of(F.col("samples"))).groupBy("roll", "h").pivot("sid", list(levels)).agg(F.first("mean"))

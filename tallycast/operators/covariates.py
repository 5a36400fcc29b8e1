"""Event, works, weather and service covariates, and the weights taken from them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import safe_div
from tallycast.operators.panel import MAX_PIVOT_COLUMNS, level_list


class WeightProfile(NamedTuple):
    """Weights of concerts, other events and service excess."""

    concert: float
    event: float
    service: float


# The two published weight settings.
WEIGHT_PROFILES = {
    "forts": WeightProfile(20000, 10000, 100),
    "faibles": WeightProfile(2000, 1000, 10),
}


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], columns: Sequence[str], fill=None) -> DataFrame:
    """Left equi-join of a side table; missing values become ``fill`` when it is given.

    No hint: Spark broadcasts the side while its measured size is under the session's threshold and
    sort-merges it otherwise.
    """
    out = df.join(side.select(*keys, *columns), list(keys), "left")
    if fill is not None:
        out = out.select(
            *[c for c in out.columns if c not in columns],
            *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in columns],
        )
    return out


def zero_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(0))


def present(column: Column) -> Column:
    return column.isNotNull().cast("int")


def constant_weight(column: Column, weight: float) -> Column:
    """``weight`` where the indicator is set, else 0."""
    return F.when(F.coalesce(column, F.lit(0)) != 0, F.lit(float(weight))).otherwise(0.0)


def excess_weight(column: Column, weight: float) -> Column:
    """(level - 1) x weight: how far a service level is from normal."""
    return (column - 1.0) * float(weight)


def override_in_periods(
    day: Column, value: Column, days: Sequence[str], ranges: Sequence[tuple[str, str]], by: float = 1.0
) -> Column:
    """``by`` on listed days and inside closed day ranges (ISO text), the value elsewhere."""
    hit = day.isin(*days) if days else F.lit(False)
    for first, last in ranges:
        hit = hit | day.between(first, last)
    return F.when(hit, F.lit(by)).otherwise(value)


def branch_mask(works: DataFrame, zone_branch: DataFrame) -> DataFrame:
    """``(date, hr, branch)`` under works: each zone closes one or more branches."""
    return works.select("date", "hr", "zone").join(zone_branch, "zone", "left").select("date", "hr", "branch").distinct()


def masked_service(service: DataFrame, mask: DataFrame) -> DataFrame:
    """Service level per (date, hr, branch): 1 under works, else the largest reported level.

    The reported levels are reduced before the mask joins, so the join never sees duplicates of a key.
    """
    level = service.groupBy("date", "hr", "branch").agg(F.max("value").alias("value"))
    marked = level.join(mask.withColumn("_works", F.lit(1)), ["date", "hr", "branch"], "left")
    return marked.select("date", "hr", "branch", F.when(F.col("_works") == 1, 1.0).otherwise(F.col("value")).alias("value"))


def pivot_mean(df: DataFrame, keys: Sequence[str], column: str, value: str, levels: Sequence | None = None) -> DataFrame:
    """One column per level holding the mean; absent cells stay NULL."""
    levels = list(levels) if levels is not None else level_list(df, column)
    return df.groupBy(*keys).pivot(column, levels).agg(F.avg(value))


def onehot(df: DataFrame, columns: Sequence[str], levels: dict[str, Sequence] | None = None) -> DataFrame:
    """0/1 columns ``<column>_<level>`` for all levels but the smallest; the source columns go.

    Undeclared levels of all columns are found in one pass: distinct values combine map-side, as (column, value)
    pairs, and are bounded like those of a pivot.
    """
    levels = dict(levels or {})
    missing = [c for c in columns if c not in levels]
    if missing:
        one = F.array(*[
            F.struct(F.lit(c).alias("c"), F.struct(*[(F.col(x) if x == c else F.lit(None).cast(df.schema[x].dataType)).alias(x) for x in missing]).alias("v"))
            for c in missing
        ])
        found = df.select(F.inline(one)).distinct().limit(MAX_PIVOT_COLUMNS + 1).collect()
        if len(found) > MAX_PIVOT_COLUMNS:
            raise ValueError(f"{', '.join(missing)} have more than {MAX_PIVOT_COLUMNS} levels; declare them or keep the frame long")
        levels |= {c: [r["v"][c] for r in found if r["c"] == c and r["v"][c] is not None] for c in missing}
    flags = [
        F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}".replace(".", "_"))
        for c in columns
        for v in sorted(levels[c])[1:]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *flags)


def max_normalise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide each column by its own maximum over the frame; NULL where that maximum is 0."""
    tops = df.agg(F.struct(*[F.max(c).alias(c) for c in columns]).alias("m")).scalar()
    out = df.withColumn("_top", tops)
    return out.select(
        *[c for c in df.columns if c not in columns],
        *[safe_div(F.col(c).cast("double"), F.col(f"_top.{c}").cast("double")).alias(c) for c in columns],
    )


def inverse_frequency(df: DataFrame, columns: Sequence[str], prefix: str = "w_") -> DataFrame:
    """Weight 1 / share-of-non-zero-rows on the rows where the indicator is set, else 0."""
    share = df.agg(F.struct(*[F.avg((F.col(c) != 0).cast("double")).alias(c) for c in columns]).alias("m")).scalar()
    out = df.withColumn("_share", share)
    return out.select(
        *df.columns,
        *[
            F.when(F.col(c) != 0, 1.0 / F.nullif(F.col(f"_share.{c}"), F.lit(0.0))).otherwise(0.0).alias(f"{prefix}{c}")
            for c in columns
        ],
    )


def stack(columns: Sequence[str], out: str = "features") -> Column:
    """Covariates of one step as a vector, in the given order."""
    return F.array(*[F.col(c).cast("double") for c in columns]).alias(out)


def replicate_over_series(panel: DataFrame, covariates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each series sees the covariates of its step.  Covariates follow the target: their extra steps fall away, and a
    step without covariates keeps its target, with NULLs."""
    return panel.join(covariates.select("ts", *columns), "ts", "left")

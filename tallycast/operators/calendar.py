"""Calendar covariates: day flags, weekday one-hots, Fourier positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.timekeys import (
    DATE_ATTRIBUTES,
    date_attribute,
    day_key,
    day_position,
    decimal_hour,
    fourier,
    is_weekend,
)


def time_keys(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Join keys: ``date`` text, decimal hour ``hr``, integer hour ``hrr``."""
    return df.select("*", day_key(F.col(ts)).alias("date"), decimal_hour(F.col(ts)).alias("hr"), F.hour(ts).alias("hrr"))


def school_breaks(calendar: DataFrame, zone: str, excluded_population: str, first_year: int) -> DataFrame:
    """Holiday intervals of one zone, without the rows meant for one population, from a school year on."""
    return calendar.filter(
        (F.col("zone") == zone)
        & (F.col("population") != excluded_population)
        & (F.substring("school_year", 1, 4).cast("int") >= first_year)
    )


def expand_days(intervals: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """Every day of every closed interval, once per interval.  Reversed intervals give no day."""
    valid = intervals.filter(F.col(start) <= F.col(end))
    return valid.withColumn(day, F.explode(F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY"))))


def flag_days(df: DataFrame, days: DataFrame, day: str, flag: str) -> DataFrame:
    """Add ``flag`` = 1 on the listed days, else 0.  Overlapping intervals cannot duplicate rows."""
    marks = days.select(day).distinct().withColumn("_hit", F.lit(1))
    return df.join(marks, day, "left").withColumn(flag, F.col("_hit").isNotNull().cast("int")).drop("_hit")


def weekday_onehot(ts: Column) -> list[Column]:
    """Seven columns, Monday first."""
    return [(F.weekday(ts) == k).cast("int").alias(f"wd{k}") for k in range(7)]


def weekend(ts: Column) -> Column:
    return is_weekend(ts).alias("weekend")


def annual_fourier(ts: Column, period: float = 365.0) -> list[Column]:
    return fourier(F.dayofyear(ts).cast("double"), period, "year")


def daily_fourier(ts: Column, period: float = 48.0) -> list[Column]:
    return fourier(day_position(ts), period, "day")


def fourier_date_attributes(df: DataFrame, freq: str, ts: str = "ts") -> DataFrame:
    """cos and sin of 2 pi v / (max v + 1) for each attribute of the frequency.

    The maximum runs over the frame's own index; one aggregate feeds all attributes.
    """
    if freq not in DATE_ATTRIBUTES:
        raise ValueError(f"frequency {freq} not supported")
    names = DATE_ATTRIBUTES[freq]
    column = F.col(ts)
    tops = df.agg(F.struct(*[F.max(date_attribute(n, column)).alias(n) for n in names]).alias("m")).scalar()
    out = df.withColumn("_top", tops)
    for n in names:
        angle = date_attribute(n, column) * F.lit(2.0 * math.pi) / (F.col(f"_top.{n}") + 1)
        out = out.withColumn(f"{n}_cos", F.cos(angle)).withColumn(f"{n}_sin", F.sin(angle))
    return out.drop("_top")

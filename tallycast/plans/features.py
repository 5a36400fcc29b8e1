"""From raw side tables to the covariate table, the weight table and the rolled weight of every step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.operators.calendar import (
    annual_fourier, daily_fourier, expand_days, flag_days, time_keys, weekday_onehot,
)
from tallycast.operators.covariates import (
    WEIGHT_PROFILES, attach, branch_mask, constant_weight, excess_weight, inverse_frequency, masked_service,
    max_normalise, onehot, override_in_periods, pivot_mean,
)
from tallycast.operators.weights import rolling_past_weight

CALENDAR = (
    [f"year_{f}{k}" for f in ("sin", "cos") for k in range(1, 5)]
    + [f"day_{f}{k}" for f in ("sin", "cos") for k in range(1, 5)]
    + [f"wd{k}" for k in range(7)]
)


def calendar_columns(times: DataFrame, annual_period: float = 365, day_period: float = 48) -> DataFrame:
    """Steps ``(ts, idx)`` with annual and daily Fourier positions and weekday one-hots."""
    ts = F.col("ts")
    return times.select("ts", "idx", *annual_fourier(ts, annual_period), *daily_fourier(ts, day_period), *weekday_onehot(ts))


def city_features(times: DataFrame, weather: DataFrame, annual_period: float = 365, day_period: float = 48) -> DataFrame:
    """Calendar and hourly weather, with the weather's size as weights.

    ``weather``: ``(date, hrr, temp, precip)``.  Adds ``w_temp`` and ``w_precip``; the covariates themselves
    are divided by their maximum.
    """
    keyed = time_keys(calendar_columns(times, annual_period, day_period))
    joined = attach(keyed, weather, ["date", "hrr"], ["temp", "precip"], fill=0.0)
    weighted = joined.withColumns({"w_temp": F.abs("temp"), "w_precip": F.abs("precip")})
    return max_normalise(weighted.drop("date", "hr", "hrr"), ["temp", "precip"])


@dataclass(frozen=True)
class StationInputs:
    """Side tables of the half-hourly station data; keys are ``(date, hr)`` unless noted."""

    breaks: DataFrame  # date_from, date_to
    public_days: DataFrame  # day
    arena: DataFrame  # counters
    works: DataFrame  # zone
    zone_branch: DataFrame  # zone, branch
    service: DataFrame  # branch, value
    weather: DataFrame  # temperature, precipitations3h
    counters: Sequence[str] | dict[str, Sequence[int]]  # counter columns; levels are taken from the data where none are declared
    zones: Sequence[str] = ()
    branches: Sequence[str] = ()
    service_levels: Sequence[float] | None = ()  # None: taken from the data; empty: service stays a number
    off_days: Sequence[str] = ()
    off_ranges: Sequence[tuple[str, str]] = ()
    concerts: Sequence[str] = field(default_factory=tuple)  # the counters that weigh as concerts


def station_features(times: DataFrame, inputs: StationInputs, profile: str = "forts") -> DataFrame:
    """All covariates of the station data with their weights ``w_*``.

    Counters become indicator columns of all their levels but the smallest, and so do service levels per branch when
    they are declared or to be taken from the data; their weights come from the numbers either way.
    """
    weights = WEIGHT_PROFILES[profile]
    i = inputs
    counters = list(i.counters)
    out = time_keys(calendar_columns(times)).withColumn("day", F.to_date("ts"))
    out = flag_days(out, expand_days(i.breaks, "date_from", "date_to"), "day", "hol")
    out = flag_days(out, i.public_days, "day", "fer")
    out = attach(out, i.arena, ["date", "hr"], counters, fill=0)
    for c in counters:
        out = out.withColumn(f"w_{c}", constant_weight(F.col(c), weights.concert if c in i.concerts else weights.event))
    out = onehot(out, counters, i.counters if isinstance(i.counters, dict) else None)
    by_zone = pivot_mean(i.works.withColumn("value", F.lit(1)), ["date", "hr"], "zone", "value", i.zones)
    out = inverse_frequency(attach(out, by_zone, ["date", "hr"], list(i.zones), fill=0.0), list(i.zones))
    weather = ["temperature", "precipitations3h"]
    out = attach(out, i.weather, ["date", "hr"], weather, fill=0.0)
    out = max_normalise(out.withColumns({f"w_{c}": F.abs(c) for c in weather}), weather)
    normal = override_in_periods(F.col("date"), F.col("value"), i.off_days, i.off_ranges)
    level = masked_service(
        i.service.withColumn("hr", F.bround("hr", 1)).withColumn("value", normal), branch_mask(i.works, i.zone_branch)
    )
    by_branch = pivot_mean(level, ["date", "hr"], "branch", "value", i.branches)
    out = attach(out, by_branch, ["date", "hr"], list(i.branches), fill=1.0)
    out = out.withColumns({f"w_{b}": excess_weight(F.col(b), weights.service) for b in i.branches})
    if i.service_levels is None:
        out = onehot(out, list(i.branches))
    elif i.service_levels:
        out = onehot(out, list(i.branches), {b: i.service_levels for b in i.branches})
    return out.drop("date", "hr", "hrr", "day")


def weight_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c.startswith("w_")]


def rolled_weight(features: DataFrame, length: int) -> DataFrame:
    """``(ts, idx, weight)``: past-window weight of every step over all weight columns."""
    return rolling_past_weight(features, weight_columns(features), length).select("ts", "idx", "weight")

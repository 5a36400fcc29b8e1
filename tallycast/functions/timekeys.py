"""Keys and positions derived from a (zone-less) timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_key(hour: Column) -> Column:
    """Midnight belongs to the end of the day: hour 0 is written 24."""
    return F.when(hour == 0, 24).otherwise(hour)


def decimal_hour(ts: Column) -> Column:
    """Hour of day with the minutes as a fraction, one digit, in (0.., 24.x]."""
    return F.bround(hour_key(F.hour(ts)).cast("double") + F.minute(ts) / 60.0, 1)


def day_key(ts: Column) -> Column:
    """ISO day text, the first ten characters of the timestamp."""
    return F.substring(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), 1, 10)


def compose_text(day: Column, hr: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` from a day text and a decimal hour; hour 24 is 00 of the same day."""
    whole = hr.cast("int")
    minutes = F.rint((hr - whole) * 60.0).cast("int")
    hh = F.lpad(F.when(whole == 24, 0).otherwise(whole).cast("string"), 2, "0")
    mm = F.lpad(minutes.cast("string"), 2, "0")
    return F.concat(day, F.lit(" "), hh, F.lit(":"), mm)


def compose_timestamp(day: Column, hr: Column) -> Column:
    return F.to_timestamp_ntz(compose_text(day, hr), F.lit("yyyy-MM-dd HH:mm"))


def day_position(ts: Column) -> Column:
    """Half-hour position in the day, 1 .. 48 with midnight last."""
    return (hour_key(F.hour(ts)).cast("double") + F.minute(ts) / 60.0) * 2.0 - 1.0


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def fourier(x: Column, period: float, prefix: str, harmonics: int = 4) -> list[Column]:
    """sin of the harmonics, then cos, as ``<prefix>_sin1 .. <prefix>_cosK``."""
    angle = [F.lit(2.0 * k * math.pi) * x / float(period) for k in range(1, harmonics + 1)]
    sines = [F.sin(a).alias(f"{prefix}_sin{k}") for k, a in enumerate(angle, 1)]
    cosines = [F.cos(a).alias(f"{prefix}_cos{k}") for k, a in enumerate(angle, 1)]
    return sines + cosines


# Calendar attributes by sampling frequency, and default lags by frequency.
DATE_ATTRIBUTES = {
    "M": ("weekofyear",),
    "W": ("daysinmonth", "weekofyear"),
    "D": ("dayofweek",),
    "B": ("dayofweek", "dayofyear"),
    "H": ("hour", "dayofweek"),
    "min": ("minute", "hour", "dayofweek"),
    "T": ("minute", "hour", "dayofweek"),
}
DEFAULT_LAGS = {
    "M": (1, 12),
    "D": (1, 7, 14),
    "B": (1, 2),
    "H": (1, 24, 168),
    "min": (1, 4, 12, 24, 48),
    "T": (1, 4, 12, 24, 48),
}


def default_lags(freq: str, count: int | None = None) -> list[int]:
    return list(DEFAULT_LAGS.get(freq, (1,)))[:count]


def date_attribute(name: str, ts: Column) -> Column:
    """Calendar attribute with Monday = 0 for the weekday spellings."""
    return {
        "month": F.month,
        "day": F.dayofmonth,
        "hour": F.hour,
        "minute": F.minute,
        "weekofyear": F.weekofyear,
        "weekday": F.weekday,
        "dayofweek": F.weekday,
        "dayofyear": F.dayofyear,
        "daysinmonth": lambda c: F.dayofmonth(F.last_day(c)),
    }[name](ts)

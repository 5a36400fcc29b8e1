"""Rolling-origin windows by index arithmetic: no join between origins and rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.operators.blocks import framed
from tallycast.operators.panel import last_index


@dataclass(frozen=True)
class Rolling:
    """Expanding windows cut back from the end of the test span.

    Window w ends ``w * step`` rows before the last row; it is kept while the test span left of that end
    holds a whole horizon, and at most ``windows`` are kept.  The last ``horizon`` rows are forecast.
    """

    horizon: int = 96
    step: int = 96
    windows: int = 6
    test_start: int = 0


def assign_origins(
    df: DataFrame, spec: Rolling, first: int, final: int, last: Column | int | None = None, idx: str = "idx"
) -> DataFrame:
    """Attach to each row the origins whose rows origin+first .. origin+final contain it.

    Adds ``roll`` (0 = latest) and ``origin``; a row in several windows is repeated, one in none is dropped.
    """
    end = last_index(df, idx) if last is None else (last if isinstance(last, Column) else F.lit(last))
    framed_rows = df.withColumn("_o", end - F.lit(spec.horizon - 1))
    low = F.ceil((F.col("_o") + first - F.col(idx)) / F.lit(spec.step))
    high = F.floor((F.col("_o") + final - F.col(idx)) / F.lit(spec.step))
    room = F.floor((F.col("_o") - F.lit(spec.test_start)) / F.lit(spec.step))
    bounded = framed_rows.withColumn("_a", F.greatest(low, F.lit(0).cast("long"))).withColumn(
        "_b", F.least(high, room, F.lit(spec.windows - 1).cast("long"))
    )
    return (
        bounded.filter("_a <= _b")
        .withColumn("roll", F.explode(F.sequence("_a", "_b")))
        .withColumn("origin", F.col("_o") - F.col("roll") * spec.step)
        .drop("_o", "_a", "_b")
    )


def forecast_rows(panel: DataFrame, spec: Rolling, last: Column | int | None = None) -> DataFrame:
    """``(sid, roll, origin, h, ts, idx, y, ...)``: one row per value to forecast, h = 1 .. horizon."""
    rows = assign_origins(panel, spec, 0, spec.horizon - 1, last)
    return rows.withColumn("h", (F.col("idx") - F.col("origin") + 1).cast("int"))


def context_rows(panel: DataFrame, spec: Rolling, length: int, last: Column | int | None = None) -> DataFrame:
    """The last ``length`` rows before each origin."""
    return assign_origins(panel, spec, -length, -1, last)


def train_rows(panel: DataFrame, spec: Rolling, last: Column | int | None = None) -> DataFrame:
    """Rows before the earliest origin: what a model may be fitted on."""
    end = last_index(panel) if last is None else (last if isinstance(last, Column) else F.lit(last))
    newest = end - F.lit(spec.horizon - 1)
    room = F.floor((newest - F.lit(spec.test_start)) / F.lit(spec.step))
    earliest = newest - F.least(room, F.lit(spec.windows - 1).cast("long")) * spec.step
    return panel.filter(F.col("idx") < earliest)


def window_sizes(panel: DataFrame, spec: Rolling, last: Column | int | None = None) -> DataFrame:
    """Per series and window: origin, first forecast time, rows to forecast, rows of history before it."""
    return (
        forecast_rows(panel, spec, last).groupBy("sid", "roll", "origin")
        .agg(F.min("ts").alias("forecast_start"), F.count("*").alias("n_forecast"))
        .withColumn("n_history", F.col("origin"))
    )


def seasonal_error(panel: DataFrame, spec: Rolling, season: int, last: Column | int | None = None) -> DataFrame:
    """Mean |y - y one season earlier| over the history of every origin: ``(sid, roll, seasonal_error)``.

    A row belongs to the history of all windows up to some number; sums are taken per that number and
    accumulated over the few windows, so history rows are never repeated per window.
    """
    end = last_index(panel) if last is None else (last if isinstance(last, Column) else F.lit(last))
    moved = framed(panel, ["sid"], "idx", {"_prev": lambda w: F.lag("y", season).over(w)}, before=season)
    newest = end - F.lit(spec.horizon - 1)
    room = F.floor((newest - F.lit(spec.test_start)) / F.lit(spec.step))
    upto = F.least(
        F.ceil((newest - F.col("idx")) / F.lit(spec.step)) - 1, F.lit(spec.windows - 1).cast("long"), room
    )
    part = (
        moved.filter(F.col("_prev").isNotNull()).withColumn("roll", upto).filter("roll >= 0")
        .groupBy("sid", "roll").agg(F.sum(F.abs(F.col("y") - F.col("_prev"))).alias("_s"), F.count("*").alias("_n"))
    )
    later = Window.partitionBy("sid").orderBy(F.col("roll").desc())
    return part.select(
        "sid", "roll", (F.sum("_s").over(later) / F.sum("_n").over(later)).alias("seasonal_error")
    )


def at_scenarios(panel: DataFrame, scenarios: list[tuple[str, str]], length: int, minutes: int) -> DataFrame:
    """The last ``length`` rows up to each named end time, with ``scenario``.

    The few named ends ride along as a literal array; a row is repeated for the scenarios it falls in.
    """
    ends = F.array(*[
        F.struct(F.lit(name).alias("scenario"), F.lit(end).cast("timestamp_ntz").alias("test_end")) for name, end in scenarios
    ])
    span = F.expr(f"INTERVAL {minutes * length} MINUTES")
    inside = F.filter(ends, lambda s: (F.col("ts") <= s["test_end"]) & (F.col("ts") > s["test_end"] - span))
    return panel.select("*", F.inline(inside))

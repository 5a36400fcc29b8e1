"""Lags, scales and past/future windows: the rows a model is trained and evaluated on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import safe_div
from tallycast.operators.blocks import affine_scan, framed

MINIMUM_SCALE = 1e-10


def check_lags(lags: Sequence[int], subsequence: int | None = None, length: int | None = None) -> list[int]:
    """Lags sorted; raises on duplicates, negatives, or lags that reach before the history."""
    if len(set(lags)) != len(lags):
        raise ValueError("lags must be distinct")
    if any(k < 0 for k in lags):
        raise ValueError("lags must not be negative")
    if subsequence is not None and length is not None and max(lags) + subsequence > length:
        raise ValueError(f"lag {max(lags)} reaches before a history of {length} rows")
    return sorted(lags)


def lag_features(
    panel: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("sid",), value: str = "y", idx: str = "idx",
    prefix: str = "lag", shift: int = 0, block: int | None = None,
) -> DataFrame:
    """``<prefix>_<k>`` = the value k (minus ``shift``) rows earlier.

    ``shift=1`` gives the decoding form, where lag 1 is the last known value itself.
    """
    lags = check_lags(lags)
    columns = {f"{prefix}_{k}": (lambda w, k=k: F.lag(value, k - shift).over(w)) for k in lags}
    return framed(panel, keys, idx, columns, before=max(max(lags) - shift, 0), block=block)


def mean_scale(
    df: DataFrame, keys: Sequence[str], value: str = "y", observed: Column | None = None,
    minimum: float = MINIMUM_SCALE, default: float | None = None,
) -> DataFrame:
    """Mean absolute observed value per key.

    A key without observed rows takes ``default``, or the mean scale over all observed rows; every scale
    is at least ``minimum``.
    """
    seen = (observed if observed is not None else F.col(value).isNotNull()).cast("double")
    size = F.abs(F.coalesce(F.col(value), F.lit(0.0)))
    sums = df.groupBy(*keys).agg(F.sum(size * seen).alias("_s"), F.sum(seen).alias("_n"))
    own = safe_div(F.col("_s"), F.col("_n"))
    if default is not None:
        fallback = F.lit(float(default))
    else:
        fallback = sums.agg(F.sum("_s") / F.greatest(F.sum("_n"), F.lit(1.0))).scalar()
    return sums.select(*keys, F.greatest(F.coalesce(own, fallback), F.lit(minimum)).alias("scale"))


def total_scale(scales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the series' scales: the scale of the cross-series total."""
    return scales.groupBy(*keys).agg(F.sum("scale").alias("total_scale"))


def scale_columns(df: DataFrame, columns: Sequence[str], scale: str = "scale") -> DataFrame:
    """``<column>_scaled`` = column / scale."""
    return df.select("*", *[safe_div(F.col(c), F.col(scale)).alias(f"{c}_scaled") for c in columns])


def masked_average(value: Column, weight: Column, zeros_in_denominator: bool = False) -> Column:
    """Aggregate: sum(value x weight) / sum(weight), or / row count.  Weight-0 rows never contribute."""
    part = F.sum(F.when(weight != 0, value * weight).otherwise(0.0))
    if zeros_in_denominator:
        return part / F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0))
    return part / F.nullif(F.sum(weight.cast("double")), F.lit(0.0))


def observed(value: Column, is_pad: Column | None = None) -> Column:
    """1 for a real value; padded rows count as unobserved."""
    seen = value.isNotNull().cast("int")
    return seen if is_pad is None else F.least(seen, F.lit(1) - is_pad)


def step_observed(panel: DataFrame) -> DataFrame:
    """Per step, 1 only when every series is observed."""
    return panel.groupBy("ts").agg(F.min("observed").alias("all_observed"))


def impute(value: Column, is_observed: Column, is_pad: Column, substitute: Column) -> Column:
    """Observed values stay, padding becomes 0, gaps take the substitute (a sample mean)."""
    return F.when(is_observed == 1, value).when(is_pad == 1, 0.0).otherwise(substitute)


def impute_forward(panel: DataFrame, mean: Column, pull: float, value: str = "y", idx: str = "idx", block: int | None = None) -> DataFrame:
    """``panel`` with ``filled``: gaps take the value before them, imputed or not, drawn towards ``mean`` by ``pull``.

    filled = mean + pull * (filled before - mean) in a gap, from the row's own ``mean``; a series that begins with one
    starts at 0.  An imputed value feeds the next gap through the affine scan, so no task walks a whole series.
    """
    gap = F.col(value).isNull()
    maps = panel.select("sid", idx, F.when(gap, mean * (1.0 - pull)).otherwise(F.col(value)).alias("shift"), F.when(gap, pull).otherwise(0.0).alias("factor"))
    found = affine_scan(maps, F.lit(0.0), idx, block).withColumnRenamed("value", "filled")
    return panel.join(found, ["sid", idx])


def windows_at(
    cuts: DataFrame, panel: DataFrame, past: int, future: int, lead: int = 0, dummy: float = 0.0,
    values: Sequence[str] = ("y",), idx: str = "idx",
) -> DataFrame:
    """Past and future rows of every cut, long form.

    ``(sid, cut, part, pos, <values>, is_pad)`` with pos 0 .. length-1 in time order; ``values`` are the
    target and any covariates cut alike.  Each cut explodes the offsets it needs and meets the panel in an
    equi-join on (sid, idx), so a cut costs past + future rows whatever the length of its series.  Past rows
    before the series start are padding; future rows after its end do not exist.
    """
    if future <= 0:
        raise ValueError("the future window must not be empty")
    before = F.transform(F.sequence(F.lit(0), F.lit(past - 1)), lambda i: F.struct(
        F.lit("past").alias("part"), i.alias("pos"), (F.col("cut") - past + i).cast("long").alias(idx)))
    after = F.transform(F.sequence(F.lit(0), F.lit(future - 1)), lambda i: F.struct(
        F.lit("future").alias("part"), i.alias("pos"), (F.col("cut") + lead + i).cast("long").alias(idx)))
    offsets = cuts.select("sid", "cut", F.inline(F.concat(before, after)))
    present = panel.select("sid", idx, *values, F.lit(True).alias("_in"))
    joined = offsets.join(present, ["sid", idx], "left")
    pad = F.col(idx) < 0
    return joined.filter((F.col("part") == "past") | F.col("_in")).select(
        "sid", "cut", "part", "pos", *[F.when(pad, F.lit(dummy)).otherwise(F.col(v)).alias(v) for v in values], pad.cast("int").alias("is_pad")
    )


def nest_windows(rows: DataFrame) -> DataFrame:
    """One row per cut with ``past``, ``past_is_pad`` and ``future`` arrays, each at most a window long."""
    def ordered(part: str, field: str) -> Column:
        items = F.collect_list(F.when(F.col("part") == part, F.struct("pos", field)))
        return F.transform(F.array_sort(items), lambda s: s.getField(field))

    return rows.groupBy("sid", "cut").agg(
        ordered("past", "y").alias("past"), ordered("past", "is_pad").alias("past_is_pad"), ordered("future", "y").alias("future")
    )


def forecast_start(start: Column, cut: Column, minutes: int, lead: int = 0) -> Column:
    """Timestamp of the first forecast row."""
    return F.timestamp_add("MINUTE", ((cut + lead) * minutes).cast("int"), start)


def series_lengths(panel: DataFrame, idx: str = "idx") -> DataFrame:
    return panel.groupBy("sid").agg((F.max(idx) + 1).alias("length"))


def last_cut(lengths: DataFrame, min_past: int, min_future: int, allow_empty: bool = True) -> DataFrame:
    """The one cut of prediction mode: length - min_future, for series ``(sid, length)`` with enough past.

    With ``allow_empty=False`` (prediction) a series that is too short fails the query, as it would be
    silently left out of the forecast otherwise; with True (validation) it is dropped.
    """
    cut = lengths.select("sid", (F.col("length") - min_future).alias("cut"))
    enough = F.col("cut") >= min_past
    if allow_empty:
        return cut.filter(enough)
    message = F.concat(F.lit("series too short: "), F.col("sid"))
    return cut.select("sid", F.when(enough, F.col("cut")).otherwise(F.raise_error(message).cast("long")).alias("cut"))


def violations(panel: DataFrame, scales: DataFrame, max_lag: int, horizon: int) -> DataFrame:
    """Data checks as rows: series that are too short for the lags, non-positive scales, unobserved series."""
    length = panel.groupBy("sid").agg(F.count("*").alias("length"), F.count("y").alias("seen"), F.min("y").alias("low"))
    found = length.join(scales, "sid", "left").select(
        "sid",
        F.inline(F.array(
            F.struct(F.lit("history").alias("rule"), (F.col("length") < max_lag + horizon).alias("broken")),
            F.struct(F.lit("scale").alias("rule"), (~(F.coalesce(F.col("scale"), F.lit(0.0)) > 0)).alias("broken")),
            F.struct(F.lit("observed").alias("rule"), (F.col("seen") == 0).alias("broken")),
            F.struct(F.lit("support").alias("rule"), (F.coalesce(F.col("low"), F.lit(0.0)) < 0).alias("broken")),
        )),
    )
    return found.filter("broken").select("sid", "rule")

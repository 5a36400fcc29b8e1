"""Scores of final buckets against the moments of their series and slot so far, in batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "sid string, ts timestamp_ntz, y double, seen bigint, mean double, z double"
STATE = "n bigint, mean double, m2 double"


def hour_slot(ts: Column) -> Column:
    return F.hour(ts)


def _keyed(buckets: DataFrame, value: str) -> DataFrame:
    return buckets.select(F.col("sid").cast("string").alias("sid"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col(value).cast("double").alias("y")).withColumn(
        "slot", hour_slot(F.col("ts")))


def score_buckets(buckets: DataFrame, value: str = "y") -> DataFrame:
    """``(sid, ts, y, seen, mean, z)``: each bucket (sid, ts, value) against the earlier ones of its series and hour of day.

    ``seen`` counts those, ``mean`` is theirs, ``z`` the distance in their standard deviations: NULL for fewer than two
    and where they do not vary.
    """
    keyed = _keyed(buckets, value)
    before = Window.partitionBy("sid", "slot").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    sd = F.stddev_samp("y").over(before)
    mean = F.avg("y").over(before)
    return keyed.select("sid", "ts", "y", F.count("*").over(before).alias("seen"), mean.alias("mean"), F.when(sd > 1e-12, (F.col("y") - mean) / sd).alias("z"))


def _score(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
    rows = pd.concat(list(frames)).sort_values("ts")
    out = []
    for ts, y in zip(rows["ts"], rows["y"]):
        sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
        out.append((key[0], ts, y, n, mean if n else None, (y - mean) / sd if sd > 1e-12 else None))
        n += 1
        step = y - mean
        mean += step / n
        m2 += step * (y - mean)
    state.update((n, mean, m2))
    yield pd.DataFrame(out, columns=["sid", "ts", "y", "seen", "mean", "z"])


def score_stream(buckets: DataFrame, value: str = "y") -> DataFrame:
    """:func:`score_buckets` on a stream of final buckets, such as the files of :func:`tallycast.streaming.buckets.write_buckets`.

    State holds count, mean and sum of squares per series and slot, whatever the length of the stream.  Buckets have to
    come in the order of time from one micro-batch to the next, as buckets that a watermark has closed do; a
    micro-batch sorts its own.
    """
    return _keyed(buckets, value).groupBy("sid", "slot").applyInPandasWithState(_score, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)

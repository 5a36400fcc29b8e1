"""Long panels ``(sid, ts, idx, y)``: bucketing, densifying, slicing and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.operators.blocks import sorted_codes

MAX_PIVOT_COLUMNS = 10_000
GRID_BLOCK = 1024


def bucket_counts(events: DataFrame, sid: str, ts: str = "ts", minutes: int = 15) -> DataFrame:
    """Events per series and time step.  Works on batch and on streaming frames alike.

    The count is combined map-side, so a series that owns a third of all events sends at most one row
    per task and step through the shuffle.
    """
    return (
        events.groupBy(F.window(ts, f"{minutes} minutes").alias("_w"), F.col(sid).cast("string").alias("sid"))
        .agg(F.count("*").alias("n"))
        .select("sid", F.col("_w.start").alias("ts"), "n")
    )


def bucket_start(ts: Column, minutes: int) -> Column:
    return F.window(ts, f"{minutes} minutes").getField("start")


def step_index(start: Column, ts: Column, minutes: int) -> Column:
    """Whole steps from ``start`` to ``ts``."""
    return F.floor(F.timestamp_diff("MINUTE", start, ts) / minutes)


def time_grid(bounds: DataFrame, minutes: int) -> DataFrame:
    """``(ts, idx)`` for every step between the two columns ``a`` and ``b`` of a one-row frame."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    return bounds.select(F.posexplode(F.sequence("a", "b", step)).alias("idx", "ts")).select(
        "ts", F.col("idx").cast("long").alias("idx")
    )


def densify(
    counts: DataFrame,
    series: DataFrame,
    bounds: DataFrame,
    minutes: int = 15,
    value: str = "n",
    fill: float | None = 0.0,
) -> DataFrame:
    """Every series at every step, gaps as ``fill`` (NULL when None): ``(sid, ts, idx, y)``.

    ``series`` is one row per ``sid``; ``bounds`` one row ``(a, b)`` with the first and last step.  Only the counts
    and a row for each series and index block are shuffled and sorted, never the grid: a count stands for its own
    step and the empty ones up to the next count, the row of a block for those before its first count, and the
    steps are made from that in place.  So neither step nor join is needed for a gap, a task holds a row at a time,
    and the grid's rows leave it series by series, in step order within a block.

    Counts off the grid, or of other series, are dropped.  The grid grows from rows that adaptive execution would
    coalesce into one task, so the number of partitions is fixed.
    """
    spark = series.sparkSession
    limits = bounds.select(F.struct(F.col("a"), step_index(F.col("a"), F.col("b"), minutes).alias("n"))).scalar()
    width = max(8, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    step_ts = lambda idx, lim: F.timestamp_add("MINUTE", (idx * minutes).cast("int"), lim["a"])
    lim, idx = F.col("_lim"), F.col("idx")
    blocks = series.select("sid", limits.alias("_lim")).select(
        "sid", F.explode(F.sequence(F.lit(0).cast("long"), lim["n"], F.lit(GRID_BLOCK).cast("long"))).alias("_from"),
        F.lit(None).cast("long").alias("idx"), F.lit(None).cast("double").alias("y"))
    placed = counts.select("sid", "ts", F.col(value).cast("double").alias("y"), limits.alias("_lim")).withColumn("idx", step_index(lim["a"], F.col("ts"), minutes))
    cells = placed.filter(F.col("sid").isNotNull() & idx.between(0, lim["n"]) & (F.col("ts") == step_ts(idx, lim))).select(
        "sid", (idx - F.pmod(idx, F.lit(GRID_BLOCK))).alias("_from"), "idx", "y")
    dealt = blocks.unionByName(cells).repartition(width, "sid", "_from")
    within = Window.partitionBy("sid", "_from").orderBy(idx.asc_nulls_first())
    following = dealt.select("*", F.lead("idx").over(within).alias("_next"), F.first("idx").over(within).isNull().alias("_known"), limits.alias("_lim"))
    until = F.coalesce(F.col("_next") - 1, F.least(F.col("_from") + GRID_BLOCK - 1, lim["n"]))
    spans = following.filter("_known").select("sid", "_lim", "y", idx.alias("_at"), F.coalesce(idx, F.col("_from")).alias("_lo"), F.greatest(until, idx).alias("_hi"))
    grid = spans.filter("_lo <= _hi").select("sid", "_lim", "y", "_at", F.explode(F.sequence("_lo", "_hi")).alias("idx"))
    y = F.when(idx == F.col("_at"), F.col("y"))
    if fill is not None:
        y = F.coalesce(y, F.lit(float(fill)))
    return grid.select("sid", step_ts(idx, lim).alias("ts"), "idx", y.alias("y"))


def event_panel(events: DataFrame, sid: str, ts: str = "ts", minutes: int = 15) -> DataFrame:
    """Raw events to a dense count panel.  Series and bounds come from narrow scans of one column each."""
    return densify(
        bucket_counts(events, sid, ts, minutes), event_series(events, sid), event_bounds(events, ts, minutes), minutes
    )


def value_panel(events: DataFrame, sid: str, value: str, ts: str = "ts", minutes: int = 15) -> DataFrame:
    """Mean of a measured value per series and step; steps without events stay NULL (unobserved)."""
    means = (
        events.groupBy(F.window(ts, f"{minutes} minutes").alias("_w"), F.col(sid).cast("string").alias("sid"))
        .agg(F.avg(value).alias("v")).select("sid", F.col("_w.start").alias("ts"), "v")
    )
    return densify(means, event_series(events, sid), event_bounds(events, ts, minutes), minutes, "v", fill=None)


def event_series(events: DataFrame, sid: str) -> DataFrame:
    return events.select(F.col(sid).cast("string").alias("sid")).where(F.col("sid").isNotNull()).distinct()


def event_bounds(events: DataFrame, ts: str = "ts", minutes: int = 15) -> DataFrame:
    """First and last step ``(a, b)`` with events."""
    ends = events.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    first = ends.select(bucket_start(F.col("lo"), minutes).alias("a"), "hi")
    return first.select("a", bucket_start(F.col("hi"), minutes).alias("b"))


def daily_counts(rows: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows per key and day: ``(keys, ts, n)``."""
    return rows.groupBy(*keys, F.to_date(ts).cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))


def daily_panel(counts: DataFrame, series: DataFrame, rows: DataFrame, ts: str) -> DataFrame:
    """Dense daily panel from counts ``(sid, ts, n)``; the day range is that of ``rows``."""
    day = F.col(ts).cast("date").cast("timestamp_ntz")
    bounds = rows.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return densify(counts, series, bounds, minutes=24 * 60)


def totals(panel: DataFrame) -> DataFrame:
    """Cross-series total per step: ``(ts, idx, total)``."""
    return panel.groupBy("ts", "idx").agg(F.sum("y").alias("total"))


def nonzero_total_mean(panel: DataFrame) -> DataFrame:
    """Mean of the non-zero totals, plus one: the constant a total branch can be scaled by."""
    t = totals(panel)
    nonzero = F.nullif(F.count_if(F.col("total") != 0), F.lit(0))
    return t.agg((F.sum("total") / nonzero + 1.0).alias("vt"))


def series_codes(panel: DataFrame, sid: str = "sid") -> DataFrame:
    """``(sid, code)``: 0 .. D-1 in sorted order, as a category codec would give."""
    return sorted_codes(panel, sid, "code")


def level_list(df: DataFrame, column: str, limit: int = MAX_PIVOT_COLUMNS) -> list:
    """Sorted distinct values as a driver list, refused when there are more than ``limit``.

    Only for values that become columns, whose number Spark bounds anyway.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} levels; keep the frame long instead")
    return sorted(r[0] for r in rows)


def to_wide(panel: DataFrame, levels: Sequence[str] | None = None, value: str = "y") -> DataFrame:
    """One column per series.  Give ``levels`` to save the job that discovers them."""
    levels = list(levels) if levels is not None else level_list(panel, "sid")
    return panel.groupBy("ts").pivot("sid", levels).agg(F.first(value))


def to_long(wide: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """The inverse of :func:`to_wide`: ``(ts, sid, y)``."""
    return wide.unpivot([ts], list(columns), "sid", "y")


def closed_slice(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts <= end, both ends included; ``None`` leaves an end open."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def history_before(df: DataFrame, start, ts: str = "ts") -> DataFrame:
    """Rows strictly before ``start``."""
    return df.filter(F.col(ts) < F.lit(start).cast("timestamp_ntz"))


def train_test(panel: DataFrame, train_end, test_start, test_end=None) -> tuple[DataFrame, DataFrame]:
    """Train rows up to ``train_end`` and test rows from ``test_start``; the two may overlap."""
    return closed_slice(panel, end=train_end), closed_slice(panel, test_start, test_end)


def last_index(panel: DataFrame, idx: str = "idx") -> Column:
    """Index of the last step of the common grid, as a scalar."""
    return panel.agg(F.max(idx)).scalar()


def event_last_index(events: DataFrame, ts: str = "ts", minutes: int = 15) -> Column:
    """The same for :func:`event_panel`, from a scan of the timestamp alone."""
    return event_bounds(events, ts, minutes).select(step_index(F.col("a"), F.col("b"), minutes)).scalar()


def tail(panel: DataFrame, count: int, idx: str = "idx", last: Column | int | None = None) -> DataFrame:
    """Last ``count`` steps of the common grid; an index comparison, no sort.

    ``last`` is the grid's last index when the caller knows it more cheaply than by a look at the panel.
    """
    end = last_index(panel, idx) if last is None else last
    return panel.filter(F.col(idx) > end - F.lit(count))


def dataset_stats(panel: DataFrame) -> DataFrame:
    """Per-series shape: length, first and last step, observed rows, total, mean target."""
    return panel.groupBy("sid").agg(
        F.count("*").alias("length"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("y").alias("observed"),
        F.sum("y").alias("total"),
        F.avg("y").alias("mean_target"),
    )

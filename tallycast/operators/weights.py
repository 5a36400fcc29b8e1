"""Importance weights of the past window and the cut points drawn by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.numeric import hash_uniform
from tallycast.operators.blocks import BLOCK, framed


def rolling_past_weight(
    df: DataFrame, columns: Sequence[str], length: int, idx: str = "idx", out: str = "weight", block: int | None = None
) -> DataFrame:
    """Rounded sum of all weight columns over the ``length`` rows before each row.

    Rows nearer than ``length`` to either end carry 0, as the published tables do.  One row per step comes
    in; blocks with a halo keep even a decade of minutes out of a single task.
    """
    row = None
    for c in columns:
        row = F.col(c) if row is None else row + F.col(c)
    rows = df.withColumn("_row", row)
    bounds = rows.agg(F.struct(F.min(idx).alias("lo"), F.max(idx).alias("hi")).alias("m")).scalar()
    rolled = framed(
        rows, [], idx, {"_sum": lambda w: F.sum("_row").over(w.rowsBetween(-length, -1))}, before=length, block=block
    ).withColumn("_m", bounds)
    position = F.col(idx) - F.col("_m.lo")
    count = F.col("_m.hi") - F.col("_m.lo") + 1
    inside = (position >= length) & (position < count - length)
    return rolled.withColumn(out, F.when(inside, F.rint("_sum")).otherwise(0.0).cast("long")).drop("_row", "_sum", "_m")


def cut_table(
    weights: DataFrame, min_past: int, min_future: int, length: Column | int | None = None, keys: Sequence[str] = ("sid",),
    idx: str = "idx", weight: str = "weight", block: int = BLOCK,
) -> DataFrame:
    """Half-open probability interval ``[p_lo, p_hi)`` of every admissible cut point.

    Admissible are min_past <= idx < length - min_future; p is proportional to |weight|, uniform when all
    weights of a series are 0.  ``length`` is the common number of steps; when None each series has its own.
    Running totals are local to index blocks plus the totals of earlier blocks, so one long series is
    spread over tasks and only one row per block is ordered per series.
    """
    keys = list(keys)
    if length is None:
        own = weights.groupBy(*keys).agg((F.max(idx) + 1).alias("_len"))
        rows = weights.join(own, keys)
    else:
        rows = weights.withColumn("_len", length if isinstance(length, Column) else F.lit(length))
    inside = (
        rows.filter((F.col(idx) >= min_past) & (F.col(idx) < F.col("_len") - min_future))
        .select(*keys, idx, weight, F.abs(F.col(weight)).cast("double").alias("_w"), F.floor(F.col(idx) / block).alias("_blk"))
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    by_block = (
        inside.groupBy(*keys, "_blk").agg(F.sum("_w").alias("_bw"), F.count("*").cast("double").alias("_bn"))
        .select(
            *keys, "_blk",
            F.coalesce(F.sum("_bw").over(earlier), F.lit(0.0)).alias("_w0"), F.sum("_bw").over(whole).alias("_wt"),
            F.coalesce(F.sum("_bn").over(earlier), F.lit(0.0)).alias("_n0"), F.sum("_bn").over(whole).alias("_nt"),
        )
    )
    local = Window.partitionBy(*keys, "_blk").orderBy(idx)
    cum = inside.select("*", F.sum("_w").over(local.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.row_number().over(local).alias("_r"))
    high = F.when(F.col("_wt") > 0, (F.col("_w0") + F.col("_c")) / F.nullif("_wt", F.lit(0.0))).otherwise((F.col("_n0") + F.col("_r")) / F.col("_nt"))
    low = F.when(F.col("_wt") > 0, (F.col("_w0") + F.col("_c") - F.col("_w")) / F.nullif("_wt", F.lit(0.0))).otherwise(
        (F.col("_n0") + F.col("_r") - 1) / F.col("_nt"))
    return cum.join(by_block, [*keys, "_blk"]).select(*keys, idx, weight, low.alias("p_lo"), high.alias("p_hi"))


CELLS = 4096


def draw_cuts(
    table: DataFrame, draws: int, seed: str, keys: Sequence[str] = ("sid",), idx: str = "idx", series: DataFrame | None = None
) -> DataFrame:
    """``draws`` cut points per series, with replacement, from :func:`cut_table`.

    ``series`` lists the keys to draw for, when that is cheaper to name than to read off the table.

    The unit interval is divided into cells so that "which interval holds u" is an equi-join on (series,
    cell) with a residual comparison: a wide interval is copied into the cells it spans, and each draw
    meets only the few intervals of its own cell.
    """
    keys = list(keys)
    spans = table.filter(F.col("p_hi") > F.col("p_lo")).withColumn(
        "_cell",
        F.explode(F.sequence(
            F.floor(F.col("p_lo") * CELLS), F.least(F.floor(F.col("p_hi") * CELLS), F.lit(CELLS - 1).cast("long"))
        )),
    )
    wanted = (
        (table if series is None else series).select(*keys).distinct()
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("u", hash_uniform(seed, *[F.col(k) for k in keys], F.col("draw")))
        .withColumn("_cell", F.floor(F.col("u") * CELLS))
    )
    hit = wanted.join(spans, [*keys, "_cell"]).filter((F.col("u") >= F.col("p_lo")) & (F.col("u") < F.col("p_hi")))
    return hit.select(*keys, "draw", F.col(idx).alias("cut"))


def uniform_cuts(
    panel: DataFrame, expected: float, min_past: int, min_future: int, seed: str, idx: str = "idx",
    length: Column | int | None = None,
) -> DataFrame:
    """Keep each admissible cut with the probability that gives ``expected`` cuts per series on average.

    ``length`` is the common number of steps; when None each series has its own.
    """
    if length is None:
        window = F.col("_len") - min_future - min_past + 1
        own = panel.groupBy("sid").agg((F.max(idx) + 1).alias("_len")).filter(window > 0)
        average = own.agg(F.avg(window.cast("double"))).scalar()
        rows = panel.join(own, "sid")
    else:
        rows = panel.withColumn("_len", length if isinstance(length, Column) else F.lit(length))
        average = (F.col("_len") - min_future - min_past + 1).cast("double")
    candidate = rows.filter((F.col(idx) >= min_past) & (F.col(idx) <= F.col("_len") - min_future))
    # one position past the last row is admissible when no future is required; it has no row to keep
    u = hash_uniform(seed, F.col("sid"), F.col(idx))
    return candidate.filter(u < F.lit(float(expected)) / average).select("sid", F.col(idx).alias("cut"))


def series_subset(cuts: DataFrame, codes: DataFrame, count: int, seed: str) -> DataFrame:
    """``count`` different series per cut, uniformly at random: ``(cut, sid)``.

    Floyd's sampling without replacement runs inside each cut's row and touches ``count`` codes only; the
    names come from an equi-join on the code.  Nothing enumerates cuts x series.
    """
    size = codes.agg(F.count("*").cast("int")).scalar()
    rows = cuts.select("cut").distinct().withColumn("_d", size)
    first = F.greatest(F.col("_d") - count, F.lit(0))

    def step(chosen, j):
        pick = F.floor(hash_uniform(seed, F.col("cut"), j) * (j + 1)).cast("int")
        return F.array_append(chosen, F.when(F.array_contains(chosen, pick), j).otherwise(pick))

    chosen = F.aggregate(F.sequence(first, F.col("_d") - 1), F.array().cast("array<int>"), step)
    picked = rows.select("cut", F.explode(chosen).alias("code")).withColumn("code", F.col("code").cast("long"))
    return picked.join(codes, "code").select("cut", "sid")

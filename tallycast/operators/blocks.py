"""Ordered computation over long series without ever holding one series in one task.

A regular grid gives every row an integer ``idx``.  Cutting the index into blocks bounds each window
partition, and a halo of neighbouring rows makes bounded frames exact at the block edges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallycast.session import materialise

BLOCK = 4096


def _width(before: int, after: int, block: int | None) -> int:
    return max(block or BLOCK, before + after, 1)


def with_halo(df: DataFrame, idx: str, before: int, after: int, block: int | None = None) -> DataFrame:
    """Copy each row into every block whose frames can see it; ``_core`` marks its own block.

    Rows are copied at most into their neighbours, because a block is never narrower than the halo.
    """
    width = _width(before, after, block)
    own = F.floor(F.col(idx) / width)
    low = F.floor((F.col(idx) - after) / width)
    high = F.floor((F.col(idx) + before) / width)
    return df.withColumn("_blk", F.explode(F.sequence(low, high))).withColumn("_core", F.col("_blk") == own)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    columns: dict[str, Callable[[WindowSpec], Column]],
    before: int,
    after: int = 0,
    block: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and ``after`` rows on.

    ``columns`` maps a new name to a function of the ordered window.  The grid must be dense in ``idx``.
    """
    wide = with_halo(df, idx, before, after, block)
    w = Window.partitionBy(*keys, "_blk").orderBy(idx)
    out = wide.select("*", *[build(w).alias(name) for name, build in columns.items()])
    return out.filter("_core").drop("_blk", "_core")


def sorted_codes(df: DataFrame, column: str, out: str = "code", splits: int = 256) -> DataFrame:
    """Distinct values of ``column`` with their 0-based rank in sorted order.

    A plain ``row_number`` over all values would sort them in one task.  Instead ``splits`` of the values,
    picked by hash, cut the order into ranges; ranks are local to a range plus the sizes of lower ranges.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    picked = (
        values.orderBy(F.xxhash64(column), column).limit(splits)
        .agg(F.array_sort(F.collect_list(column)).alias("_splits"))
    )
    ranged = (
        values.withColumn("_splits", picked.scalar())
        # never NULL: a nullable join key would be null-checked below the distinct, once per input row
        .withColumn("_range", F.coalesce(F.size(F.filter("_splits", lambda s: s <= F.col(column))), F.lit(0))).drop("_splits")
    )
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (  # at most splits + 1 rows
        ranged.groupBy("_range").agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return (
        ranged.withColumn("_local", local).join(sizes, "_range")
        .select(column, (F.col("_local") + F.col("_offset")).cast("long").alias(out))
    )


def affine_scan(rows: DataFrame, start: Column, idx: str = "idx", block: int | None = None) -> DataFrame:
    """``(sid, idx, value)`` of the recursion value = shift + factor * value before, from ``start`` before a series' first row.

    ``rows``: ``(sid, idx, shift, factor)`` and what ``start`` needs, an expression that is the same for all rows of a
    series.  Affine maps compose associatively, so a block of rows becomes one map, blocks of blocks again, until a
    series fits one block; the values handed down then start every block's own pass.  A task holds one block.
    """
    width = block or BLOCK
    maps = rows.select("sid", F.col(idx).alias("i"), F.col("shift").cast("double").alias("a"), F.col("factor").cast("double").alias("b"))
    first = rows.groupBy("sid").agg(F.first(start).cast("double").alias("x"))
    values = _values(maps, first, width)
    return values.select("sid", F.col("i").alias(idx), "value")


def _values(maps: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """``(sid, i, value)`` behind every map (sid, i, a, b), given the value ``x`` before each series."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "a", "b")))
    blocks = materialise(maps.groupBy("sid", F.floor(F.col("i") / width).alias("k")).agg(ordered.alias("m")), "blocks")
    spans = blocks.groupBy("sid").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if spans <= 1:
        ready = blocks.join(first, "sid")
    else:
        one = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
        whole = F.aggregate("m", one, lambda s, m: F.struct((m["a"] + m["b"] * s["a"]).alias("a"), (m["b"] * s["b"]).alias("b")))
        tops = blocks.select("sid", F.col("k").alias("i"), whole.alias("w")).select("sid", "i", "w.a", "w.b")
        behind = _values(tops, first, width)
        # the value behind a block starts the next one that has rows
        order = Window.partitionBy("sid", F.floor(F.col("i") / width)).orderBy("i")
        edge = behind.groupBy("sid", F.floor(F.col("i") / width).alias("g")).agg(F.max_by("value", "i").alias("last"), F.max("i").alias("i"))
        before = Window.partitionBy("sid").orderBy("g")
        carried = edge.select("sid", "g", F.lag("last").over(before).alias("carried"))
        starts = behind.withColumn("g", F.floor(F.col("i") / width)).withColumn("inner", F.lag("value").over(order)).join(carried, ["sid", "g"])
        ready = blocks.join(starts.select("sid", F.col("i").alias("k"), "inner", "carried"), ["sid", "k"]).join(first, "sid").withColumn(
            "x", F.coalesce("inner", "carried", "x"))
    step = lambda s, m: F.concat(s, F.array(m["a"] + m["b"] * F.element_at(s, -1)))
    walked = F.slice(F.aggregate("m", F.array("x"), step), 2, width)
    pairs = ready.withColumn("v", walked).select("sid", F.explode(F.zip_with("m", "v", lambda m, v: F.struct(m["i"].alias("i"), v.alias("value")))).alias("z"))
    return pairs.select("sid", "z.i", "z.value")

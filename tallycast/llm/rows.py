"""Keys of rows, and joins with sides of a counted size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 250_000  # rows of a narrow side (some 100 bytes each in memory) up to which it is broadcast


def row_key() -> list[Column]:
    """Columns (ka, kb): a 128-bit key of id and text, never null."""
    return [F.xxhash64("doc_id", "text").alias("ka"), F.xxhash64("text", "doc_id", F.lit(1)).alias("kb")]


def small(df: DataFrame) -> DataFrame:
    """Broadcast a narrow table if it is counted to be small; else the join decides."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df

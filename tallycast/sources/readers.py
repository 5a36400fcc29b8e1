"""Readers: tables, delimited files, and wide count files as long panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.functions.timekeys import compose_timestamp
from tallycast.operators.panel import to_long
from tallycast.sources.schemas import TABLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def delimited(
    spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", columns: Sequence[str] | None = None
) -> DataFrame:
    """Delimited text with a header; only ``columns`` are parsed when given."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", True).csv(path)
    return df.select(*columns) if columns else df


def weather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Hourly weather: month-first dates become ISO text keys."""
    df = delimited(spark, path, schema, columns=["date", "hrr", "temp", "precip"])
    return df.withColumn("date", F.date_format(F.to_date("date", "M/d/yyyy"), "yyyy-MM-dd"))


def school_calendar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Semicolon file; the first ten characters of a date count."""
    df = delimited(spark, path, schema, sep=";")
    return df.withColumn("date_from", F.to_date(F.substring("date_from", 1, 10))).withColumn(
        "date_to", F.to_date(F.substring("date_to", 1, 10))
    )


def wide_counts(
    spark: SparkSession, path: str, schema: str, series: Sequence[str], time_format: str | None = None
) -> DataFrame:
    """Wide count file to ``(ts, sid, y)``, missing counts 0.

    The time is the index column in ``time_format``, or is composed from ``date`` and ``hr``.
    """
    df = delimited(spark, path, schema)
    if time_format:
        ts = F.to_timestamp_ntz(F.col("row"), F.lit(time_format))
    else:
        ts = compose_timestamp(F.col("date"), F.col("hr"))
    wide = df.select(ts.alias("ts"), *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in series])
    return to_long(wide, series)

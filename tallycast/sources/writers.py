"""Writers: panels, metrics, forecasts and model parameters as tables instead of pickles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.operators.panel import to_wide
from tallycast.plans.metrics import mean_wide


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_panel(panel: DataFrame, path: str) -> None:
    """Long panel partitioned by day, so that a time slice reads its own days only.

    Rows are spread by (day, series hash) before the write: a day never lands in one task, and a day
    folder gets a bounded number of files.
    """
    day = panel.withColumn("day", F.to_date("ts")).withColumn("_s", F.pmod(F.xxhash64("sid"), F.lit(16)))
    day.repartition("day", "_s").drop("_s").write.mode("overwrite").partitionBy("day").parquet(path)


def write_wide_counts(panel: DataFrame, path: str, levels: Sequence[str]) -> None:
    write_csv(to_wide(panel, levels), path)


def write_metrics(metrics: DataFrame, path: str, model: str, run_id: str) -> None:
    """Add one run to the metrics table; a rerun replaces its own partition only."""
    rows = metrics.withColumn("model", F.lit(model)).withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "run_id").parquet(path)


def write_forecast(forecast: DataFrame, path: str) -> None:
    """Forecast rows with their targets and sample arrays."""
    forecast.write.mode("overwrite").partitionBy("roll").parquet(path)


def write_mean_forecast(forecast: DataFrame, path: str, levels: Sequence[str]) -> None:
    write_csv(mean_wide(forecast, levels), path)


def save_parameters(tables: dict[str, DataFrame], path: str) -> None:
    """A fitted forecaster is its parameter tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_parameters(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}

"""One run end to end, and a list of runs that skips what is already stored."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.operators.panel import step_index
from tallycast.plans.forecast import Settings, forecast
from tallycast.plans.metrics import aggregate_metrics, headline, item_metrics, scored_rows, sum_over_series
from tallycast.plans.params import Params
from tallycast.plans.sweep import pending, run_label, stacked
from tallycast.session import materialise
from tallycast.sources.writers import write_metrics


def evaluate(forecasts: DataFrame) -> DataFrame:
    """The four reported numbers of a set of forecasts, ``(metrics, values)``."""
    per_series = aggregate_metrics(item_metrics(scored_rows(forecasts)))
    summed = aggregate_metrics(item_metrics(scored_rows(sum_over_series(forecasts)), keys=["roll"]))
    return headline(per_series, summed)


def run(panel: DataFrame, params: Params, rep: int = 0) -> DataFrame:
    """Fit on the rows before the test span's first origin, forecast its rolling windows, evaluate."""
    until = panel.filter(F.col("ts") <= F.lit(params.test_end).cast("timestamp_ntz"))
    start = step_index(F.min("ts"), F.lit(params.test_start).cast("timestamp_ntz"), params.minutes)
    first, last = until.agg(start, F.max("idx")).first()
    forecasts = forecast(params.model, until, params.settings(int(first), seed=str(rep), last=int(last)))
    return evaluate(materialise(forecasts))


def forecast_scenarios(panel: DataFrame, model: str, scenarios: Sequence[tuple[str, str]], settings: Settings) -> DataFrame:
    """Forecasts of a registered model for the last horizon up to each named end, with ``scenario``.

    The fit of a scenario sees the rows before its horizon only.  The few names are a declared list; the forecasts are
    one plan, and a panel is read once per scenario up to its end.
    """
    parts = []
    for name, end in scenarios:
        until = panel.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
        last = until.agg(F.max("idx")).first()[0]
        if last is not None:
            horizon = settings.rolling.horizon
            rolling = replace(settings.rolling, windows=1, test_start=int(last) - horizon + 1)
            parts.append(forecast(model, until, replace(settings, rolling=rolling, last=int(last))).withColumn("scenario", F.lit(name)))
    return stacked(parts)


def label_of(panel: DataFrame, params: Params, rep: int) -> str:
    """A run's id: the first 16 hexadecimal digits of the SHA-256 of all its settings, short enough for a folder name."""
    values = {f.name: getattr(params, f.name) for f in fields(params)}
    column = run_label(rep=F.lit(rep), **{k: F.lit(",".join(map(str, v)) if isinstance(v, tuple) else v) for k, v in values.items()})
    return panel.sparkSession.range(1).select(F.substring(F.sha2(column, 256), 1, 16)).first()[0]


def run_pending(panel: DataFrame, runs: Iterable[tuple[Params, int]], path: str) -> DataFrame:
    """Store the metrics of every run that is not stored yet; returns the table of all stored runs.

    A run that fails raises: its partition stays absent, so a restart takes up there.
    """
    spark = panel.sparkSession
    labelled = {label_of(panel, p, rep): (p, rep) for p, rep in runs}
    wanted = spark.createDataFrame([(p.model, label) for label, (p, _) in labelled.items()], "model string, run_id string")
    try:
        done = spark.read.parquet(path).select("model", "run_id").distinct()
        wanted = pending(wanted, done, ["model", "run_id"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    for row in wanted.orderBy("model", "run_id").collect():  # as many rows as runs were given
        params, rep = labelled[row.run_id]
        write_metrics(run(panel, params, rep), path, row.model, row.run_id)
    return spark.read.parquet(path)

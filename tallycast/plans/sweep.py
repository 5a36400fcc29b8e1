"""Parameter grids, run labels, resuming, and one evaluation over many settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.distributions import gaussian_crps
from tallycast.functions.numeric import safe_div
from tallycast.operators.covariance import factor_model
from tallycast.operators.instances import MINIMUM_SCALE
from tallycast.plans.backtest import context_rows, forecast_rows, train_rows
from tallycast.plans.forecast import Settings, with_slot

# The swept cell pairs and dropout rates, and how often a run is repeated.
CELL_PAIRS = ((16, 16), (32, 16), (32, 32), (64, 16), (64, 32), (64, 64))
DROPOUTS = (0.05, 0.1)
REPETITIONS = 6


def with_grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Repeat each row for every combination of the axes; literal arrays, so no join."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def with_cell_pairs(df: DataFrame, pairs: Sequence[tuple[int, int]] = CELL_PAIRS) -> DataFrame:
    items = F.array(*[F.struct(F.lit(a).alias("cells1"), F.lit(b).alias("cells2")) for a, b in pairs])
    return df.select("*", F.inline(items))


def repeated(df: DataFrame, times: int = REPETITIONS) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def run_label(**settings: Column) -> Column:
    """The settings that distinguish a run as sorted ``name=value`` pairs; a NULL one does not apply and is left out."""
    parts = [F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in sorted(settings.items())]
    return F.concat_ws(";", *parts)


def pending(runs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs without a stored result."""
    return runs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def stacked(results: Sequence[DataFrame]) -> DataFrame:
    """One result table of several runs."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def context_scales(panel: DataFrame, s: Settings, contexts: Sequence[int]) -> DataFrame:
    """``(sid, roll, scales)``: mean absolute value of the last rows before each origin, for every length of ``contexts``, in one pass."""
    rows = context_rows(panel, s.rolling, max(contexts), s.last)
    inside = [F.col("idx") >= F.col("origin") - c for c in contexts]
    means = [F.greatest(F.coalesce(F.avg(F.when(i, F.abs("y"))), F.lit(0.0)), F.lit(MINIMUM_SCALE)) for i in inside]
    return rows.groupBy("sid", "roll").agg(F.array(*means).alias("scales"))


def gaussian_sweep(panel: DataFrame, s: Settings, contexts: Sequence[int], ranks: Sequence[int]) -> DataFrame:
    """``(context, rank, crps, sum_crps, n, n_sum)`` of the scaled factor model for every context length and rank, in one plan.

    The model is fitted once: slot means, and one basis of the residuals of which a rank takes the first factors and
    leaves the rest of each series' variance on its diagonal (rank 0: independent series).  Context lengths are
    conditional means of one pass.  Axes are arrays on the row: the forecast rows are summed over the series once per
    context, factor by factor, and the ranks come out of prefixes of those sums.  ``crps`` is the mean score of the
    series' normal margins, ``sum_crps`` that of the cross-series total, which depends on the rank.
    """
    cells = with_slot(panel, s.slot_kind, s.minutes)
    train, rows = train_rows(cells, s.rolling, s.last), forecast_rows(cells, s.rolling, s.last)
    means = train.groupBy("sid", "slot").agg(F.avg("y").alias("mu"))
    whole = train.groupBy("sid").agg(F.avg("y").alias("_whole"), F.greatest(F.avg(F.abs("y")), F.lit(MINIMUM_SCALE)).alias("_level"))
    residual = train.join(means, ["sid", "slot"]).withColumn("e", F.col("y") - F.col("mu"))
    most = max(ranks)
    loadings, diag = factor_model(residual, max(most, 1), "e")
    squares = F.transform("loadings", lambda v: v * v)
    upto = lambda k: F.aggregate(F.slice(squares, 1, k), F.lit(0.0), lambda a, v: a + v) if k else F.lit(0.0)
    spread = F.col("diag") + F.aggregate(squares, F.lit(0.0), lambda a, v: a + v)
    basis = loadings.join(diag, "sid").select("sid", "loadings", spread.alias("_var"), F.array(*[F.greatest(spread - upto(k), F.lit(0.0)) for k in ranks]).alias("_own"))
    ready = rows.join(means, ["sid", "slot"], "left").join(whole, "sid", "left").join(basis, "sid", "left").join(context_scales(panel, s, contexts), ["sid", "roll"], "left")
    factor = F.coalesce(F.col("scales")[F.col("_at")] / F.col("_level"), F.lit(1.0))
    lengths = F.array(*map(F.lit, contexts))
    each = ready.select(
        "sid", "roll", "origin", "h", "y", F.coalesce("mu", "_whole", F.lit(0.0)).alias("_mu"), F.coalesce("_var", F.lit(0.0)).alias("_var"), "loadings", "_own",
        "scales", "_level", F.posexplode(lengths).alias("_at", "context"),
    ).withColumn("_f", factor)
    mean, sd = F.col("_mu") * F.col("_f"), F.sqrt("_var") * F.col("_f")
    scored = each.withColumn("_crps", gaussian_crps(F.col("y"), mean, sd))
    sums = [F.sum(F.coalesce(F.col("loadings")[j], F.lit(0.0)) * F.col("_f")) for j in range(most)]
    own = [F.sum(F.coalesce(F.col("_own")[i], F.lit(0.0)) * F.col("_f") * F.col("_f")) for i in range(len(ranks))]
    step = scored.groupBy("context", "roll", "origin", "h").agg(
        F.sum("_crps").alias("_crps"), F.count("*").alias("_n"), F.sum("y").alias("y"), F.sum(mean).alias("_mean"),
        F.array(*sums).cast("array<double>").alias("_s"), F.array(*own).alias("_own"))
    by_rank = step.select("*", F.posexplode(F.array(*map(F.lit, ranks))).alias("_i", "rank"))
    shared = F.aggregate(F.slice("_s", F.lit(1), F.col("rank")), F.lit(0.0), lambda a, v: a + v * v)
    total = by_rank.withColumn("_v", shared + F.col("_own")[F.col("_i")]).withColumn("_sum", gaussian_crps(F.col("y"), F.col("_mean"), F.sqrt("_v")))
    return total.groupBy("context", "rank").agg(
        safe_div(F.sum("_crps"), F.sum("_n").cast("double")).alias("crps"), F.avg("_sum").alias("sum_crps"), F.sum("_n").alias("n"), F.count("*").alias("n_sum"))

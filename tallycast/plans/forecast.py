"""Forecasters: distribution parameters from distributed aggregates, sample paths as short arrays.

A forecast row is one value to predict with ``samples``, an array of at most a few hundred numbers; the long
form with one row per sample is :func:`explode_samples`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.distributions import nb_shape
from tallycast.functions.numeric import digamma, digamma_rise, hash_normal, safe_div, trigamma, trigamma_rise
from tallycast.operators.covariance import factor_model
from tallycast.operators.draws import dm_split, factor_noise, nb_samples, with_step_normals
from tallycast.operators.instances import MINIMUM_SCALE, check_lags, lag_features
from tallycast.operators.marginal import empirical_quantile, sorted_recent, to_gaussian
from tallycast.operators.panel import last_index, totals
from tallycast.plans.backtest import Rolling, context_rows, forecast_rows, train_rows
from tallycast.session import materialise

ALPHA_FLOOR = 1e-3
ALPHA_TOTAL_LIMIT = 1e12  # stands for a total concentration without bound, where shares do not vary: the multinomial


def slot(ts: Column, kind: str = "hour", minutes: int = 15) -> Column:
    """Parameter cell of a step: hour of day, or (weekday, position in the day)."""
    if kind == "hour":
        return F.hour(ts)
    if kind == "week":
        per_day = 24 * 60 // minutes
        return F.weekday(ts) * per_day + F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")
    raise ValueError(f"unknown slot kind {kind}")


def with_slot(df: DataFrame, kind: str = "hour", minutes: int = 15) -> DataFrame:
    return df.withColumn("slot", slot(F.col("ts"), kind, minutes))


def _or_all_phases(rows: DataFrame, panel: DataFrame, samples: int) -> DataFrame:
    """``rows`` with ``samples``; a row without an earlier value of its phase takes the newest values before its origin of
    its series whatever their phase, and 0 where its series has none: no row to forecast is lost.

    Only the origins of such rows are looked up, by a join on the series' rows right before them.
    """
    # one row per series and origin that needs it, met by the last ``samples`` rows before that origin
    empty = rows.filter(F.size("samples") == 0).select("sid", "origin").distinct()
    wanted = empty.withColumn("idx", F.explode(F.sequence(F.col("origin") - samples, F.col("origin") - 1)))
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("idx", "y"))))
    found = wanted.join(panel.select("sid", "idx", "y"), ["sid", "idx"]).groupBy("sid", "origin").agg(F.transform(newest, lambda r: r["y"]).alias("_any"))
    filled = F.when(F.size("samples") > 0, F.col("samples")).otherwise(F.coalesce("_any", F.array(F.lit(0.0))))
    return rows.join(found, ["sid", "origin"], "left").withColumn("samples", filled).drop("_any")


def seasonal_sampler(panel: DataFrame, rows: DataFrame, period: int, samples: int, horizon: int) -> DataFrame:
    """Samples = the last ``samples`` values of the same phase before the origin, newest first.

    One window over (series, phase) collects a bounded array per row; a forecast row then takes the part
    that lies before its origin.  A series spreads over ``period`` partitions.  Rows with none: :func:`_or_all_phases`.
    """
    reach = -(-horizon // period)
    phase = Window.partitionBy("sid", F.pmod("idx", F.lit(period))).orderBy("idx")
    recent = F.collect_list("y").over(phase.rowsBetween(-(samples + reach - 1), -1))
    history = panel.select("sid", "idx", F.reverse(recent).alias("_recent"))
    skip = F.floor((F.col("h") - 1) / period).cast("int") + 1
    joined = rows.join(history, ["sid", "idx"])
    return _or_all_phases(joined.withColumn("samples", F.slice("_recent", skip, samples)).drop("_recent"), panel, samples)


def seasonal_forecast(panel: DataFrame, spec: Rolling, period: int, samples: int, last: Column | int | None = None) -> DataFrame:
    """:func:`seasonal_sampler` for all rows of a rolling backtest, in a single pass over the panel.

    History that no forecast row can reach is left out before anything is sorted.
    """
    reach = -(-spec.horizon // period)
    end = last_index(panel) if last is None else (last if isinstance(last, Column) else F.lit(last))
    span = spec.horizon + (spec.windows - 1) * spec.step + (samples + reach) * period
    panel = panel.filter(F.col("idx") > end - F.lit(span))
    phase = Window.partitionBy("sid", F.pmod("idx", F.lit(period))).orderBy("idx")
    recent = F.reverse(F.collect_list("y").over(phase.rowsBetween(-(samples + reach - 1), -1)))
    rows = forecast_rows(panel.withColumn("_recent", recent), spec, end)
    skip = F.floor((F.col("h") - 1) / period).cast("int") + 1
    return _or_all_phases(rows.withColumn("samples", F.slice("_recent", skip, samples)).drop("_recent"), panel, samples)


def explode_samples(forecast: DataFrame) -> DataFrame:
    """Long sample forecast ``(sid, origin, h, ts, sample_id, y_hat)``."""
    return forecast.select("sid", "origin", "h", "ts", F.posexplode("samples").alias("sample_id", "y_hat"))


# --- parameters ---------------------------------------------------------------------------------


def nb_moments(panel: DataFrame, keys=("sid", "slot"), value: str = "y") -> DataFrame:
    """Mean, variance and negative-binomial shape per cell."""
    cell = panel.groupBy(*keys).agg(F.avg(value).alias("mu"), F.var_samp(value).alias("var"), F.count("*").alias("n"))
    return cell.withColumn("shape", nb_shape(F.col("mu"), F.col("var")))


def with_cells(rows: DataFrame, cells: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``mu`` and ``shape`` of their (keys, slot) cell, for :func:`nb_samples`.

    ``cells`` and ``whole`` are the moments per (keys, slot) and per keys.  A cell without training rows takes the
    moments of all slots together, and mean 0 where there are none at all, so no row to forecast is lost.
    """
    both = F.struct("mu", "shape")
    cell = cells.select(*keys, "slot", both.alias("_cell"))
    pooled = whole.select(*keys, both.alias("_whole"))
    joined = rows.join(cell, [*keys, "slot"], "left")
    joined = joined.join(pooled, keys, "left") if keys else joined.withColumn("_whole", pooled.scalar())
    chosen = F.when(F.col("_cell.mu").isNotNull(), F.col("_cell")).otherwise(F.col("_whole"))
    return joined.withColumn("_c", chosen).withColumns(
        {"mu": F.coalesce("_c.mu", F.lit(0.0)), "shape": F.col("_c.shape")}
    ).drop("_cell", "_whole", "_c")


def gaussian_moments(panel: DataFrame, keys=("sid", "slot"), value: str = "y") -> DataFrame:
    return panel.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))


def with_total(panel: DataFrame) -> DataFrame:
    """Panel rows with their step's cross-series total.  A join on the step, not a window over it: a step
    with very many series is pre-aggregated and never gathered."""
    return panel.join(totals(panel).select("idx", "total"), "idx")


def dirichlet_tables(panel: DataFrame) -> dict[str, DataFrame]:
    """Concentrations from mean and variance of the series' shares of the total: per slot, and over all slots.

    alpha0 = sum m(1-m) / sum v - 1 over the series of a slot, alpha = alpha0 * m, floored so that a series
    unseen in a slot keeps a positive weight.  Steps with total 0 have no shares and are left out.
    """
    share = with_total(panel).filter("total != 0").withColumn("share", F.col("y") / F.col("total"))

    cell = materialise(share.groupBy("slot", "sid").agg(F.avg("share").alias("m"), F.var_samp("share").alias("v"), F.count("*").alias("n")), "shares")
    # moments over all slots from those of the cells: squares within plus squares between
    sums = cell.groupBy("sid").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"),
        F.sum(F.col("n") * F.col("m") * F.col("m") + (F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("_q"),
    )
    spread = safe_div(F.col("_q") - F.col("n") * F.col("m") * F.col("m"), (F.col("n") - 1).cast("double"))
    over_slots = sums.withColumn("v", F.greatest(spread, F.lit(0.0)))

    def alphas(moments: DataFrame, *by: str) -> DataFrame:
        pooled = moments.groupBy(*by).agg(
            (safe_div(F.sum(F.col("m") * (1.0 - F.col("m"))), F.sum("v")) - 1.0).alias("_a")
        )
        alpha0 = F.least(F.greatest(F.coalesce(F.col("_a"), F.lit(ALPHA_TOTAL_LIMIT)), F.lit(ALPHA_FLOOR)), F.lit(ALPHA_TOTAL_LIMIT))
        both = moments.join(pooled, list(by)) if by else moments.withColumn("_a", pooled.scalar())
        return both.select(*by, "sid", F.greatest(alpha0 * F.col("m"), F.lit(ALPHA_FLOOR)).alias("alpha"))

    return {"alphas": alphas(cell, "slot"), "series_alphas": alphas(over_slots)}


def fill_alphas(cells: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``(slot, sid, alpha)`` of the distinct ``cells`` (slot, sid): the cell's own, the series' over all slots, or 1."""
    whole = tables["series_alphas"].select("sid", F.col("alpha").alias("_whole"))
    filled = cells.join(tables["alphas"], ["slot", "sid"], "left").join(whole, "sid", "left")
    return filled.select("slot", "sid", F.coalesce("alpha", "_whole", F.lit(1.0)).alias("alpha"))


def dirichlet_moments(panel: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Concentrations ``(slot, sid, alpha)`` of the panel's cells, or of the distinct ``cells`` (slot, sid), by :func:`dirichlet_tables`.

    A cell of a slot without a total takes the concentration of all slots together, and 1 where no step has a total.
    """
    return fill_alphas(panel.select("slot", "sid").distinct() if cells is None else cells, dirichlet_tables(panel))


DIRICHLET_ROUNDS = 40
DIRICHLET_TOLERANCE = 1e-7
DIRICHLET_FLAT = 1e9  # total concentration from which the derivatives are rounding: the multinomial limit, left as it is


def dirichlet_likelihood(panel: DataFrame, rounds: int = DIRICHLET_ROUNDS, tolerance: float = DIRICHLET_TOLERANCE) -> DataFrame:
    """Concentrations ``(slot, sid, alpha)`` that make the splits of the panel's totals likeliest, slot by slot.

    Newton's method from the moment estimate: the second derivatives of the Dirichlet-multinomial log-likelihood are a
    diagonal and a constant, so a round needs grouped sums by series and by slot only, of how often each count and
    each total occurs.  A step stays within a factor of 4; an ``alpha`` between ``ALPHA_FLOOR`` and
    ``ALPHA_TOTAL_LIMIT``.  Slots without a total have no rows; a series without a count in a slot falls to the floor;
    shares that do not vary drive the whole slot beyond ``DIRICHLET_FLAT``, where it stays.
    It ends when no ``alpha`` moves by more than ``tolerance`` of itself.
    """
    seen = with_total(panel).filter("total > 0")
    items = materialise(seen.groupBy("slot", "sid", "y").agg(F.count("*").alias("c")), "counts")
    totals_ = materialise(seen.select("slot", "idx", "total").distinct().groupBy("slot", "total").agg(F.count("*").alias("c")), "totals")
    slots = totals_.select("slot").distinct()
    alpha = materialise(dirichlet_moments(panel).join(slots, "slot", "left_semi"), "alpha")
    for _ in range(rounds):
        whole = alpha.groupBy("slot").agg(F.sum("alpha").alias("_a"))
        by_slot = totals_.join(whole, "slot").groupBy("slot", "_a").agg(
            F.sum(F.col("c") * digamma_rise(F.col("total"), F.col("_a"))).alias("_g0"), F.sum(-F.col("c") * trigamma_rise(F.col("total"), F.col("_a"))).alias("_z"))
        by_item = items.join(alpha, ["slot", "sid"]).groupBy("slot", "sid", "alpha").agg(
            F.sum(F.col("c") * digamma_rise(F.col("y"), F.col("alpha"))).alias("_g1"), F.sum(F.col("c") * trigamma_rise(F.col("y"), F.col("alpha"))).alias("_q"))
        both = materialise(by_item.join(by_slot, "slot").withColumn("_g", F.col("_g1") - F.col("_g0")), "slopes")
        # a series without counts bends by 0: it only ever falls, to the floor
        bent = both.filter("_q < 0").groupBy("slot").agg(
            (F.sum(F.col("_g") / F.col("_q")) / (1.0 / F.first("_z") + F.sum(1.0 / F.col("_q")))).alias("_b"))
        moved = F.when(F.col("_q") < 0, F.col("alpha") - (F.col("_g") - F.coalesce("_b", F.lit(0.0))) / F.col("_q")).otherwise(0.0)
        near = F.when(F.col("_a") >= DIRICHLET_FLAT, F.col("alpha")).otherwise(F.least(F.greatest(moved, F.col("alpha") / 4), F.col("alpha") * 4))
        step = both.join(bent, "slot", "left").select(
            "slot", "sid", F.col("alpha").alias("_old"), F.least(F.greatest(near, F.lit(ALPHA_FLOOR)), F.lit(ALPHA_TOTAL_LIMIT)).alias("alpha"))
        step = materialise(step, "alpha")
        change = step.agg(F.max(F.abs(F.col("alpha") / F.col("_old") - 1.0))).first()[0]
        alpha = step.drop("_old")
        if change is None or change < tolerance:
            break
    return alpha


# --- forecasters --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """What a forecaster needs besides the data."""

    rolling: Rolling = Rolling()
    samples: int = 100
    seed: str = "0"
    slot_kind: str = "hour"
    minutes: int = 15
    context: int = 96
    rank: int = 10
    conditioning: int = 100
    last: int | None = None
    lags: tuple[int, ...] = (1, 2, 96)  # of the recursive model
    covariates: tuple[str, ...] = ()  # panel columns known for the horizon, of the conditional count model
    hook: Callable[[DataFrame], DataFrame] | None = None


def _parts(panel: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    cells = with_slot(panel, s.slot_kind, s.minutes)
    return train_rows(cells, s.rolling, s.last), forecast_rows(cells, s.rolling, s.last)


def _finish(forecast: DataFrame, s: Settings) -> DataFrame:
    out = forecast.select("sid", "roll", "origin", "h", "ts", "idx", "y", "samples")
    return s.hook(out) if s.hook else out


def origin_scale(panel: DataFrame, s: Settings) -> DataFrame:
    """Mean absolute value of the context before each origin: ``(sid, roll, scale)``."""
    rows = context_rows(panel, s.rolling, s.context, s.last)
    return rows.groupBy("sid", "roll").agg(F.greatest(F.avg(F.abs("y")), F.lit(MINIMUM_SCALE)).alias("scale"))


def _moment_tables(train: DataFrame, columns: dict[str, Column], value: str = "y") -> dict[str, DataFrame]:
    """Aggregates per (sid, slot), and per sid with the series' ``level``."""
    named = [c.alias(k) for k, c in columns.items()]
    level = F.greatest(F.avg(F.abs(value)), F.lit(MINIMUM_SCALE)).alias("level")
    return {"cells": train.groupBy("sid", "slot").agg(*named), "series": train.groupBy("sid").agg(*named, level)}


def _with_tables(rows: DataFrame, tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """``rows`` with the aggregates of their (sid, slot) cell; a missing one is the series', then 0; and with ``_level``."""
    whole = tables["series"].select("sid", *[F.col(n).alias(f"_whole_{n}") for n in names], F.col("level").alias("_level"))
    joined = rows.join(tables["cells"].select("sid", "slot", *names), ["sid", "slot"], "left").join(whole, "sid", "left")
    filled = joined.withColumns({n: F.coalesce(n, f"_whole_{n}", F.lit(0.0)) for n in names})
    return filled.drop(*[f"_whole_{n}" for n in names])


def _level_factor(rows: DataFrame, panel: DataFrame, s: Settings, scaled: bool) -> DataFrame:
    """``_f``: how much higher the context before the origin lies than the series' ``_level``; 1 without either or unless ``scaled``."""
    if not scaled:
        return rows.withColumn("_f", F.lit(1.0)).drop("_level")
    joined = rows.join(origin_scale(panel, s), ["sid", "roll"], "left")
    return joined.withColumn("_f", F.coalesce(F.col("scale") / F.col("_level"), F.lit(1.0))).drop("scale", "_level")


def nb_series_fit(panel: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Moments of every series and slot, and of every series."""
    train, _ = _parts(panel, s)
    names = ["mu", "shape"]
    return {"cells": nb_moments(train).select("sid", "slot", *names), "series": nb_moments(train, ["sid"]).select("sid", *names)}


def nb_series_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    _, rows = _parts(panel, s)
    drawn = nb_samples(with_cells(rows, tables["cells"], tables["series"], ["sid"]), s.samples, s.seed, ["sid", "origin", "h"])
    return _finish(drawn, s)


def nb_series(panel: DataFrame, s: Settings) -> DataFrame:
    """Independent negative binomial per series and slot."""
    return nb_series_predict(panel, nb_series_fit(panel, s), s)


def _lagged(panel: DataFrame, s: Settings) -> DataFrame:
    return lag_features(panel, [s.rolling.horizon]).withColumnRenamed(f"lag_{s.rolling.horizon}", "_x")


def lag_linear_fit(panel: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Least squares of a value on the one a horizon earlier over all series, and each series' spread around the line."""
    train = train_rows(_lagged(panel, s), s.rolling, s.last).filter("_x IS NOT NULL")
    line = materialise(train.agg(F.regr_intercept("y", "_x").alias("intercept"), F.regr_slope("y", "_x").alias("slope")), "line")
    one = line.select(F.struct("*")).scalar()
    left = train.withColumn("_l", one).withColumn("_e", F.col("y") - F.col("_l.intercept") - F.col("_l.slope") * F.col("_x"))
    return {"line": line, "spread": left.groupBy("sid").agg(F.stddev_samp("_e").alias("sd"))}


def lag_linear_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    """All steps of a horizon at once: the value a horizon earlier is known at the origin for each of them.

    A series the fit has not seen has spread 0; a row without that earlier value takes the intercept alone.
    """
    rows = forecast_rows(_lagged(panel, s), s.rolling, s.last).withColumn("_l", tables["line"].select(F.struct("*")).scalar())
    ready = rows.join(tables["spread"], "sid", "left")
    mean = F.col("_l.intercept") + F.coalesce(F.col("_l.slope") * F.col("_x"), F.lit(0.0))
    return _finish(ready.withColumn("samples", _normal_array(mean, F.coalesce("sd", F.lit(0.0)), s)), s)


def lag_linear(panel: DataFrame, s: Settings) -> DataFrame:
    """Direct multi-step forecast from the lag of one horizon."""
    return lag_linear_predict(panel, lag_linear_fit(panel, s), s)


def normal_equations(rows: DataFrame, inputs: list[Column], target: Column, weight: Column | None = None, more: dict[str, Column] | None = None):
    """Weighted sums of products of inputs, and of inputs with the target, in one aggregation; with the sums ``more``.

    Only numbers as many as the square of the inputs come to the driver.  Rows with a NULL input or target do not count.
    """
    width = len(inputs)
    names = [f"_x{i}" for i in range(width)]
    ready = rows.select(*[c.cast("double").alias(n) for c, n in zip(inputs, names)], target.cast("double").alias("_t"),
                        (F.lit(1.0) if weight is None else weight).alias("_w"), *[c.alias(k) for k, c in (more or {}).items()]).dropna(subset=[*names, "_t"])
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])) for i, j in pairs] + [F.sum(F.col("_w") * F.col(n) * F.col("_t")) for n in names]
    row = ready.agg(*sums, *[F.sum(k) for k in (more or {})], F.count("*")).first()
    gram = np.zeros((width, width))
    for (i, j), value in zip(pairs, row):
        gram[i, j] = gram[j, i] = value or 0.0
    rest = [v or 0.0 for v in row[len(pairs) :]]
    return gram, np.array(rest[:width]), dict(zip(more or {}, rest[width:-1])), rest[-1]


def _fitted(coefficients: Column, inputs: list[Column]) -> Column:
    return sum((coefficients[i] * c for i, c in enumerate(inputs)), F.lit(0.0))


def lag_recursive_fit(panel: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Least squares of a value on its own lags over all series, and each series' spread around it."""
    lags = check_lags(s.lags)
    names = [F.col(f"lag_{k}") for k in lags]
    train = train_rows(lag_features(panel, lags), s.rolling, s.last).dropna(subset=[f"lag_{k}" for k in lags])
    gram, moment, _, _ = normal_equations(train, [F.lit(1.0), *names], F.col("y"))
    found = np.linalg.lstsq(gram, moment, rcond=None)[0]
    line = panel.sparkSession.createDataFrame([([float(v) for v in found],)], "coefficients array<double>")
    left = train.withColumn("_e", F.col("y") - _fitted(F.array(*map(F.lit, map(float, found))), [F.lit(1.0), *names]))
    return {"line": line, "spread": left.groupBy("sid").agg(F.stddev_samp("_e").alias("sd"))}


def lag_recursive_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    """Paths rolled forward: a forecast value enters the lags of the steps after it, with keyed noise at every step.

    One row per (series, origin, sample) folds over the horizon with the path as its state; it starts from the last
    values before the origin, as many as the longest lag.  Steps before a series begins count as 0; a series the fit
    has not seen has spread 0.
    """
    lags, horizon = check_lags(s.lags), s.rolling.horizon
    longest = max(lags)
    rows = forecast_rows(panel, s.rolling, s.last)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "y"))), lambda z: F.coalesce(z["y"], F.lit(0.0)))
    history = context_rows(panel, s.rolling, longest, s.last).groupBy("sid", "roll").agg(ordered.alias("_y"))
    starts = rows.select("sid", "roll", "origin").distinct().join(history, ["sid", "roll"], "left").join(tables["spread"], "sid", "left")
    known = F.coalesce("_y", F.array().cast("array<double>"))
    ready = starts.select(
        "sid", "roll", "origin", F.coalesce("sd", F.lit(0.0)).alias("sd"), F.concat(F.array_repeat(F.lit(0.0), F.lit(longest) - F.size(known)), known).alias("_start"),
    ).withColumn("_c", tables["line"].select("coefficients").scalar()).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(s.samples - 1))))

    def forward(path: Column, h: Column) -> Column:
        mean = _fitted(F.col("_c"), [F.lit(1.0), *[F.element_at(path, -k) for k in lags]])
        return F.concat(path, F.array(mean + F.col("sd") * hash_normal(s.seed, F.col("sid"), F.col("origin"), h, F.col("_i"))))

    walked = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_start"), forward), longest + 1, horizon)
    paths = ready.select("sid", "roll", "_i", walked.alias("_path"))
    gathered = paths.groupBy("sid", "roll").agg(F.array_sort(F.collect_list(F.struct("_i", "_path"))).alias("_p"))
    turned = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.transform("_p", lambda p: p["_path"][h]))
    by_step = gathered.select("sid", "roll", F.posexplode(turned).alias("_h", "samples"))
    return _finish(rows.join(by_step.withColumn("h", F.col("_h") + 1).drop("_h"), ["sid", "roll", "h"]), s)


def lag_recursive(panel: DataFrame, s: Settings) -> DataFrame:
    """Recursive multi-step forecast from the series' own lags."""
    return lag_recursive_predict(panel, lag_recursive_fit(panel, s), s)


def origin_moments(panel: DataFrame, s: Settings, keys: tuple[str, ...] = ("sid", "slot"), value: str = "y") -> DataFrame:
    """``(keys, roll, n, mu, var)``: moments of all rows before each origin, in one pass over the panel.

    A row belongs to the history of all windows up to some number; sums are taken per that number and then repeated for
    the few windows up to it, so rows of the panel are never repeated.
    """
    end = last_index(panel) if s.last is None else F.lit(s.last)
    newest = end - F.lit(s.rolling.horizon - 1)
    room = F.floor((newest - F.lit(s.rolling.test_start)) / F.lit(s.rolling.step))
    upto = F.least(F.ceil((newest - F.col("idx")) / F.lit(s.rolling.step)) - 1, F.lit(s.rolling.windows - 1).cast("long"), room)
    part = panel.withColumn("_r", upto).filter(F.col("_r") >= 0).groupBy(*keys, "_r").agg(
        F.count(value).alias("n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    each = part.withColumn("roll", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r"))))
    whole = each.groupBy(*keys, "roll").agg(*[F.sum(c).alias(c) for c in ("n", "_s", "_q")])
    mean = safe_div(F.col("_s"), F.col("n").cast("double"))
    spread = safe_div(F.col("_q") - F.col("_s") * mean, (F.col("n") - 1).cast("double"))
    return whole.select(*keys, "roll", "n", mean.alias("mu"), F.greatest(spread, F.lit(0.0)).alias("var"))


def nb_refit_fit(panel: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Moments of every origin's history, per (sid, slot) and per sid."""
    cells = with_slot(panel, s.slot_kind, s.minutes)
    keyed = {"cells": ("sid", "slot"), "series": ("sid",)}
    return {name: origin_moments(cells, s, k).withColumn("shape", nb_shape(F.col("mu"), F.col("var"))) for name, k in keyed.items()}


def nb_refit_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    _, rows = _parts(panel, s)
    ready = with_cells(rows, tables["cells"], tables["series"], ["sid", "roll"])
    return _finish(nb_samples(ready, s.samples, s.seed, ["sid", "origin", "h"]), s)


def nb_refit(panel: DataFrame, s: Settings) -> DataFrame:
    """:func:`nb_series` whose moments are those of each origin's own history."""
    return nb_refit_predict(panel, nb_refit_fit(panel, s), s)


def gauss_refit_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    _, rows = _parts(panel, s)
    pooled = tables["series"].select("sid", "roll", F.col("mu").alias("_mu"), F.sqrt("var").alias("_sd"))
    ready = rows.join(tables["cells"].select("sid", "slot", "roll", "mu", F.sqrt("var").alias("sd")), ["sid", "slot", "roll"], "left").join(pooled, ["sid", "roll"], "left")
    mean, sd = (F.coalesce(c, f"_{c}", F.lit(0.0)) for c in ("mu", "sd"))
    return _finish(ready.withColumn("samples", _normal_array(mean, sd, s)), s)


def gauss_refit(panel: DataFrame, s: Settings) -> DataFrame:
    """:func:`gauss_independent` whose moments are those of each origin's own history."""
    return gauss_refit_predict(panel, nb_refit_fit(panel, s), s)


COUNT_ROUNDS = 60
LOG_SHAPE_BOUNDS = (-7.0, 14.0)  # beyond the upper one counts are as good as Poisson
MOST_LOG_MEAN = 30.0


def nb_regression(train: DataFrame, inputs: list[Column], target: Column, rounds: int = COUNT_ROUNDS, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Coefficients of the log-mean and the log of the shape of counts given their inputs, by maximum likelihood.

    Fisher scoring: every round is one aggregation, of the weighted normal equations at the last coefficients and of
    the first two derivatives by the shape, and a small solve on the driver.  It ends when nothing moves by more
    than ``tolerance``.  Counts without over-dispersion drive the shape to its upper bound, the Poisson limit.
    """
    ready = materialise(train.select(*[c.cast("double").alias(f"i{n}") for n, c in enumerate(inputs)], target.cast("double").alias("y")).dropna(), "regression")
    mean, variance = ready.agg(F.avg("y"), F.var_samp("y")).first()
    beta = np.zeros(len(inputs))
    beta[0] = np.log(max(mean or 0.0, 1e-6))
    theta = float(np.clip(np.log(mean * mean / (variance - mean)), *LOG_SHAPE_BOUNDS)) if mean and variance and variance > mean else LOG_SHAPE_BOUNDS[1]
    columns = [F.col(f"i{n}") for n in range(len(inputs))]
    for _ in range(rounds):
        r = float(np.exp(theta))
        eta = F.least(sum((float(b) * c for b, c in zip(beta, columns)), F.lit(0.0)), F.lit(MOST_LOG_MEAN))
        at = ready.withColumn("_eta", eta).withColumn("_m", F.exp("_eta"))
        y, m, shape = F.col("y"), F.col("_m"), F.lit(r)
        slope = digamma(y + r) - digamma(shape) + F.log(shape / (shape + m)) + 1.0 - (y + r) / (shape + m)
        bend = trigamma(y + r) - trigamma(shape) + 1.0 / r - 2.0 / (shape + m) + (y + r) / ((shape + m) * (shape + m))
        gram, moment, sums, n = normal_equations(
            at, columns, F.col("_eta") + (y - m) / m, m * r / (r + m), {"slope": slope, "bend": bend})
        if not n:
            break
        new = np.linalg.lstsq(gram, moment, rcond=None)[0]
        step = sums["slope"] / (abs(sums["bend"]) * r) if sums["bend"] else 0.0
        moved = max(np.abs(new - beta).max(), abs(step))
        beta, theta = new, float(np.clip(theta + np.clip(step, -1.0, 1.0), *LOG_SHAPE_BOUNDS))
        if moved < tolerance:
            break
    return beta, theta


def _count_inputs(s: Settings) -> list[Column]:
    return [F.lit(1.0), F.log1p("_x"), *[F.col(c) for c in s.covariates]]


def nb_lagged_fit(panel: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Log-mean of a count given the one a horizon earlier and covariates, and its shape, over all series."""
    train = train_rows(_lagged(panel, s), s.rolling, s.last)
    beta, theta = nb_regression(train, _count_inputs(s), F.col("y"))
    return {"line": panel.sparkSession.createDataFrame([([float(b) for b in beta], float(theta))], "coefficients array<double>, log_shape double")}


def nb_lagged_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    """Negative binomials conditional on lag and covariates; a row without one of them takes it as 0."""
    rows = forecast_rows(_lagged(panel, s), s.rolling, s.last).withColumn("_l", tables["line"].select(F.struct("*")).scalar())
    eta = _fitted(F.col("_l.coefficients"), [F.coalesce(c, F.lit(0.0)) for c in _count_inputs(s)])
    ready = rows.withColumn("mu", F.exp(F.least(eta, F.lit(MOST_LOG_MEAN)))).withColumn("shape", F.exp("_l.log_shape"))
    return _finish(nb_samples(ready, s.samples, s.seed, ["sid", "origin", "h"]), s)


def nb_lagged(panel: DataFrame, s: Settings) -> DataFrame:
    """Conditional count model: direct forecasts whose mean follows lag and covariates."""
    return nb_lagged_predict(panel, nb_lagged_fit(panel, s), s)


def nb_share_fit(panel: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Moments of the total per slot and over all, and concentrations of the shares per slot and over all."""
    train, _ = _parts(panel, s)
    total = with_slot(totals(train), s.slot_kind, s.minutes)
    names = ["mu", "shape"]
    return {"slots": nb_moments(total, ["slot"], "total").select("slot", *names), "whole": nb_moments(total, [], "total").select(*names), **dirichlet_tables(train)}


def nb_share_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    _, rows = _parts(panel, s)
    steps = rows.select("roll", "origin", "h", "idx", "slot").distinct()
    drawn = nb_samples(with_cells(steps, tables["slots"], tables["whole"], []), s.samples, s.seed, ["origin", "h"], at_least_one=True)
    totals_drawn = drawn.select("origin", "h", "slot", F.col("samples").alias("counts"))
    split = dm_split(totals_drawn, fill_alphas(rows.select("slot", "sid").distinct(), tables), ["origin", "h"], "slot", s.seed)
    return _finish(rows.join(split.select("sid", "origin", "h", F.col("counts").alias("samples")), ["sid", "origin", "h"]), s)


def nb_share(panel: DataFrame, s: Settings) -> DataFrame:
    """Negative binomial for the total, Dirichlet-multinomial split over the series (the headline model)."""
    return nb_share_predict(panel, nb_share_fit(panel, s), s)


def _normal_array(mean: Column, sd: Column, s: Settings) -> Column:
    ids = F.sequence(F.lit(0), F.lit(s.samples - 1))
    return F.transform(ids, lambda i: mean + sd * hash_normal(s.seed, F.col("sid"), F.col("origin"), F.col("h"), i))


def gauss_fit(panel: DataFrame, s: Settings) -> dict[str, DataFrame]:
    train, _ = _parts(panel, s)
    return _moment_tables(train, {"mu": F.avg("y"), "sd": F.stddev_samp("y")})


def gauss_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings, scaled: bool = False) -> DataFrame:
    _, rows = _parts(panel, s)
    ready = _level_factor(_with_tables(rows, tables, ["mu", "sd"]), panel, s, scaled)
    return _finish(ready.withColumn("samples", _normal_array(F.col("mu") * F.col("_f"), F.col("sd") * F.col("_f"), s)), s)


def gauss_independent(panel: DataFrame, s: Settings, scaled: bool = False) -> DataFrame:
    """Independent normal per series and slot; ``scaled`` follows the level of the context before the origin."""
    return gauss_predict(panel, gauss_fit(panel, s), s, scaled)


def _dependence(train: DataFrame, s: Settings, value: str, full: bool = False) -> DataFrame:
    """``(sid, loadings, diag)`` of the residual dependence between series."""
    loadings, diag = factor_model(train, 10**9 if full else s.rank, value)
    return loadings.join(diag, "sid")


def _with_dependence(rows: DataFrame, dependence: DataFrame, s: Settings) -> DataFrame:
    """Rows with loadings, diagonal and their step's normals; a series the dependence was not fitted on varies by nothing."""
    none = {"loadings": F.array().cast("array<double>"), "diag": F.lit(0.0)}
    known = rows.join(dependence, "sid", "left").withColumns({k: F.coalesce(F.col(k), v) for k, v in none.items()})
    return with_step_normals(known, s.samples, s.seed, ["origin", "h"])


def gauss_factors_fit(panel: DataFrame, s: Settings, full: bool = False) -> dict[str, DataFrame]:
    """Slot means, and loadings and diagonal of the residuals."""
    train, _ = _parts(panel, s)
    tables = _moment_tables(train, {"mu": F.avg("y")})
    residual = train.join(tables["cells"], ["sid", "slot"]).withColumn("e", F.col("y") - F.col("mu"))
    return {**tables, "loadings": _dependence(residual, s, "e", full)}


def gauss_factors_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings, scaled: bool = False) -> DataFrame:
    _, rows = _parts(panel, s)
    ready = _with_dependence(_level_factor(_with_tables(rows, tables, ["mu"]), panel, s, scaled), tables["loadings"], s)
    noise = factor_noise(s.samples, s.seed, ["origin", "h"])
    return _finish(ready.withColumn("samples", F.transform(noise, lambda e: (F.col("mu") + e) * F.col("_f"))), s)


def gauss_factors(panel: DataFrame, s: Settings, full: bool = False, scaled: bool = False) -> DataFrame:
    """Slot means plus jointly normal residuals, full rank or ``rank`` factors and a diagonal."""
    return gauss_factors_predict(panel, gauss_factors_fit(panel, s, full), s, scaled)


def copula_fit(panel: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Recent values of every series, slot means of their normal scores, and the scores' dependence."""
    train, _ = _parts(panel, s)
    recent = sorted_recent(train, s.conditioning)
    scores = to_gaussian(train, recent, s.conditioning)
    tables = _moment_tables(scores, {"mu": F.avg("z")}, "z")
    residual = scores.join(tables["cells"], ["sid", "slot"]).withColumn("e", F.col("z") - F.col("mu"))
    return {**tables, "recent": recent, "loadings": _dependence(residual, s, "e")}


def copula_predict(panel: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    _, rows = _parts(panel, s)
    ready = _with_dependence(_with_tables(rows, tables, ["mu"]).drop("_level").join(tables["recent"], "sid", "left"), tables["loadings"], s)
    noise = factor_noise(s.samples, s.seed, ["origin", "h"])
    values = F.transform(noise, lambda e: empirical_quantile(F.col("recent"), F.col("mu") + e))
    return _finish(ready.withColumn("samples", values), s)


def copula(panel: DataFrame, s: Settings) -> DataFrame:
    """Gaussian copula: empirical margins of the recent values, low-rank dependence of their normal scores."""
    return copula_predict(panel, copula_fit(panel, s), s)


def forecast(model: str, panel: DataFrame, s: Settings) -> DataFrame:
    """Forecast with a registered model.

    A forecaster reads the panel for its fit, its rows, its totals and its scales, so the panel is written
    once instead of being rebuilt from raw events each time.
    """
    return MODELS[model](materialise(panel), s)


MODELS: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {
    "nb_share": nb_share,
    "nb_series": nb_series,
    "lag_linear": lag_linear,
    "lag_recursive": lag_recursive,
    "nb_lagged": nb_lagged,
    "nb_refit": nb_refit,
    "gauss_refit": gauss_refit,
    "gauss": gauss_independent,
    "gauss_scaled": lambda p, s: gauss_independent(p, s, scaled=True),
    "gauss_full": lambda p, s: gauss_factors(p, s, full=True),
    "gauss_full_scaled": lambda p, s: gauss_factors(p, s, full=True, scaled=True),
    "gauss_lowrank": gauss_factors,
    "gauss_lowrank_scaled": lambda p, s: gauss_factors(p, s, scaled=True),
    "copula": copula,
}


# forecasters whose fit is a set of tables that can be saved (:func:`tallycast.sources.writers.save_parameters`), loaded and used later
FITTED: dict[str, tuple[Callable[[DataFrame, Settings], dict[str, DataFrame]], Callable[..., DataFrame]]] = {
    "nb_series": (nb_series_fit, nb_series_predict),
    "lag_linear": (lag_linear_fit, lag_linear_predict),
    "lag_recursive": (lag_recursive_fit, lag_recursive_predict),
    "nb_lagged": (nb_lagged_fit, nb_lagged_predict),
    "nb_share": (nb_share_fit, nb_share_predict),
    "nb_refit": (nb_refit_fit, nb_refit_predict),
    "gauss_refit": (nb_refit_fit, gauss_refit_predict),
    "gauss": (gauss_fit, gauss_predict),
    "gauss_scaled": (gauss_fit, partial(gauss_predict, scaled=True)),
    "gauss_full": (partial(gauss_factors_fit, full=True), gauss_factors_predict),
    "gauss_full_scaled": (partial(gauss_factors_fit, full=True), partial(gauss_factors_predict, scaled=True)),
    "gauss_lowrank": (gauss_factors_fit, gauss_factors_predict),
    "gauss_lowrank_scaled": (gauss_factors_fit, partial(gauss_factors_predict, scaled=True)),
    "copula": (copula_fit, copula_predict),
}


def lag_regression(train: DataFrame, inputs: list[str], label: str = "y", family: str = "gaussian"):
    """Linear or Poisson regression of a value on scaled lags, covariates and static features (MLlib)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression

    assembled = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip").transform(train)
    if family == "gaussian":
        estimator = LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, solver="normal")
    else:
        estimator = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol=label, maxIter=25)
    return estimator.fit(assembled), assembled

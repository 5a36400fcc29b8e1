"""Rolling backtests, metrics, scenarios, sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallycast.catalog.registry import PER_DAY, STEP, events, last, panel, props_key, query, rd, rounded, sql_cdf, sql_panel, SQL_K
from tallycast.operators.panel import series_codes
from tallycast.plans import backtest as B
from tallycast.plans import forecast as M
from tallycast.plans import metrics as E
from tallycast.plans import sweep as S
from tallycast.session import materialise, scratch_path
from tallycast.sources.writers import write_forecast, write_metrics

P15 = sql_panel()
START = 24 * PER_DAY
SPEC = B.Rolling(horizon=PER_DAY, step=PER_DAY, windows=6, test_start=START)
FAR = B.Rolling(horizon=2 * PER_DAY, step=PER_DAY, windows=9, test_start=START)
SAMPLES = 7  # odd: means are not short decimals, so rounding for comparison meets no ties


def sql_forecast(spec: B.Rolling = SPEC, samples: int = SAMPLES) -> str:
    """CTEs down to ``fc``: one row per forecast value with its sample list, newest season first."""
    return f"""{P15}, e AS (SELECT max(idx) AS b FROM panel),
  rolls AS (SELECT w AS roll, b - {spec.horizon - 1} - {spec.step} * w AS origin FROM e, range({spec.windows}) r(w)
    WHERE b - {spec.horizon - 1} - {spec.step} * w >= {spec.test_start}),
  fr AS (SELECT p.sid, r.roll, r.origin, CAST(p.idx - r.origin + 1 AS INTEGER) AS h, p.ts, p.idx, p.y FROM panel p
    JOIN rolls r ON p.idx BETWEEN r.origin AND r.origin + {spec.horizon - 1}),
  ph AS (SELECT f.*, list(q.y ORDER BY q.idx DESC) FILTER (q.idx IS NOT NULL) AS phased FROM fr f
    CROSS JOIN range({samples}) k(i) LEFT JOIN panel q ON q.sid = f.sid AND q.idx = f.idx - {PER_DAY} * ((f.h - 1) // {PER_DAY} + 1 + k.i) GROUP BY ALL),
  lt AS (SELECT o.sid, o.origin, list(q.y ORDER BY q.idx DESC) AS newest FROM (SELECT DISTINCT sid, origin FROM ph WHERE phased IS NULL) o
    JOIN panel q ON q.sid = o.sid AND q.idx BETWEEN o.origin - {samples} AND o.origin - 1 GROUP BY ALL),
  fc AS (SELECT ph.* EXCLUDE (phased), coalesce(phased, newest, [0.0]) AS samples FROM ph LEFT JOIN lt ON lt.sid = ph.sid AND lt.origin = ph.origin)"""


def sql_q(level: float, ordered: str = "o") -> str:
    return f"{ordered}[CAST(round_even((len({ordered}) - 1) * {level!r}::DOUBLE, 0) AS INTEGER) + 1]"


SQL_LEVELS = "lv AS (SELECT k, k / 20.0::DOUBLE AS q FROM range(1, 20) r(k))"


def sql_scored(source: str = "fc") -> str:
    """CTEs ``sc`` (mean, median, interval) and ``ql`` (loss and coverage by level)."""
    return f"""so AS (SELECT *, list_sort(samples) AS o FROM {source}),
  sc AS (SELECT *, list_avg(samples) AS mean, {sql_q(0.5)} AS med, {sql_q(0.025)} AS lo, {sql_q(0.975)} AS hi FROM so),
  {SQL_LEVELS},
  qr AS (SELECT sc.*, lv.k, lv.q, o[CAST(round_even((len(o) - 1) * q, 0) AS INTEGER) + 1] AS qh FROM sc, lv),
  ql AS (SELECT *, 2.0 * abs((qh - y) * (CASE WHEN y <= qh THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - q)) AS loss, CASE WHEN y < qh THEN 1.0 ELSE 0.0 END AS cov FROM qr)"""


def sql_items(keys: str = "sid, roll", source: str = "fc") -> str:
    return f"""{sql_scored(source)},
  im AS (SELECT {keys}, avg((y - mean) * (y - mean)) AS mse, sum(abs(y - med)) AS abs_error, sum(abs(y)) AS abs_target_sum, avg(abs(y)) AS abs_target_mean,
    avg(abs(y - med) / nullif(abs(y), 0)) AS mape, 2.0 * avg(abs(y - med) / nullif(abs(y) + abs(med), 0)) AS smape, avg(abs(y - med)) AS mae,
    avg(hi - lo + CASE WHEN y < lo THEN 40.0 * (lo - y) ELSE 0 END + CASE WHEN y > hi THEN 40.0 * (y - hi) ELSE 0 END) AS width FROM sc GROUP BY {keys}),
  iq AS (SELECT {keys}, k, q, sum(loss) AS loss, avg(cov) AS cov FROM ql GROUP BY {keys}, k, q)"""


SQL_SEASONAL = f"""df AS (SELECT sid, idx, abs(y - lag(y, {PER_DAY}) OVER (PARTITION BY sid ORDER BY idx)) AS d FROM panel),
  se AS (SELECT df.sid, r.roll, avg(d) AS seasonal_error FROM df JOIN rolls r ON df.idx < r.origin WHERE d IS NOT NULL GROUP BY 1, 2)"""

SQL_AGG = """am AS (SELECT avg(mse) AS mse, sum(abs_error) AS abs_error, sum(abs_target_sum) AS abs_target_sum, avg(abs_target_mean) AS abs_target_mean,
    avg(mape) AS mape, avg(smape) AS smape FROM im),
  aq AS (SELECT k, q, sum(loss) AS loss, avg(cov) AS cov FROM iq GROUP BY 1, 2),
  aw AS (SELECT avg(loss / abs_target_sum) AS crps, avg(loss) AS mean_ql, avg(abs(cov - q)) AS mae_cov FROM aq, am)"""


def forecast(spark, d, spec=SPEC, samples=SAMPLES):
    return M.seasonal_forecast(panel(spark, d), spec, PER_DAY, samples, last(spark, d))


def items(spark, d):
    seasonal = B.seasonal_error(panel(spark, d), SPEC, PER_DAY, last(spark, d))
    return E.item_metrics(E.scored_rows(forecast(spark, d)), seasonal)


def overall(spark, d):
    return E.aggregate_metrics(E.item_metrics(E.scored_rows(forecast(spark, d))))


# --- windows and samples ------------------------------------------------------------------------


@query("rolling_origins", f"""WITH {sql_forecast(FAR)} SELECT sid, roll, origin, min(ts) AS forecast_start, count(*) AS n_forecast, origin AS n_history
FROM fr GROUP BY sid, roll, origin""")
def rolling_origins(spark, d):
    return B.window_sizes(panel(spark, d), FAR, last(spark, d))


@query("train_rows", f"""WITH {sql_forecast()} SELECT sid, count(*) AS n, max(idx) AS last_idx, sum(y) AS total FROM panel
WHERE idx < (SELECT min(origin) FROM rolls) GROUP BY sid""")
def train_rows(spark, d):
    t = B.train_rows(panel(spark, d), SPEC, last(spark, d))
    return t.groupBy("sid").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"), F.sum("y").alias("total"))


@query("context_scale", f"""WITH {sql_forecast()} SELECT p.sid, r.roll, {rd('greatest(avg(abs(p.y)), 1e-10)')} AS scale FROM panel p
JOIN rolls r ON p.idx >= r.origin - 192 AND p.idx < r.origin GROUP BY 1, 2""")
def context_scale(spark, d):
    """Scale of the two days before each origin."""
    rows = B.context_rows(panel(spark, d), SPEC, 2 * PER_DAY, last(spark, d))
    return rounded(rows.groupBy("sid", "roll").agg(F.greatest(F.avg(F.abs("y")), F.lit(1e-10)).alias("scale")), "scale")


@query("seasonal_samples", f"""WITH {sql_forecast()} SELECT sid, origin, h, ts, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS sample_id, unnest(samples) AS y_hat FROM fc""")
def seasonal_samples(spark, d):
    return M.explode_samples(forecast(spark, d))


SHORT = B.Rolling(horizon=2 * PER_DAY, step=60, windows=50, test_start=1)


@query("seasonal_samples_short", f"""WITH {sql_forecast(SHORT, 2)} SELECT sid, origin, h, ts, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS sample_id, unnest(samples) AS y_hat FROM fc""")
def seasonal_samples_short(spark, d):
    """Origins from the first day on: steps without an earlier value of their phase are forecast from the values right before the origin."""
    return M.explode_samples(forecast(spark, d, SHORT, 2))


@query("seasonal_samples_far", f"""WITH {sql_forecast(FAR, 5)} SELECT sid, origin, h, ts, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS sample_id, unnest(samples) AS y_hat FROM fc""")
def seasonal_samples_far(spark, d):
    """Two-day horizon in steps of one day: overlapping windows, and the second day skips a season."""
    return M.explode_samples(forecast(spark, d, FAR, 5))


# --- metrics ------------------------------------------------------------------------------------


@query("sample_quantiles", f"""WITH {sql_forecast()}, {SQL_LEVELS}, so AS (SELECT *, list_sort(samples) AS o FROM fc)
SELECT sid, roll, h, {", ".join(f"{sql_q(k / 20)} AS q{5 * k:02d}" for k in range(1, 20))} FROM so""")
def sample_quantiles(spark, d):
    names = [E.level_name(q) for q in E.LEVELS]
    return E.scored_rows(forecast(spark, d)).select("sid", "roll", "h", *names)


@query("mean_forecast_wide", f"""WITH {sql_forecast()} SELECT roll, h, {", ".join(f"{rd(f'max(list_avg(samples)) FILTER (sid = {s!r})')} AS {s}" for s in ("click", "error", "purchase", "signup", "view"))}
FROM fc GROUP BY 1, 2""")
def mean_forecast_wide(spark, d):
    levels = ["click", "error", "purchase", "signup", "view"]
    return rounded(E.mean_wide(forecast(spark, d), levels), *levels)


@query("quantile_loss", f"WITH {sql_forecast()}, {sql_items()}, {SQL_AGG} SELECT CAST(5 * k AS INTEGER) AS level, {rd('loss')} AS loss, {rd('cov')} AS coverage FROM aq")
def quantile_loss(spark, d):
    """Summed loss and coverage by level."""
    it = E.item_metrics(E.scored_rows(forecast(spark, d)))
    names = [E.level_name(q) for q in E.LEVELS]
    sums = it.agg(*[F.struct(F.lit(round(q * 100)).alias("level"), F.sum(f"ql_{n}").alias("loss"), F.avg(f"cov_{n}").alias("coverage")).alias(n)
                    for n, q in zip(names, E.LEVELS)])
    return rounded(sums.select(F.inline(F.array(*names))), "loss", "coverage")


@query("crps", f"WITH {sql_forecast()}, {sql_items()}, {SQL_AGG} SELECT {rd('crps')} AS crps FROM aw")
def crps(spark, d):
    return rounded(overall(spark, d).select(F.col("CRPS").alias("crps")), "crps")


@query("nd", f"WITH {sql_forecast()}, {sql_items()}, {SQL_AGG} SELECT {rd('abs_error / abs_target_sum')} AS nd FROM am")
def nd(spark, d):
    return rounded(overall(spark, d).select(F.col("ND").alias("nd")), "nd")


@query("mse_nrmse", f"WITH {sql_forecast()}, {sql_items()}, {SQL_AGG} SELECT {rd('mse')} AS mse, {rd('sqrt(mse)')} AS rmse, {rd('sqrt(mse) / abs_target_mean')} AS nrmse FROM am")
def mse_nrmse(spark, d):
    out = overall(spark, d).select(F.col("MSE").alias("mse"), F.col("RMSE").alias("rmse"), F.col("NRMSE").alias("nrmse"))
    return rounded(out, "mse", "rmse", "nrmse")


ITEM = ["mse", "abs_error", "abs_target_sum", "abs_target_mean", "mape", "smape", "nd", "seasonal_error", "mase", "msis"]


@query("item_metrics", f"""WITH {sql_forecast()}, {sql_items()}, {SQL_SEASONAL} SELECT im.sid, im.roll, {", ".join(f"{rd(c)} AS {c}" for c in ITEM[:6])},
{rd('abs_error / nullif(abs_target_sum, 0)')} AS nd, {rd('seasonal_error')} AS seasonal_error, {rd('mae / nullif(seasonal_error, 0)')} AS mase, {rd('width / nullif(seasonal_error, 0)')} AS msis
FROM im LEFT JOIN se ON im.sid = se.sid AND im.roll = se.roll""")
def item_metrics(spark, d):
    it = items(spark, d)
    lower = it.select("sid", "roll", *[F.col(c).alias(c.lower()) for c in it.columns if c.lower() in ITEM])
    return rounded(lower, *ITEM)


@query("extra_metrics", f"""WITH {sql_forecast()}, {sql_items()}, {SQL_SEASONAL}, {SQL_AGG},
x AS (SELECT avg(seasonal_error) AS seasonal_error, avg(mae / nullif(seasonal_error, 0)) AS mase, avg(width / nullif(seasonal_error, 0)) AS msis FROM im JOIN se ON im.sid = se.sid AND im.roll = se.roll)
SELECT {rd('mape')} AS mape, {rd('smape')} AS smape, {rd('mase')} AS mase, {rd('msis')} AS msis, {rd('seasonal_error')} AS seasonal_error, {rd('abs_error')} AS abs_error,
{rd('abs_target_sum')} AS abs_target_sum, {rd('abs_target_mean')} AS abs_target_mean, {rd('mean_ql')} AS mean_absolute_quantileloss, {rd('mae_cov')} AS mae_coverage FROM am, aw, x""")
def extra_metrics(spark, d):
    names = ["MAPE", "sMAPE", "MASE", "MSIS", "seasonal_error", "abs_error", "abs_target_sum", "abs_target_mean", "mean_absolute_QuantileLoss", "MAE_Coverage"]
    out = E.aggregate_metrics(items(spark, d)).select(*[F.col(n).alias(n.lower()) for n in names])
    return rounded(out, *out.columns)


SQL_SUMMED = """lf AS (SELECT roll, origin, h, ts, y, generate_subscripts(samples, 1) AS p, unnest(samples) AS v FROM fc),
  ls AS (SELECT roll, origin, h, ts, p, sum(v) AS v, sum(y) AS y FROM lf GROUP BY 1, 2, 3, 4, 5),
  fs AS (SELECT roll, origin, h, ts, max(y) AS y, list(v ORDER BY p) AS samples FROM ls GROUP BY 1, 2, 3, 4)"""


def summed(spark, d):
    return E.aggregate_metrics(E.item_metrics(E.scored_rows(E.sum_over_series(forecast(spark, d))), keys=["roll"]))


@query("sum_metrics", f"""WITH {sql_forecast()}, {SQL_SUMMED}, {sql_items('roll', 'fs')}, {SQL_AGG}
SELECT {rd('crps')} AS crps_sum, {rd('abs_error / abs_target_sum')} AS nd_sum, {rd('sqrt(mse) / abs_target_mean')} AS nrmse_sum, {rd('mse')} AS mse_sum FROM am, aw""")
def sum_metrics(spark, d):
    """Metrics of the cross-series sum: samples and targets are added first."""
    out = summed(spark, d).select(
        F.col("CRPS").alias("crps_sum"), F.col("ND").alias("nd_sum"), F.col("NRMSE").alias("nrmse_sum"), F.col("MSE").alias("mse_sum"))
    return rounded(out, *out.columns)


def _sql_headline() -> str:
    one = f"SELECT crps, mse FROM (WITH {sql_items()}, {SQL_AGG} SELECT crps, mse FROM am, aw)"
    two = f"SELECT crps, mse FROM (WITH {SQL_SUMMED}, {sql_items('roll', 'fs')}, {SQL_AGG} SELECT crps, mse FROM am, aw)"
    return f"""WITH {sql_forecast()}, x1 AS ({one}), x2 AS ({two})
SELECT 'CRPS' AS metrics, {rd('crps')} AS "values" FROM x1 UNION ALL SELECT 'MSE', {rd('mse')} FROM x1
UNION ALL SELECT 'CRPS-Sum', {rd('crps')} FROM x2 UNION ALL SELECT 'MSE-Sum', {rd('mse')} FROM x2"""


@query("metrics_long", _sql_headline())
def metrics_long(spark, d):
    """The four reported numbers as a two-column table."""
    fc = materialise(forecast(spark, d), "forecast")  # scored twice
    per_series = E.aggregate_metrics(E.item_metrics(E.scored_rows(fc)))
    sums = E.aggregate_metrics(E.item_metrics(E.scored_rows(E.sum_over_series(fc)), keys=["roll"]))
    return rounded(E.headline(per_series, sums), "values")


@query("metrics_settings", f"""WITH {sql_forecast()}, {sql_items()}, {SQL_AGG}
SELECT 'MSE' AS metrics, {rd('mse')} AS "values", 'model=seasonal;rep=0;samples={SAMPLES};season={PER_DAY}' AS settings FROM am UNION ALL
SELECT 'ND', {rd('abs_error / abs_target_sum')}, 'model=seasonal;rep=0;samples={SAMPLES};season={PER_DAY}' FROM am UNION ALL
SELECT 'CRPS', {rd('crps')}, 'model=seasonal;rep=0;samples={SAMPLES};season={PER_DAY}' FROM aw""")
def metrics_settings(spark, d):
    """Metrics with the label of the run's settings."""
    label = S.run_label(model=F.lit("seasonal"), rep=F.lit(0), samples=F.lit(SAMPLES), season=F.lit(PER_DAY))
    long = E.metrics_long(overall(spark, d), names=["MSE", "ND", "CRPS"])
    return rounded(long.withColumn("settings", label), "values")


@query("metrics_store", f"""WITH {sql_forecast()}, {sql_items()}, {SQL_AGG}, m AS (SELECT 'MSE' AS metrics, {rd('mse')} AS "values" FROM am UNION ALL
SELECT 'ND', {rd('abs_error / abs_target_sum')} FROM am UNION ALL SELECT 'CRPS', {rd('crps')} FROM aw)
SELECT metrics, "values" * f AS "values", model, run_id FROM m, (VALUES ('seasonal', 'a', 1.0), ('seasonal', 'b', 2.0), ('other', 'a', 3.0)) r(model, run_id, f)""")
def metrics_store(spark, d):
    """Metrics of several runs in one partitioned table; a run that is stored again replaces its own rows only."""
    path = scratch_path(spark, "metrics")
    found = materialise(rounded(E.metrics_long(overall(spark, d), names=["MSE", "ND", "CRPS"]), "values"))
    for model, run_id, times in (("seasonal", "a", 7.0), ("seasonal", "b", 2.0), ("other", "a", 3.0), ("seasonal", "a", 1.0)):
        write_metrics(found.withColumn("values", F.col("values") * times), path, model, run_id)
    return spark.read.parquet(path)


@query("forecast_dump", f"WITH {sql_forecast()} SELECT sid, origin, h, ts, y, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS sample_id, unnest(samples) AS y_hat, CAST(roll AS INTEGER) AS roll FROM fc WHERE roll < 2")
def forecast_dump(spark, d):
    """Forecasts with their targets written by window; two windows are read back from their folders."""
    path = scratch_path(spark, "forecast")
    write_forecast(forecast(spark, d), path)
    rows = spark.read.parquet(path).filter("roll < 2")
    return rows.select("sid", "origin", "h", "ts", "y", F.posexplode("samples").alias("sample_id", "y_hat"), F.col("roll").cast("int").alias("roll"))


def _sql_bands(levels, source="fc") -> str:
    return f"so AS (SELECT *, list_sort(samples) AS o FROM {source}) SELECT sid, roll, h, ts, y, " + ", ".join(
        f"{sql_q(q)} AS p{round(q * 100):02d}" for q in levels) + " FROM so"


@query("forecast_bands", f"WITH {sql_forecast()}, k AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS code FROM (SELECT DISTINCT sid FROM panel)), "
       f"f3 AS (SELECT fc.* FROM fc JOIN k ON fc.sid = k.sid WHERE k.code < 3), {_sql_bands((0.05, 0.5, 0.95), 'f3')}")
def forecast_bands(spark, d):
    """Bands of the first three series by code, as a plot grid would pick them."""
    codes = series_codes(events(spark, d).select(F.col("event_type").alias("sid"))).filter("code < 3")
    some = panel(spark, d).join(codes, "sid", "left_semi")  # before anything is forecast
    return E.bands(M.seasonal_forecast(some, SPEC, PER_DAY, SAMPLES, last(spark, d)))


@query("interval_percentiles", f"WITH {sql_forecast()}, {_sql_bands((0.05, 0.25, 0.5, 0.75, 0.95))}")
def interval_percentiles(spark, d):
    """50 and 90 percent intervals with the median."""
    return E.bands(forecast(spark, d), E.interval_levels((50.0, 90.0)))


# --- scenarios and sweeps -----------------------------------------------------------------------

SCENARIOS = [
    ("normal1", "2024-01-19 23:45:00"), ("normal2", "2024-01-21 12:00:00"), ("concert1", "2024-01-16 23:45:00"),
    ("event1", "2024-01-24 06:00:00"), ("pert1", "2024-01-30 23:45:00"), ("pert2", "2024-01-30 20:00:00"),
]


@query("scenario_eval", f"""WITH {P15}, s AS (SELECT * FROM (VALUES {", ".join(f"('{n}', TIMESTAMP '{t}')" for n, t in SCENARIOS)}) v(scenario, test_end)),
 fr AS (SELECT p.sid, s.scenario, p.idx, p.y FROM panel p JOIN s ON p.ts <= s.test_end AND p.ts > s.test_end - INTERVAL '1 day'),
 fc AS (SELECT f.sid, f.scenario, f.idx, f.y, list(q.y ORDER BY q.idx DESC) AS samples FROM fr f CROSS JOIN range({SAMPLES}) k(i)
   JOIN panel q ON q.sid = f.sid AND q.idx = f.idx - {PER_DAY} * (1 + k.i) GROUP BY ALL), {sql_items('sid, scenario')}
SELECT scenario, {rd('avg(mse)')} AS mse, {rd('sum(abs_error) / sum(abs_target_sum)')} AS nd,
 {rd('(SELECT sum(loss) FROM iq WHERE iq.scenario = im.scenario) / 19.0 / sum(abs_target_sum)')} AS crps FROM im GROUP BY scenario""")
def scenario_eval(spark, d):
    """Accuracy of the last day up to each named end."""
    phase = Window.partitionBy("sid", F.pmod("idx", F.lit(PER_DAY))).orderBy("idx")
    sampled = panel(spark, d).withColumn("samples", F.reverse(F.collect_list("y").over(phase.rowsBetween(-SAMPLES, -1))))
    rows = B.at_scenarios(sampled, SCENARIOS, PER_DAY, STEP)
    it = E.item_metrics(E.scored_rows(rows), keys=["sid", "scenario"])
    agg = E.aggregate_metrics(it, keys=["scenario"])
    out = agg.select("scenario", F.col("MSE").alias("mse"), F.col("ND").alias("nd"), F.col("CRPS").alias("crps"))
    return rounded(out, "mse", "nd", "crps")


@query("param_grid", f"""WITH {sql_forecast()}, g AS (SELECT fc.* EXCLUDE (samples), keep, samples[1:keep] AS samples FROM fc, (SELECT unnest([3, 5, 7]) AS keep)), {sql_items('sid, roll, keep', 'g')}
SELECT CAST(keep AS INTEGER) AS keep, {rd('avg(mse)')} AS mse, {rd('sum(abs_error) / sum(abs_target_sum)')} AS nd,
 {rd('(SELECT sum(loss) FROM iq WHERE iq.keep = im.keep) / 19.0 / sum(abs_target_sum)')} AS crps FROM im GROUP BY keep""")
def param_grid(spark, d):
    """One evaluation over a parameter axis (number of seasons kept): the parameter is a grouping key."""
    grid = S.with_grid(forecast(spark, d), keep=[3, 5, 7])
    rows = grid.withColumn("samples", F.slice("samples", F.lit(1), F.col("keep")))
    agg = E.aggregate_metrics(E.item_metrics(E.scored_rows(rows), keys=["sid", "roll", "keep"]), keys=["keep"])
    out = agg.select("keep", F.col("MSE").alias("mse"), F.col("ND").alias("nd"), F.col("CRPS").alias("crps"))
    return rounded(out, "mse", "nd", "crps")


CONTEXTS, RANKS = (PER_DAY, 2 * PER_DAY, 4 * PER_DAY), (0, 5)  # independent series, and the whole covariance of the five


def sql_crps(y: str, mean: str, sd: str) -> str:
    z = f"(({y} - {mean}) / {sd})"
    return (f"CASE WHEN {sd} > 0 THEN {sd} * ({z} * (2.0 * {sql_cdf(f'greatest(least({z}, 6.9), -6.9)')} - 1.0) + 2.0 * exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) - 1.0 / sqrt(pi()))"
            f" ELSE abs({y} - {mean}) END")


@query("model_sweep", f"""WITH {sql_forecast()}, cells AS (SELECT *, CAST(hour(ts) AS INTEGER) AS slot FROM panel),
  tr AS (SELECT * FROM cells WHERE idx < (SELECT min(origin) FROM rolls)), g AS (SELECT sid, slot, avg(y) AS mu FROM tr GROUP BY 1, 2),
  lv AS (SELECT sid, greatest(avg(abs(y)), 1e-10) AS level FROM tr GROUP BY 1), res AS (SELECT tr.sid, tr.idx, tr.y - g.mu AS e FROM tr JOIN g ON g.sid = tr.sid AND g.slot = tr.slot),
  cv AS (SELECT a.sid AS sa, b.sid AS sb, covar_samp(a.e, b.e) AS c FROM res a JOIN res b ON a.idx = b.idx GROUP BY 1, 2),
  sc AS (SELECT p.sid, r.roll, k.context, greatest(avg(abs(p.y)), 1e-10) AS scale FROM panel p, rolls r, (SELECT unnest([{", ".join(map(str, CONTEXTS))}]) AS context) k
    WHERE p.idx >= r.origin - k.context AND p.idx < r.origin GROUP BY 1, 2, 3),
  fr2 AS (SELECT fr.sid, fr.roll, fr.origin, fr.h, fr.y, sc.context, g.mu * sc.scale / lv.level AS m, sc.scale / lv.level AS f
    FROM fr JOIN g ON g.sid = fr.sid AND g.slot = hour(fr.ts) JOIN lv ON lv.sid = fr.sid JOIN sc ON sc.sid = fr.sid AND sc.roll = fr.roll),
  mar AS (SELECT x.context, avg({sql_crps('x.y', 'x.m', '(sqrt(c.c) * x.f)')}) AS crps, count(*) AS n FROM fr2 x JOIN cv c ON c.sa = x.sid AND c.sb = x.sid GROUP BY 1),
  pairs AS (SELECT a.context, a.roll, a.origin, a.h, CASE WHEN a.sid = b.sid THEN 1 ELSE 0 END AS own, a.f * b.f * c.c AS v FROM fr2 a JOIN fr2 b ON b.context = a.context AND b.roll = a.roll AND b.h = a.h
    JOIN cv c ON c.sa = a.sid AND c.sb = b.sid),
  vs AS (SELECT context, roll, origin, h, sum(v) AS all_, sum(v * own) AS own FROM pairs GROUP BY 1, 2, 3, 4),
  tot AS (SELECT context, roll, origin, h, sum(y) AS y, sum(m) AS m FROM fr2 GROUP BY 1, 2, 3, 4),
  sm AS (SELECT t.context, r.rank, t.y, t.m, sqrt(greatest(CASE WHEN r.rank = 0 THEN vs.own ELSE vs.all_ END, 0.0)) AS sd FROM tot t
    JOIN vs ON vs.context = t.context AND vs.roll = t.roll AND vs.h = t.h, (SELECT unnest([{", ".join(map(str, RANKS))}]) AS rank) r)
SELECT CAST(sm.context AS INTEGER) AS context, CAST(sm.rank AS INTEGER) AS rank, {rd('any_value(mar.crps)')} AS crps, {rd(f'avg({sql_crps("sm.y", "sm.m", "sm.sd")})')} AS sum_crps,
 CAST(any_value(mar.n) AS BIGINT) AS n, count(*) AS n_sum FROM sm JOIN mar ON mar.context = sm.context GROUP BY sm.context, sm.rank""")
def model_sweep(spark, d):
    """Context length and rank as axes of one plan: the scores change with both."""
    s = M.Settings(rolling=SPEC, last=int(spark.range(1).select(last(spark, d)).first()[0]))
    return rounded(S.gaussian_sweep(materialise(panel(spark, d)), s, CONTEXTS, RANKS), "crps", "sum_crps")


MODEL_NAMES = ["gauss_scaled", "gauss_lowrank_scaled"]


RUN_RANKS = (2, 5)


def _runs(spark, d):
    """Every series under every model, context length, rank and repetition: settings that change the forecasts."""
    series = events(spark, d).select(F.col("event_type").alias("sid")).distinct()
    return S.repeated(S.with_grid(series, context=list(CONTEXTS), rank=list(RUN_RANKS), model=MODEL_NAMES))


SQL_RUNS = f"""runs AS (SELECT sid, CAST(context AS INTEGER) AS context, CAST(rank AS INTEGER) AS rank, model, CAST(rep AS INTEGER) AS rep FROM (SELECT DISTINCT event_type AS sid FROM events),
 (SELECT unnest([{", ".join(map(str, CONTEXTS))}]) AS context), (SELECT unnest([{", ".join(map(str, RUN_RANKS))}]) AS rank), (SELECT unnest({MODEL_NAMES}) AS model), range(6) r(rep))"""
SQL_LABEL = """'context=' || CAST(context AS VARCHAR) || ';model=' || model || CASE WHEN model = 'gauss_lowrank_scaled' THEN ';rank=' || CAST(rank AS VARCHAR) ELSE '' END ||
 ';rep=' || CAST(rep AS VARCHAR)"""


def _label():
    factors = F.col("model") == "gauss_lowrank_scaled"  # only this model has a rank
    return S.run_label(model=F.col("model"), rep=F.col("rep"), context=F.col("context"), rank=F.when(factors, F.col("rank")))


@query("run_labels", f"WITH {SQL_RUNS} SELECT sid, model, rep, {SQL_LABEL} AS label, count(*) AS n FROM runs GROUP BY 1, 2, 3, 4")
def run_labels(spark, d):
    return _runs(spark, d).withColumn("label", _label()).groupBy("sid", "model", "rep", "label").agg(F.count("*").alias("n"))


@query("pending_runs", f"""WITH {SQL_RUNS}, done AS (SELECT DISTINCT event_type AS sid, CAST(user_id % 6 AS INTEGER) AS rep, CASE WHEN {SQL_K} % 2 = 0 THEN {RUN_RANKS[0]} ELSE {RUN_RANKS[1]} END AS rank
  FROM events WHERE {SQL_K} >= 99)
SELECT sid, context, rank, model, rep FROM runs WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.sid = runs.sid AND d.rep = runs.rep AND d.rank = runs.rank)""")
def pending_runs(spark, d):
    """Runs without a stored result; the stored ones are read off the events."""
    k = props_key()
    done = events(spark, d).filter(k >= 99).select(
        F.col("event_type").alias("sid"), (F.col("user_id") % 6).cast("int").alias("rep"), F.when(k % 2 == 0, RUN_RANKS[0]).otherwise(RUN_RANKS[1]).alias("rank"))
    return S.pending(_runs(spark, d), done, ["sid", "rep", "rank"])


@query("stacked_results", f"""WITH {sql_forecast()}, {sql_items()} SELECT sid AS run, roll, 'item' AS source, {rd('mse')} AS mse FROM im UNION ALL
SELECT 'all', roll, 'roll', {rd('avg(mse)')} FROM im GROUP BY roll""")
def stacked_results(spark, d):
    """Result tables of several runs, one below the other."""
    it = E.item_metrics(E.scored_rows(forecast(spark, d)))
    a = it.select(F.col("sid").alias("run"), "roll", F.lit("item").alias("source"), F.col("MSE").alias("mse"))
    b = it.groupBy("roll").agg(F.avg("MSE").alias("mse")).select(F.lit("all").alias("run"), "roll", F.lit("roll").alias("source"), "mse")
    return rounded(S.stacked([a, b]), "mse")

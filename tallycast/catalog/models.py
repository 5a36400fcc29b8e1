"""Distribution parameters, likelihoods, dependence, draws and forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog.registry import (
    ORACLES, PER_DAY, STEP, events, last, panel, query, rd, rounded, sql_horner, sql_panel, sql_ppf, sql_uniform,
)
from tallycast.functions import distributions as D
from tallycast.functions import numeric as N
from tallycast.operators import covariance as K
from tallycast.operators import draws as R
from tallycast.operators import instances as I
from tallycast.operators import panel as P
from tallycast.plans import forecast as M
from tallycast.plans.backtest import Rolling
from tallycast.plans.experiment import forecast_scenarios
from tallycast.plans.metrics import bands
from tallycast.session import materialise, scratch_path
from tallycast.sources.writers import load_parameters, save_parameters

P15 = sql_panel()
CELLS = "cells AS (SELECT *, CAST(hour(ts) AS INTEGER) AS slot FROM panel)"
SHAPE = f"CASE WHEN var - mu > mu * {D.LEAST_EXCESS!r}::DOUBLE THEN mu * mu / (var - mu) END"
SQL_NB = f"""{CELLS}, nb0 AS (SELECT sid, slot, avg(y) AS mu, var_samp(y) AS var, count(*) AS n FROM cells GROUP BY 1, 2),
  nb AS (SELECT *, {SHAPE} AS shape FROM nb0)"""
SQL_TOTAL_NB = f"""{CELLS}, tot AS (SELECT ts, idx, slot, sum(y) AS total FROM cells GROUP BY 1, 2, 3),
  tnb0 AS (SELECT slot, avg(total) AS mu, var_samp(total) AS var, count(*) AS n FROM tot GROUP BY 1),
  tnb AS (SELECT *, {SHAPE} AS shape FROM tnb0)"""
SQL_ALPHA = """sh AS (SELECT c.sid, c.slot, c.y / t.total AS p FROM cells c JOIN tot t ON c.idx = t.idx WHERE t.total <> 0),
  ms AS (SELECT slot, sid, avg(p) AS m, var_samp(p) AS v FROM sh GROUP BY 1, 2),
  a0 AS (SELECT slot, least(greatest(coalesce(sum(m * (1.0 - m)) / nullif(sum(v), 0.0) - 1.0, 1e12::DOUBLE), 1e-3::DOUBLE), 1e12::DOUBLE) AS a FROM ms GROUP BY 1),
  alpha AS (SELECT ms.slot, ms.sid, greatest(a * m, 1e-3::DOUBLE) AS alpha FROM ms JOIN a0 ON ms.slot = a0.slot)"""


def sql_log1p(x: str) -> str:
    return f"(CASE WHEN 1.0::DOUBLE + {x} = 1.0 THEN {x} ELSE {x} * ln(1.0::DOUBLE + {x}) / ((1.0::DOUBLE + {x}) - 1.0) END)"


def sql_rest(z: str) -> str:
    return f"({sql_horner(N.STIRLING[::-1], f'(1.0::DOUBLE / ({z} * {z}))')} / {z})"


def sql_rising(y: str, a: str) -> str:
    """ln Gamma(a + y) - ln Gamma(a)."""
    wide = f"({a} - 0.5) * {sql_log1p(f'({y} / {a})')} + {y} * ln({a} + {y}) - {y} + {sql_rest(f'({a} + {y})')} - {sql_rest(a)}"
    return f"(CASE WHEN {a} >= {D.WIDE_SHAPE} THEN {wide} ELSE lgamma({y} + {a}) - lgamma({a}) END)"


def sql_nb_logpmf(y: str, mu: str = "mu", r: str = "shape") -> str:
    log1p, rest = sql_log1p, sql_rest
    poisson = f"CASE WHEN {mu} > 0 THEN {y} * ln({mu}) - {mu} - lgamma({y} + 1.0::DOUBLE) WHEN {y} = 0 THEN 0.0::DOUBLE END"
    wide = (
        f"({r} - 0.5) * {log1p(f'({y} / {r})')} - {r} * {log1p(f'({mu} / {r})')} - {y} + {rest(f'({y} + {r})')} - {rest(r)} "
        f"- lgamma({y} + 1.0::DOUBLE) + {y} * ln({mu} * (({r} + {y}) / ({r} + {mu})))"
    )
    near = (
        f"lgamma({y} + {r}) - lgamma({y} + 1.0::DOUBLE) - lgamma({r}) + {r} * ln({r} / ({r} + {mu})) "
        f"+ CASE WHEN {y} > 0 THEN {y} * ln({mu} / ({r} + {mu})) ELSE 0.0 END"
    )
    return f"(CASE WHEN {r} IS NULL THEN ({poisson}) WHEN {r} >= {D.WIDE_SHAPE} THEN ({wide}) ELSE ({near}) END)"


def sql_nb_table(source: str, keys: str) -> str:
    """CTEs ``mass`` and ``table_`` (keys, k, pmf, cdf) over the support of every row of ``source`` with mu and shape."""
    ratio = "coalesce(mu / shape, 0.0)"
    sd = f"sqrt(mu * (1.0 + {ratio}))"
    low = f"greatest(floor(mu - {D.SUPPORT_SD} * {sd} - {D.SUPPORT_EXTRA}), 0)"
    top = f"ceil(mu + {D.SUPPORT_SD} * {sd} + {D.SUPPORT_DECAY} * (1.0 + {ratio}) + {D.SUPPORT_EXTRA})"
    return f"""mass AS (SELECT {keys}, k, coalesce(exp({sql_nb_logpmf('CAST(k AS DOUBLE)')}), 0.0) AS pmf
    FROM (SELECT *, unnest(generate_series(CAST({low} AS BIGINT), CAST({top} AS BIGINT))) AS k FROM {source})),
  table_ AS (SELECT *, sum(pmf) OVER (PARTITION BY {keys} ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM mass)"""


def _cells(spark, d):
    return M.with_slot(panel(spark, d))


def _moments(df):
    """The shape is compared on the log scale, where its wide range has one precision."""
    return rounded(df.withColumn("log_shape", F.log("shape")).drop("shape"), "mu", "var", "log_shape")


@query("numeric_functions", f"""SELECT event_id, {rd('CASE WHEN x > 0 THEN x ELSE 0.0 END + ln(1.0 + exp(-abs(x)))')} AS softplus,
{rd('CASE WHEN x >= 0 THEN x + 1.0 ELSE exp(x) END')} AS exp_linear, {rd('lgamma(value + 0.01)')} AS log_gamma,
{rd('ln(value)')} AS log_value FROM (SELECT event_id, value, value / 50.0::DOUBLE - 1.0 AS x FROM events)""")
def numeric_functions(spark, d):
    e = events(spark, d).withColumn("x", F.col("value") / 50.0 - 1.0)
    out = e.select(
        "event_id", N.softplus(F.col("x")).alias("softplus"), N.exp_linear(F.col("x")).alias("exp_linear"),
        N.lgamma(F.col("value") + 0.01).alias("log_gamma"), N.log_positive(F.col("value")).alias("log_value"))
    return rounded(out, "softplus", "exp_linear", "log_gamma", "log_value")


@query("nb_moments", f"WITH {P15}, {SQL_NB} SELECT sid, slot, {rd('mu')} AS mu, {rd('var')} AS var, n, {rd('ln(shape)')} AS log_shape FROM nb")
def nb_moments(spark, d):
    return _moments(M.nb_moments(_cells(spark, d)))


@query("nb_moments_week", f"""WITH {P15}, c AS (SELECT *, CAST((isodow(ts) - 1) * 96 + (hour(ts) * 60 + minute(ts)) // 15 AS INTEGER) AS slot FROM panel),
nb0 AS (SELECT sid, slot, avg(y) AS mu, var_samp(y) AS var, count(*) AS n FROM c GROUP BY 1, 2)
SELECT sid, slot, {rd('mu')} AS mu, {rd('var')} AS var, n, {rd(f'ln({SHAPE})')} AS log_shape FROM nb0""")
def nb_moments_week(spark, d):
    """Cells of weekday and position in the day."""
    return _moments(M.nb_moments(M.with_slot(panel(spark, d), "week", STEP)))


@query("total_nb_moments", f"WITH {P15}, {SQL_TOTAL_NB} SELECT slot, {rd('mu')} AS mu, {rd('var')} AS var, n, {rd('ln(shape)')} AS log_shape FROM tnb")
def total_nb_moments(spark, d):
    t = M.with_slot(P.totals(panel(spark, d)))
    return _moments(M.nb_moments(t, ["slot"], "total"))


@query("gaussian_moments", f"""WITH {P15}, {CELLS} SELECT sid, slot, {rd('avg(y)')} AS mu, {rd('stddev_samp(y)')} AS sd, count(*) AS n FROM cells GROUP BY 1, 2""")
def gaussian_moments(spark, d):
    return rounded(M.gaussian_moments(_cells(spark, d)), "mu", "sd")


@query("dirichlet_moments", f"WITH {P15}, {SQL_TOTAL_NB}, {SQL_ALPHA} SELECT slot, sid, {rd('alpha')} AS alpha FROM alpha")
def dirichlet_moments(spark, d):
    return rounded(M.dirichlet_moments(_cells(spark, d)), "alpha")


@query("nb_loglik", f"""WITH {P15}, {SQL_NB} SELECT c.sid, {rd(f'sum({sql_nb_logpmf("y")})', 4)} AS loglik, {rd(f'avg({sql_nb_logpmf("y")})')} AS mean_loglik, count(*) AS n
FROM cells c JOIN nb ON c.sid = nb.sid AND c.slot = nb.slot GROUP BY 1""")
def nb_loglik(spark, d):
    cells = _cells(spark, d)
    scored = cells.join(M.nb_moments(cells).select("sid", "slot", "mu", "shape"), ["sid", "slot"])
    ll = D.nb_logpmf(F.col("y"), F.col("mu"), F.col("shape"))
    out = scored.groupBy("sid").agg(F.sum(ll).alias("loglik"), F.avg(ll).alias("mean_loglik"), F.count("*").alias("n"))
    return rounded(rounded(out, "loglik", digits=4), "mean_loglik")


SQL_DM = f"""{SQL_TOTAL_NB}, {SQL_ALPHA},
  dm0 AS (SELECT c.ts, t.slot, t.total, sum(alpha) AS a, sum({sql_rising('y', 'alpha')} - lgamma(y + 1.0::DOUBLE)) AS items
    FROM cells c JOIN tot t ON c.idx = t.idx JOIN alpha a ON a.sid = c.sid AND a.slot = c.slot GROUP BY 1, 2, 3),
  dm AS (SELECT ts, slot, total, items + lgamma(total + 1.0::DOUBLE) - {sql_rising('total', 'a')} AS loglik FROM dm0)"""


def _dm_steps(spark, d):
    """Per step: total and log-likelihood of its split."""
    cells = _cells(spark, d)
    rows = cells.join(M.dirichlet_moments(cells), ["sid", "slot"])
    step = rows.groupBy("ts", "slot").agg(
        F.sum("y").alias("total"), F.sum("alpha").alias("_a"), F.sum(D.dm_item_term(F.col("y"), F.col("alpha"))).alias("_items"))
    return step.select("ts", "slot", "total", (D.dm_total_term(F.col("total"), F.col("_a")) + F.col("_items")).alias("loglik"))


@query("dm_loglik", f"WITH {P15}, {SQL_DM} SELECT ts, total, {rd('loglik')} AS loglik FROM dm")
def dm_loglik(spark, d):
    return rounded(_dm_steps(spark, d).select("ts", "total", "loglik"), "loglik")


@query("joint_loss", f"""WITH {P15}, {SQL_DM} SELECT {rd(f'-avg(loglik + {sql_nb_logpmf("total")})')} AS loss, count(*) AS n
FROM dm JOIN tnb ON dm.slot = tnb.slot WHERE total <> 0""")
def joint_loss(spark, d):
    """Mean negative log-likelihood of total and split over the steps with a non-zero total."""
    params = M.nb_moments(M.with_slot(P.totals(panel(spark, d))), ["slot"], "total").select("slot", "mu", "shape")
    scored = _dm_steps(spark, d).filter("total != 0").join(params, "slot")
    joint = F.col("loglik") + D.nb_logpmf(F.col("total"), F.col("mu"), F.col("shape"))
    return rounded(scored.agg((-F.avg(joint)).alias("loss"), F.count("*").alias("n")), "loss")


def _dm_loss(spark, d, alphas):
    cells = materialise(_cells(spark, d))
    rows = cells.join(alphas(cells), ["sid", "slot"])
    step = rows.groupBy("ts", "slot").agg(
        F.sum("y").alias("total"), F.sum("alpha").alias("_a"), F.sum(D.dm_item_term(F.col("y"), F.col("alpha"))).alias("_items"))
    scored = step.filter("total > 0").withColumn("ll", D.dm_total_term(F.col("total"), F.col("_a")) + F.col("_items"))
    return scored.groupBy("slot").agg(F.sum("ll").alias("ll"))


@query("dirichlet_likelihood", f"WITH {P15}, {SQL_DM} SELECT slot, TRUE AS as_likely, {rd('sum(loglik)', 4)} AS by_moments FROM dm WHERE total > 0 GROUP BY slot")
def dirichlet_likelihood(spark, d):
    """Per slot, the log-likelihood of the splits by moments, and whether maximum likelihood reaches at least that."""
    moments = _dm_loss(spark, d, M.dirichlet_moments).withColumnRenamed("ll", "by_moments")
    best = _dm_loss(spark, d, M.dirichlet_likelihood)
    return rounded(moments.join(best, "slot").select("slot", (F.col("ll") >= F.col("by_moments") - 1e-6).alias("as_likely"), "by_moments"), "by_moments", digits=4)


@query("gaussian_loglik", f"""WITH {P15}, c AS (SELECT *, hour(ts) AS slot, min(CASE WHEN v IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY ts) AS seen FROM panel),
g AS (SELECT sid, slot, avg(v) AS mu, stddev_samp(v) AS sd FROM c GROUP BY 1, 2)
SELECT c.sid, {rd('sum(CASE WHEN seen = 1 THEN -0.5 * ((v - mu) / sd) * ((v - mu) / sd) - ln(sd) - 0.5 * ln(2 * pi()) ELSE 0.0 END) / nullif(sum(seen), 0)')} AS loglik,
CAST(sum(seen) AS BIGINT) AS steps FROM c JOIN g ON c.sid = g.sid AND c.slot = g.slot GROUP BY 1""")
def gaussian_loglik(spark, d):
    """Average over the steps at which every series is observed."""
    p = M.with_slot(P.value_panel(events(spark, d), "event_type", "value", minutes=STEP)).withColumn("observed", I.observed(F.col("y")))
    seen = I.step_observed(p)
    scored = p.join(seen, "ts").join(M.gaussian_moments(p).drop("n"), ["sid", "slot"])
    ll = D.gaussian_logpdf(F.col("y"), F.col("mu"), F.col("sd"))
    out = scored.groupBy("sid").agg(I.masked_average(ll, F.col("all_observed")).alias("loglik"), F.sum("all_observed").alias("steps"))
    return rounded(out, "loglik")


SQL_CDF = sql_nb_table("nb", "sid, slot")


@query("nb_pmf_table", f"WITH {P15}, {SQL_NB}, {SQL_CDF} SELECT sid, slot, k, {rd('pmf')} AS pmf, {rd('cdf')} AS cdf FROM table_")
def nb_pmf_table(spark, d):
    params = M.nb_moments(_cells(spark, d))
    return rounded(R.nb_table(params, ["sid", "slot"]), "pmf", "cdf")


@query("nb_total_quantiles", f"""WITH {P15}, {SQL_TOTAL_NB}, {sql_nb_table('tnb', 'slot')}
SELECT slot, {", ".join(f"min(k) FILTER (cdf >= {q}::DOUBLE) AS p{round(q * 100):02d}" for q in (0.05, 0.5, 0.95))} FROM table_ GROUP BY slot""")
def nb_total_quantiles(spark, d):
    """Quantiles of the cross-series total per slot from its distribution function."""
    params = M.nb_moments(M.with_slot(P.totals(panel(spark, d))), ["slot"], "total")
    found = params.withColumn("_q", R.nb_quantiles(F.col("mu"), F.col("shape"), F.array(*map(F.lit, (0.05, 0.5, 0.95)))))
    return found.select("slot", *[F.col("_q")[i].cast("bigint").alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


TAIL = 0.005


@query("anomaly_scores", f"""WITH {P15}, {SQL_NB}, {SQL_CDF}, z AS (SELECT c.sid, c.ts, c.y, {sql_nb_logpmf('y')} AS ll,
  coalesce(t.cdf, CASE WHEN c.y > mu THEN 1.0 ELSE 0.0 END) AS below, coalesce(1.0 - t.cdf + t.pmf, CASE WHEN c.y > mu THEN 0.0 ELSE 1.0 END) AS above
  FROM cells c JOIN nb ON c.sid = nb.sid AND c.slot = nb.slot LEFT JOIN table_ t ON t.sid = c.sid AND t.slot = c.slot AND t.k = c.y)
SELECT sid, ts, y, {rd('ll')} AS loglik, {rd('below')} AS cdf, CAST(least(round(below, 9), round(above, 9)) < {TAIL} AS INTEGER) AS anomalous FROM z""")
def anomaly_scores(spark, d):
    """Density and distribution function of every value under its cell's negative binomial; values of which as low or
    as high ones have a probability below 0.005 are flagged."""
    cells = _cells(spark, d)
    scored = cells.join(M.nb_moments(cells).select("sid", "slot", "mu", "shape"), ["sid", "slot"])
    scored = scored.withColumn("_below", R.nb_cdf(F.col("y"), F.col("mu"), F.col("shape"))).withColumn(
        "_less", R.nb_cdf(F.col("y") - 1.0, F.col("mu"), F.col("shape")))
    below, above = F.col("_below"), 1.0 - F.col("_less")
    rare = (F.least(F.round(below, 9), F.round(above, 9)) < TAIL).cast("int")
    out = scored.select("sid", "ts", "y", D.nb_logpmf(F.col("y"), F.col("mu"), F.col("shape")).alias("loglik"), below.alias("cdf"), rare.alias("anomalous"))
    return rounded(out, "loglik", "cdf")


# --- dependence ---------------------------------------------------------------------------------

SQL_COV = """cov AS (SELECT a.sid AS sid_a, b.sid AS sid_b, covar_samp(a.y, b.y) AS cov, corr(a.y, b.y) AS corr
  FROM panel a JOIN panel b ON a.idx = b.idx AND a.sid <= b.sid GROUP BY 1, 2)"""


@query("series_covariance", f"WITH {P15}, {SQL_COV} SELECT sid_a, sid_b, {rd('cov')} AS cov FROM cov")
def series_covariance(spark, d):
    codes = P.series_codes(P.event_series(events(spark, d), "event_type"))
    return rounded(K.covariance(panel(spark, d), codes).select("sid_a", "sid_b", "cov"), "cov")


@query("series_correlation", f"WITH {sql_panel(60, 'user_id')}, {SQL_COV} SELECT sid_a, sid_b, {rd('corr')} AS corr FROM cov")
def series_correlation(spark, d):
    """All pairs of users on hourly counts."""
    e = events(spark, d)
    codes = P.series_codes(P.event_series(e, "user_id"))
    out = K.covariance(P.event_panel(e, "user_id", minutes=60), codes)
    return rounded(out.select("sid_a", "sid_b", "corr"), "corr", many=True)


@query("pair_correlation", f"""WITH {sql_panel(60, 'user_id')}, k AS (SELECT sid, row_number() OVER (ORDER BY sid) AS code FROM (SELECT DISTINCT sid FROM panel)),
 pr AS (SELECT a.sid AS sid_a, b.sid AS sid_b FROM k a JOIN k b ON b.code = a.code + 1)
SELECT sid_a, sid_b, {rd('covar_samp(a.y, b.y)')} AS cov, {rd('corr(a.y, b.y)')} AS corr, count(*) AS n
FROM pr JOIN panel a ON a.sid = sid_a JOIN panel b ON b.sid = sid_b AND b.ts = a.ts GROUP BY 1, 2""")
def pair_correlation(spark, d):
    """Every user with the next one, on hourly counts: the pairs are declared, so nothing is squared."""
    e = events(spark, d)
    codes = materialise(P.series_codes(P.event_series(e, "user_id")), "codes")
    following = codes.select(F.col("sid").alias("sid_b"), (F.col("code") - 1).alias("code"))
    pairs = codes.withColumnRenamed("sid", "sid_a").join(following, "code")
    return rounded(K.pair_covariance(P.event_panel(e, "user_id", minutes=60), pairs), "cov", "corr")


@query("factor_variance", f"WITH {P15} SELECT sid, {rd('var_samp(y)')} AS explained, 0.0::DOUBLE AS diag FROM panel GROUP BY sid")
def factor_variance(spark, d):
    """Full-rank factors explain each series' whole variance and leave nothing on the diagonal."""
    loadings, diag = K.factor_model(materialise(panel(spark, d)), 10**6)
    explained = F.aggregate("loadings", F.lit(0.0), lambda acc, v: acc + v * v)
    return rounded(loadings.join(diag, "sid").select("sid", explained.alias("explained"), "diag"), "explained", "diag")


@query("factor_covariance", f"WITH {P15}, {SQL_COV} SELECT sid_a, sid_b, {rd('cov')} AS cov FROM cov")
def factor_covariance(spark, d):
    """The covariance that whole-rank factors and diagonals imply, from products of loadings of the same factor."""
    loadings, diag = K.factor_model(materialise(panel(spark, d)), 10**6)
    long = materialise(loadings.select("sid", F.posexplode("loadings").alias("k", "l")), "long")
    a, b = (long.select(F.col("sid").alias(f"sid_{x}"), "k", F.col("l").alias(x)) for x in "ab")
    shared = a.join(b, "k").filter("sid_a <= sid_b").groupBy("sid_a", "sid_b").agg(F.sum(F.col("a") * F.col("b")).alias("shared"))
    own = diag.select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b"), "diag")
    both = shared.join(own, ["sid_a", "sid_b"], "left")
    return rounded(both.select("sid_a", "sid_b", (F.col("shared") + F.coalesce("diag", F.lit(0.0))).alias("cov")), "cov")


# --- draws and forecasters ----------------------------------------------------------------------

SPEC = Rolling(horizon=PER_DAY, step=PER_DAY, windows=2, test_start=25 * PER_DAY)


def settings(spark, d, samples=20, **kw) -> M.Settings:
    bound = spark.range(1).select(last(spark, d)).first()[0]
    return M.Settings(rolling=SPEC, samples=samples, seed="s", last=int(bound), context=PER_DAY, rank=3, **kw)


@query("gauss_paths", f"""WITH {P15}, {CELLS}, e AS (SELECT max(idx) AS b FROM panel),
 w AS (SELECT b - 95 - 96 * i AS origin FROM e, range(2) r(i)),
 g AS (SELECT sid, slot, avg(y) AS mu, stddev_samp(y) AS sd FROM cells WHERE idx < (SELECT min(origin) FROM w) GROUP BY 1, 2),
 f AS (SELECT c.sid, w.origin, CAST(c.idx - w.origin + 1 AS INTEGER) AS h, c.ts, CAST(i AS INTEGER) AS sample_id, mu, sd,
   {sql_uniform('s', 'c.sid', 'w.origin', '(c.idx - w.origin + 1)', 'i')} AS u
   FROM cells c JOIN w ON c.idx BETWEEN w.origin AND w.origin + 95 JOIN g ON g.sid = c.sid AND g.slot = c.slot CROSS JOIN range(5) r(i))
SELECT sid, origin, h, ts, sample_id, {rd(f'mu + sd * {sql_ppf("u")}')} AS y_hat FROM f""")
def gauss_paths(spark, d):
    """Independent normal sample paths; the noise is keyed, so SQL draws the same numbers."""
    fc = M.forecast("gauss", panel(spark, d), settings(spark, d, samples=5))
    return rounded(M.explode_samples(fc), "y_hat")


@query("gauss_scaled_paths", f"""WITH {P15}, {CELLS}, e AS (SELECT max(idx) AS b FROM panel),
 w AS (SELECT b - 95 - 96 * i AS origin FROM e, range(2) r(i)),
 tr AS (SELECT * FROM cells WHERE idx < (SELECT min(origin) FROM w)),
 g AS (SELECT sid, slot, avg(y) AS mu, stddev_samp(y) AS sd FROM tr GROUP BY 1, 2),
 lv AS (SELECT sid, greatest(avg(abs(y)), 1e-10) AS level FROM tr GROUP BY 1),
 sc AS (SELECT c.sid, w.origin, greatest(avg(abs(c.y)), 1e-10) AS scale FROM cells c JOIN w ON c.idx >= w.origin - 96 AND c.idx < w.origin GROUP BY 1, 2),
 f AS (SELECT c.sid, w.origin, CAST(c.idx - w.origin + 1 AS INTEGER) AS h, c.ts, CAST(i AS INTEGER) AS sample_id, mu * scale / level AS m, sd * scale / level AS d,
   {sql_uniform('s', 'c.sid', 'w.origin', '(c.idx - w.origin + 1)', 'i')} AS u
   FROM cells c JOIN w ON c.idx BETWEEN w.origin AND w.origin + 95 JOIN g ON g.sid = c.sid AND g.slot = c.slot JOIN lv ON lv.sid = c.sid
   JOIN sc ON sc.sid = c.sid AND sc.origin = w.origin CROSS JOIN range(5) r(i))
SELECT sid, origin, h, ts, sample_id, {rd(f'm + d * {sql_ppf("u")}')} AS y_hat FROM f""")
def gauss_scaled_paths(spark, d):
    """The same on the level of the day before each origin."""
    fc = M.forecast("gauss_scaled", panel(spark, d), settings(spark, d, samples=5))
    return rounded(M.explode_samples(fc), "y_hat")


def _paths(model):
    def run(spark, d):
        return M.explode_samples(M.forecast(model, panel(spark, d), settings(spark, d)))

    return run


SQL_TRAIN = f"""e AS (SELECT max(idx) AS b FROM panel), w AS (SELECT b - 95 - 96 * i AS origin FROM e, range(2) r(i)),
 tr AS (SELECT * FROM cells WHERE idx < (SELECT min(origin) FROM w)),
 p0 AS (SELECT sid, slot, avg(y) AS mu, var_samp(y) AS var FROM tr GROUP BY 1, 2), params AS (SELECT *, {SHAPE} AS shape FROM p0)"""


@query("nb_series_paths", f"""WITH {P15}, {CELLS}, {SQL_TRAIN}, {sql_nb_table('params', 'sid, slot')},
 f AS (SELECT c.sid, c.slot, w.origin, CAST(c.idx - w.origin + 1 AS INTEGER) AS h, c.ts, CAST(i AS INTEGER) AS sample_id,
   {sql_uniform('s', 'c.sid', 'w.origin', '(c.idx - w.origin + 1)', 'i')} AS u
   FROM cells c JOIN w ON c.idx BETWEEN w.origin AND w.origin + 95 CROSS JOIN range(20) r(i))
SELECT f.sid, f.origin, f.h, f.ts, f.sample_id, CAST(coalesce(min(k) FILTER (cdf >= u), max(k)) AS DOUBLE) AS y_hat
FROM f JOIN table_ t ON t.sid = f.sid AND t.slot = f.slot GROUP BY 1, 2, 3, 4, 5""")
def nb_series_paths(spark, d):
    """Negative-binomial sample paths by inversion of keyed uniforms, so SQL draws the same counts."""
    return _paths("nb_series")(spark, d)


@query("saved_model_paths", ORACLES["nb_series_paths"])
def saved_model_paths(spark, d):
    """The same forecast from parameters that were fitted, saved and loaded."""
    p, s, path = materialise(panel(spark, d)), settings(spark, d), scratch_path(spark, "model")
    fit, predict = M.FITTED["nb_series"]
    save_parameters(fit(p, s), path)
    return M.explode_samples(predict(p, load_parameters(spark, path, ["cells", "series"]), s))


@query("lag_linear_paths", f"""WITH {P15}, {CELLS}, e AS (SELECT max(idx) AS b FROM panel), w AS (SELECT b - 95 - 96 * i AS origin FROM e, range(2) r(i)),
 l AS (SELECT *, lag(y, 96) OVER (PARTITION BY sid ORDER BY idx) AS x FROM cells), tr AS (SELECT * FROM l WHERE idx < (SELECT min(origin) FROM w) AND x IS NOT NULL),
 line AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM tr), sp AS (SELECT sid, stddev_samp(y - a - line.b * x) AS sd FROM tr, line GROUP BY 1),
 f AS (SELECT l.sid, w.origin, CAST(l.idx - w.origin + 1 AS INTEGER) AS h, l.ts, CAST(i AS INTEGER) AS sample_id, a + line.b * x AS mu, sd,
   {sql_uniform('s', 'l.sid', 'w.origin', '(l.idx - w.origin + 1)', 'i')} AS u
   FROM l JOIN w ON l.idx BETWEEN w.origin AND w.origin + 95 JOIN sp ON sp.sid = l.sid CROSS JOIN line CROSS JOIN range(20) r(i))
SELECT sid, origin, h, ts, sample_id, {rd(f'mu + sd * {sql_ppf("u")}')} AS y_hat FROM f""")
def lag_linear_paths(spark, d):
    """Direct forecasts of a whole horizon from the value one horizon earlier."""
    return rounded(_paths("lag_linear")(spark, d), "y_hat")


SQL_ROLLS = "e AS (SELECT max(idx) AS b FROM panel), w AS (SELECT b - 95 - 96 * i AS origin FROM e, range(2) r(i))"


@query("lag_recursive_paths", f"""WITH RECURSIVE {P15}, {CELLS}, {SQL_ROLLS},
 l AS (SELECT *, lag(y, 1) OVER (PARTITION BY sid ORDER BY idx) AS x1, lag(y, 96) OVER (PARTITION BY sid ORDER BY idx) AS x2 FROM cells),
 tr AS (SELECT * FROM l WHERE idx < (SELECT min(origin) FROM w) AND x1 IS NOT NULL AND x2 IS NOT NULL),
 c AS (SELECT covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS t1, covar_pop(x2, y) AS t2, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM tr),
 k AS (SELECT (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM c),
 sp AS (SELECT sid, stddev_samp(y - (my - b1 * m1 - b2 * m2) - b1 * x1 - b2 * x2) AS sd FROM tr, k GROUP BY 1),
 rec AS (SELECT p.sid, w.origin, i, CAST(0 AS BIGINT) AS h, p.y FROM panel p JOIN w ON p.idx = w.origin - 1, range(5) r(i)
  UNION ALL
  SELECT r.sid, r.origin, r.i, r.h + 1, my - b1 * m1 - b2 * m2 + b1 * r.y + b2 * p.y + sd * {sql_ppf(sql_uniform('s', 'r.sid', 'r.origin', '(r.h + 1)', 'r.i'))}
  FROM rec r JOIN panel p ON p.sid = r.sid AND p.idx = r.origin + r.h - 96 JOIN sp ON sp.sid = r.sid, k WHERE r.h < 96)
SELECT r.sid, r.origin, CAST(r.h AS INTEGER) AS h, p.ts, CAST(r.i AS INTEGER) AS sample_id, {rd('r.y')} AS y_hat FROM rec r JOIN panel p ON p.sid = r.sid AND p.idx = r.origin + r.h - 1 WHERE r.h > 0""")
def lag_recursive_paths(spark, d):
    """Paths rolled forward from the last value and that of a day earlier: every forecast value enters the next one."""
    fc = M.forecast("lag_recursive", panel(spark, d), settings(spark, d, samples=5, lags=(1, PER_DAY)))
    return rounded(M.explode_samples(fc), "y_hat")


@query("gauss_refit_paths", f"""WITH {P15}, {CELLS}, {SQL_ROLLS},
 g AS (SELECT origin, sid, slot, avg(y) AS mu, stddev_samp(y) AS sd FROM cells JOIN w ON idx < origin GROUP BY 1, 2, 3),
 f AS (SELECT c.sid, w.origin, CAST(c.idx - w.origin + 1 AS INTEGER) AS h, c.ts, CAST(i AS INTEGER) AS sample_id, mu, sd,
   {sql_uniform('s', 'c.sid', 'w.origin', '(c.idx - w.origin + 1)', 'i')} AS u
   FROM cells c JOIN w ON c.idx BETWEEN w.origin AND w.origin + 95 JOIN g ON g.origin = w.origin AND g.sid = c.sid AND g.slot = c.slot CROSS JOIN range(5) r(i))
SELECT sid, origin, h, ts, sample_id, {rd(f'mu + sd * {sql_ppf("u")}')} AS y_hat FROM f""")
def gauss_refit_paths(spark, d):
    """Normal paths with the moments of each origin's own history, from one pass over the panel."""
    return rounded(M.explode_samples(M.forecast("gauss_refit", panel(spark, d), settings(spark, d, samples=5))), "y_hat")


@query("nb_refit_paths", f"""WITH {P15}, {CELLS}, {SQL_ROLLS}, p0 AS (SELECT origin, sid, slot, avg(y) AS mu, var_samp(y) AS var FROM cells JOIN w ON idx < origin GROUP BY 1, 2, 3),
 params AS (SELECT *, {SHAPE} AS shape FROM p0), {sql_nb_table('params', 'origin, sid, slot')},
 f AS (SELECT c.sid, c.slot, w.origin, CAST(c.idx - w.origin + 1 AS INTEGER) AS h, c.ts, CAST(i AS INTEGER) AS sample_id,
   {sql_uniform('s', 'c.sid', 'w.origin', '(c.idx - w.origin + 1)', 'i')} AS u
   FROM cells c JOIN w ON c.idx BETWEEN w.origin AND w.origin + 95 CROSS JOIN range(20) r(i))
SELECT f.sid, f.origin, f.h, f.ts, f.sample_id, CAST(coalesce(min(k) FILTER (cdf >= u), max(k)) AS DOUBLE) AS y_hat
FROM f JOIN table_ t ON t.origin = f.origin AND t.sid = f.sid AND t.slot = f.slot GROUP BY 1, 2, 3, 4, 5""")
def nb_refit_paths(spark, d):
    """Count paths with the moments of each origin's own history."""
    return _paths("nb_refit")(spark, d)


def sql_gamma_slope(x: str, order: int) -> str:
    """First (0) or second (1) derivative of ln Gamma, by the same series."""
    z = f"({x} + {N.STIRLING_SHIFT}.0)"
    if order == 0:
        parts = [f"ln({z}) - 0.5 / {z} - {sql_horner(N.DIGAMMA[::-1], f'(1.0::DOUBLE / ({z} * {z}))')} / ({z} * {z})"]
        return "(" + " - ".join(parts + [f"1.0 / ({x} + {i}.0)" for i in range(N.STIRLING_SHIFT)]) + ")"
    parts = [f"1.0 / {z} + 0.5 / ({z} * {z}) + {sql_horner(N.TRIGAMMA[::-1], f'(1.0::DOUBLE / ({z} * {z}))')} / ({z} * {z} * {z})"]
    return "(" + " + ".join(parts + [f"1.0 / (({x} + {i}.0) * ({x} + {i}.0))" for i in range(N.STIRLING_SHIFT)]) + ")"


def sql_count_fit(source: str) -> str:
    """CTE ``fit`` (b0, b1, theta): Fisher scoring of the counts y of ``source`` on x, in recursive rounds."""
    low, high = M.LOG_SHAPE_BOUNDS
    slope = f"{sql_gamma_slope('(y + r)', 0)} - {sql_gamma_slope('r', 0)} + ln(r / (r + m)) + 1.0 - (y + r) / (r + m)"
    bend = f"{sql_gamma_slope('(y + r)', 1)} - {sql_gamma_slope('r', 1)} + 1.0 / r - 2.0 / (r + m) + (y + r) / ((r + m) * (r + m))"
    return f"""st AS (SELECT avg(y) AS m, var_samp(y) AS v FROM {source}),
 fs AS (SELECT 0 AS n, ln(greatest(m, 1e-6)) AS b0, 0.0::DOUBLE AS b1, CASE WHEN v > m THEN least(greatest(ln(m * m / (v - m)), {low}), {high}) ELSE {high} END::DOUBLE AS theta FROM st
  UNION ALL
  SELECT n + 1, (t0 * s11 - t1 * s01) / (s00 * s11 - s01 * s01), (t1 * s00 - t0 * s01) / (s00 * s11 - s01 * s01),
    least(greatest(theta + least(greatest(sl / (abs(be) * r), -1.0), 1.0), {low}), {high})::DOUBLE
  FROM (SELECT n, theta, r, sum(wt) AS s00, sum(wt * x) AS s01, sum(wt * x * x) AS s11, sum(wt * z) AS t0, sum(wt * x * z) AS t1, sum({slope}) AS sl, sum({bend}) AS be
    FROM (SELECT n, theta, r, x, y, m, m * r / (r + m) AS wt, eta + (y - m) / m AS z FROM
      (SELECT n, theta, exp(theta) AS r, x, y, b0 + b1 * x AS eta, exp(least(b0 + b1 * x, {M.MOST_LOG_MEAN})) AS m FROM fs, {source} WHERE n < {M.COUNT_ROUNDS})) GROUP BY n, theta, r)),
 fit AS (SELECT b0, b1, theta FROM fs WHERE n = (SELECT max(n) FROM fs))"""


SQL_LOGLAG = "ll AS (SELECT *, ln(1.0 + lag(y, 96) OVER (PARTITION BY sid ORDER BY idx)) AS x FROM cells)"


@query("nb_regression", f"""WITH RECURSIVE {P15}, {CELLS}, {SQL_LOGLAG}, src AS (SELECT x, y FROM ll WHERE x IS NOT NULL), {sql_count_fit('src')}
SELECT 'intercept' AS term, {rd('b0', 5)} AS coefficient FROM fit UNION ALL SELECT 'log_lag_96', {rd('b1', 5)} FROM fit UNION ALL SELECT 'log_shape', {rd('theta', 4)} FROM fit""")
def nb_regression(spark, d):
    """Counts on the logarithm of the count a day earlier, with their shape, by maximum likelihood over all series."""
    lagged = I.lag_features(panel(spark, d), [PER_DAY])
    beta, theta = M.nb_regression(lagged, [F.lit(1.0), F.log1p(f"lag_{PER_DAY}")], F.col("y"))
    rows = [("intercept", round(float(beta[0]), 5) + 0.0), ("log_lag_96", round(float(beta[1]), 5) + 0.0), ("log_shape", round(theta, 4) + 0.0)]
    return spark.createDataFrame(rows, "term string, coefficient double")


@query("nb_lagged_paths", f"""WITH RECURSIVE {P15}, {CELLS}, {SQL_ROLLS}, {SQL_LOGLAG},
 src AS (SELECT x, y FROM ll WHERE x IS NOT NULL AND idx < (SELECT min(origin) FROM w)), {sql_count_fit('src')},
 params AS (SELECT DISTINCT x, exp(b0 + b1 * x) AS mu, exp(theta) AS shape FROM ll, fit WHERE x IS NOT NULL), {sql_nb_table('params', 'x')},
 f AS (SELECT c.sid, c.x, w.origin, CAST(c.idx - w.origin + 1 AS INTEGER) AS h, c.ts, CAST(i AS INTEGER) AS sample_id,
   {sql_uniform('s', 'c.sid', 'w.origin', '(c.idx - w.origin + 1)', 'i')} AS u
   FROM ll c JOIN w ON c.idx BETWEEN w.origin AND w.origin + 95 CROSS JOIN range(20) r(i))
SELECT f.sid, f.origin, f.h, f.ts, f.sample_id, CAST(coalesce(min(k) FILTER (cdf >= u), max(k)) AS DOUBLE) AS y_hat FROM f JOIN table_ t ON t.x = f.x GROUP BY 1, 2, 3, 4, 5""")
def nb_lagged_paths(spark, d):
    """Count paths whose mean follows the count a day earlier."""
    return _paths("nb_lagged")(spark, d)


ENDS = [("normal", "2024-01-19 23:45:00"), ("event", "2024-01-24 06:00:00"), ("late", "2024-01-30 20:00:00")]


@query("scenario_paths", f"""WITH {P15}, {CELLS}, s AS (SELECT * FROM (VALUES {", ".join(f"('{n}', TIMESTAMP '{t}')" for n, t in ENDS)}) v(scenario, test_end)),
 w AS (SELECT scenario, max(idx) - 95 AS origin FROM s JOIN panel ON ts <= test_end GROUP BY 1),
 g AS (SELECT scenario, sid, slot, avg(y) AS mu, stddev_samp(y) AS sd FROM cells JOIN w ON idx < origin GROUP BY 1, 2, 3),
 f AS (SELECT w.scenario, c.sid, w.origin, CAST(c.idx - w.origin + 1 AS INTEGER) AS h, c.ts, CAST(i AS INTEGER) AS sample_id, mu, sd,
   {sql_uniform('s', 'c.sid', 'w.origin', '(c.idx - w.origin + 1)', 'i')} AS u
   FROM cells c JOIN w ON c.idx BETWEEN w.origin AND w.origin + 95 JOIN g ON g.sid = c.sid AND g.slot = c.slot AND g.scenario = w.scenario CROSS JOIN range(5) r(i))
SELECT scenario, sid, origin, h, ts, sample_id, {rd(f'mu + sd * {sql_ppf("u")}')} AS y_hat FROM f""")
def scenario_paths(spark, d):
    """A registered model fitted before each named day and forecasting it."""
    fc = forecast_scenarios(materialise(panel(spark, d)), "gauss", ENDS, settings(spark, d, samples=5))
    long = fc.select("scenario", "sid", "origin", "h", "ts", F.posexplode("samples").alias("sample_id", "y_hat"))
    return rounded(long, "y_hat")


# random by numpy generators or by MLlib factors: row checks here, invariants in the tests
for _name in ("gauss_full", "gauss_full_scaled", "gauss_lowrank", "gauss_lowrank_scaled", "copula"):
    query(f"{_name}_paths")(_paths(_name))


@query("nb_draw", f"""WITH {P15}, {SQL_NB}, {SQL_CDF}, u AS (SELECT sid, slot, CAST(i AS INTEGER) AS sample_id, {sql_uniform('draw', 'sid', 'slot', 'i')} AS u FROM nb, range(100) r(i))
SELECT sid, slot, sample_id, CAST(coalesce(min(k) FILTER (cdf >= u), max(k)) AS DOUBLE) AS y_hat FROM u JOIN table_ USING (sid, slot) GROUP BY 1, 2, 3""")
def nb_draw(spark, d):
    """Draws per series and slot."""
    params = M.nb_moments(_cells(spark, d)).select("sid", "slot", "mu", "shape")
    return R.nb_samples(params, 100, "draw", ["sid", "slot"]).select("sid", "slot", F.posexplode("samples").alias("sample_id", "y_hat"))


def sql_split(source: str, keys: str, seed: str, alpha: str = "alpha") -> str:
    """CTEs down to ``parts`` (keys, i, sid, y_hat): ``source`` (keys, slot, i, total) halved over up to eight series of ``alpha``."""
    names = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in [*names, "i"])
    out = [f"""codes AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS code FROM (SELECT DISTINCT sid FROM panel)),
  ca AS (SELECT slot, code, alpha FROM {alpha} JOIN codes USING (sid)), size_ AS (SELECT count(*) AS size FROM codes),
  g8 AS (SELECT {keys}, slot, i, 0 AS low, CAST(total AS BIGINT) AS n FROM {source})"""]
    for half in (4, 2, 1):
        g = f"g{2 * half}"
        mass = (f"exp(lgamma(n + 1.0::DOUBLE) - lgamma(k + 1.0::DOUBLE) - lgamma(n - k + 1.0::DOUBLE) + {sql_rising('CAST(k AS DOUBLE)', 'a')}"
                f" + {sql_rising('CAST(n - k AS DOUBLE)', 'b')} - {sql_rising('CAST(n AS DOUBLE)', '(a + b)')})")
        out.append(f"""ab{half} AS (SELECT slot, low, sum(alpha) FILTER (code >= low AND code < low + {half}) AS a, sum(alpha) FILTER (code >= low + {half} AND code < low + {2 * half}) AS b
    FROM ca, (SELECT DISTINCT low FROM {g}) GROUP BY 1, 2),
  m{half} AS (SELECT {keys}, slot, i, low, n, k, {mass} AS pmf FROM (SELECT {g}.*, a, b, unnest(generate_series(0, n)) AS k FROM {g} JOIN ab{half} USING (slot, low), size_ WHERE low + {half} < size)),
  c{half} AS (SELECT *, sum(pmf) OVER (PARTITION BY {keys}, i, low ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM m{half}),
  l{half} AS (SELECT {keys}, slot, i, low, n, coalesce(min(k) FILTER (cdf >= {sql_uniform(seed, *names, 'low', str(half), 'i')}), n) AS part FROM c{half} GROUP BY {keys}, slot, i, low, n),
  g{half} AS (SELECT {keys}, slot, i, low, part AS n FROM l{half} UNION ALL SELECT {keys}, slot, i, low + {half}, n - part FROM l{half}
    UNION ALL SELECT {keys}, slot, i, low, n FROM {g}, size_ WHERE low + {half} >= size)""")
    return ",\n  ".join([*out, f"parts AS (SELECT {keys}, i, sid, CAST(n AS DOUBLE) AS y_hat FROM g1 JOIN codes ON low = code)"])


@query("dm_split", f"""WITH {P15}, {SQL_TOTAL_NB}, {SQL_ALPHA}, src AS (SELECT idx, slot, 0 AS i, total FROM tot WHERE total > 0), {sql_split('src', 'idx', 'split')}
SELECT idx, sid, y_hat FROM parts""")
def dm_split(spark, d):
    """Every observed total split over the series."""
    p = materialise(panel(spark, d))
    cells = M.with_slot(p)
    observed = M.with_slot(P.totals(p)).filter("total > 0").select("idx", "slot", F.array("total").alias("counts"))
    parts = R.dm_split(observed, M.dirichlet_moments(cells), ["idx"], "slot", "split", fan_out=2)
    return parts.select("idx", "sid", F.col("counts")[0].alias("y_hat"))


def sql_share(samples: int) -> str:
    """CTEs down to ``shared`` (sid, roll, origin, h, ts, y, i, y_hat): totals drawn per step and split over the series."""
    limit = f"{M.ALPHA_TOTAL_LIMIT!r}::DOUBLE"

    def alphas(moments: str, by: str) -> str:
        a0 = f"least(greatest(coalesce(sum(m * (1.0 - m)) / nullif(sum(v), 0.0) - 1.0, {limit}), {M.ALPHA_FLOOR!r}::DOUBLE), {limit})"
        return f"SELECT {by} {a0} AS a FROM {moments}" + (" GROUP BY slot" if by else "")

    return f"""{P15}, {CELLS}, {SQL_TRAIN.replace("AS origin FROM", "AS origin, i AS roll FROM")},
  tt AS (SELECT idx, slot, sum(y) AS total FROM tr GROUP BY 1, 2),
  q0 AS (SELECT slot, avg(total) AS mu, var_samp(total) AS var FROM tt GROUP BY 1), q1 AS (SELECT avg(total) AS mu, var_samp(total) AS var FROM tt),
  rows_ AS (SELECT c.sid, c.slot, w.roll, w.origin, CAST(c.idx - w.origin + 1 AS INTEGER) AS h, c.ts, c.y FROM cells c JOIN w ON c.idx BETWEEN w.origin AND w.origin + 95),
  spar AS (SELECT *, {SHAPE} AS shape FROM (SELECT DISTINCT r.slot, coalesce(q0.mu, q1.mu, 0.0) AS mu, CASE WHEN q0.mu IS NOT NULL THEN q0.var ELSE q1.var END AS var
    FROM rows_ r LEFT JOIN q0 ON q0.slot = r.slot CROSS JOIN q1)), {sql_nb_table('spar', 'slot').replace('mass AS', 'smass AS').replace('FROM mass)', 'FROM smass)').replace('table_ AS', 'stable AS')},
  us AS (SELECT DISTINCT origin, h, slot, i, {sql_uniform('s', 'origin', 'h', 'i')} AS u FROM rows_, range({samples}) s(i)),
  src AS (SELECT us.origin, us.h, us.slot, us.i, greatest(coalesce(min(k) FILTER (cdf >= u), max(k)), 1) AS total FROM us JOIN stable t ON t.slot = us.slot GROUP BY 1, 2, 3, 4),
  sh AS (SELECT tr.sid, tr.slot, tr.y / tt.total AS p FROM tr JOIN tt ON tr.idx = tt.idx WHERE tt.total <> 0),
  ms AS (SELECT slot, sid, avg(p) AS m, var_samp(p) AS v FROM sh GROUP BY 1, 2), a0 AS ({alphas('ms', 'slot,')}),
  mw AS (SELECT sid, avg(p) AS m, var_samp(p) AS v FROM sh GROUP BY 1), aw AS ({alphas('mw', '')}),
  alpha AS (SELECT c.slot, c.sid, coalesce(greatest(a0.a * ms.m, {M.ALPHA_FLOOR!r}::DOUBLE), greatest(aw.a * mw.m, {M.ALPHA_FLOOR!r}::DOUBLE), 1.0) AS alpha
    FROM (SELECT DISTINCT slot, sid FROM rows_) c LEFT JOIN ms ON ms.slot = c.slot AND ms.sid = c.sid LEFT JOIN a0 ON a0.slot = ms.slot
    LEFT JOIN mw ON mw.sid = c.sid CROSS JOIN aw), {sql_split('src', 'origin, h', 's')},
  shared AS (SELECT r.sid, r.roll, r.origin, r.h, r.ts, r.y, p.i, p.y_hat FROM rows_ r JOIN parts p ON p.sid = r.sid AND p.origin = r.origin AND p.h = r.h)"""


@query("nb_share_paths", f"WITH {sql_share(20)} SELECT sid, origin, h, ts, CAST(i AS INTEGER) AS sample_id, y_hat FROM shared")
def nb_share_paths(spark, d):
    """Totals and shares, both by inversion of keyed uniforms, so SQL draws the same counts."""
    return _paths("nb_share")(spark, d)


@query("saved_share_paths", ORACLES["nb_share_paths"])
def saved_share_paths(spark, d):
    """The headline model's forecast from tables that were fitted, saved and loaded."""
    p, s, path = materialise(panel(spark, d)), settings(spark, d), scratch_path(spark, "model")
    fit, predict = M.FITTED["nb_share"]
    tables = fit(p, s)
    save_parameters(tables, path)
    return M.explode_samples(predict(p, load_parameters(spark, path, list(tables)), s))


@query("lag_regression", f"""WITH {P15}, l AS (SELECT y, lag(y, 96) OVER (PARTITION BY sid ORDER BY idx) AS x FROM panel)
SELECT 'intercept' AS term, {rd('regr_intercept(y, x)')} AS coefficient FROM l UNION ALL SELECT 'lag_96', {rd('regr_slope(y, x)')} FROM l""")
def lag_regression(spark, d):
    """Least squares on the value a day earlier, over all series."""
    train = I.lag_features(panel(spark, d), [96]).filter("lag_96 IS NOT NULL")
    model, _ = M.lag_regression(train, ["lag_96"])
    rows = [("intercept", float(model.intercept)), ("lag_96", float(model.coefficients[0]))]
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"), "coefficient")


@query("poisson_regression")
def poisson_regression(spark, d):
    """Poisson regression on scaled lags, daily Fourier position and weekday; fitted mean per value."""
    from tallycast.operators.calendar import daily_fourier, weekday_onehot

    p = panel(spark, d)
    lagged = I.scale_columns(I.lag_features(p, [1, 4, 96]).join(I.mean_scale(p, ["sid"]), "sid"), ["lag_1", "lag_4", "lag_96"])
    cov = lagged.filter("lag_96 IS NOT NULL").select(
        "sid", "ts", "y", "lag_1_scaled", "lag_4_scaled", "lag_96_scaled",
        *daily_fourier(F.col("ts"))[:1], *daily_fourier(F.col("ts"))[4:5], *weekday_onehot(F.col("ts"))[1:])
    inputs = [c for c in cov.columns if c not in ("sid", "ts", "y")]
    model, assembled = M.lag_regression(cov, inputs, family="poisson")
    return model.transform(assembled).select("sid", "ts", "y", F.col("prediction").alias("mu"))


@query("flagship_bands", f"""WITH {sql_share(50)}, o AS (SELECT sid, roll, h, ts, y, list_sort(list(y_hat)) AS o FROM shared GROUP BY 1, 2, 3, 4, 5)
SELECT sid, roll, h, ts, y, {", ".join(f"o[CAST(round_even((len(o) - 1) * {q!r}::DOUBLE, 0) AS INTEGER) + 1] AS p{round(q * 100):02d}" for q in (0.05, 0.5, 0.95))} FROM o""")
def flagship_bands(spark, d):
    """Quantile bands of the total-and-shares forecaster over the rolling origins."""
    return bands(M.forecast("nb_share", panel(spark, d), settings(spark, d, samples=50)))

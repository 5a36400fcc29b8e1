"""Lags, scales, windows, cut points and marginal transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog.covariates import SQL_WEIGHTS, rolling_weight
from tallycast.catalog.registry import (
    PER_DAY, STEP, events, grid, last, panel, query, rd, rounded, sql_cdf, sql_panel, sql_ppf, sql_uniform,
)
from tallycast.functions.numeric import log_positive
from tallycast.operators import instances as I
from tallycast.operators import marginal as M
from tallycast.operators import panel as P
from tallycast.operators import weights as W
from tallycast.operators.covariates import replicate_over_series
from tallycast.operators.draws import dequantise, sample_paths

P15 = sql_panel()
LAGS = [1, 2, 4, 12, 24, 48]


def _lag_sql(lags, value="y", partition="sid", shift=0, prefix="lag"):
    over = f"OVER (PARTITION BY {partition} ORDER BY idx)" if partition else "OVER (ORDER BY idx)"
    return ", ".join(f"lag({value}, {k - shift}) {over} AS {prefix}_{k}" for k in lags)


@query("lag_features", f"WITH {P15} SELECT sid, ts, y, {_lag_sql(LAGS)} FROM panel")
def lag_features(spark, d):
    return I.lag_features(panel(spark, d), LAGS, block=1024).drop("idx")


@query("shifted_lags", f"WITH {P15} SELECT sid, ts, y, {_lag_sql(LAGS, shift=1)} FROM panel")
def shifted_lags(spark, d):
    """Decoding lags: lag 1 is the last known value."""
    return I.lag_features(panel(spark, d), LAGS, shift=1).drop("idx")


@query("total_lags", f"WITH {P15}, t AS (SELECT ts, idx, sum(y) AS total FROM panel GROUP BY 1, 2) SELECT ts, total, {_lag_sql(LAGS, 'total', '')} FROM t")
def total_lags(spark, d):
    return I.lag_features(P.totals(panel(spark, d)), LAGS, keys=(), value="total", block=1024).drop("idx")


SQL_SCALE = "scales AS (SELECT sid, greatest(avg(abs(y)), 1e-10) AS scale FROM panel GROUP BY sid)"


@query("mean_scale", f"""WITH {P15}, s AS (SELECT sid, sum(abs(coalesce(v, 0.0))) AS s, count(v) AS n FROM panel, (SELECT max(idx) AS b FROM panel)
  WHERE idx > b - {PER_DAY} GROUP BY sid)
SELECT sid, {rd('greatest(coalesce(s / nullif(n, 0), (SELECT sum(s) / greatest(sum(n), 1.0) FROM s)), 1e-10)')} AS scale,
{rd('ln(greatest(coalesce(s / nullif(n, 0), (SELECT sum(s) / greatest(sum(n), 1.0) FROM s)), 1e-10))')} AS log_scale FROM s""")
def mean_scale(spark, d):
    """Scale of each series over the last day's observed values, and its log as a static feature."""
    p = P.value_panel(events(spark, d), "event_type", "value", minutes=STEP)
    s = I.mean_scale(P.tail(p, PER_DAY, last=last(spark, d)), ["sid"])
    return rounded(s.withColumn("log_scale", log_positive(F.col("scale"))), "scale", "log_scale")


@query("mean_scale_users", f"""WITH {sql_panel(60, 'user_id')}, s AS (SELECT sid, sum(abs(v)) AS s, count(v) AS n FROM panel,
  (SELECT max(idx) AS b FROM panel) WHERE idx > b - 24 GROUP BY sid), a AS (SELECT sum(s) / greatest(sum(n), 1) AS fallback FROM s)
SELECT sid, {rd('greatest(coalesce(s / nullif(n, 0), fallback), 1e-10)')} AS scale FROM s, a""")
def mean_scale_users(spark, d):
    """Many series, some without observations on the last day: they take the mean over the others."""
    e = events(spark, d)
    p = P.value_panel(e, "user_id", "value", minutes=60)
    return rounded(I.mean_scale(P.tail(p, 24, last=last(spark, d, 60)), ["sid"]), "scale")


@query("scaled_lags", f"""WITH {P15}, {SQL_SCALE}, l AS (SELECT sid, ts, y, {_lag_sql([1, 4, 96])} FROM panel)
SELECT l.sid, ts, {", ".join(f"{rd(f'lag_{k} / scale')} AS lag_{k}_scaled" for k in (1, 4, 96))} FROM l JOIN scales s ON l.sid = s.sid""")
def scaled_lags(spark, d):
    p = panel(spark, d)
    scaled = I.scale_columns(I.lag_features(p, [1, 4, 96]).join(I.mean_scale(p, ["sid"]), "sid"), ["lag_1", "lag_4", "lag_96"])
    names = [f"lag_{k}_scaled" for k in (1, 4, 96)]
    return rounded(scaled.select("sid", "ts", *names), *names)


@query("scaled_total_lags", f"""WITH {P15}, {SQL_SCALE}, t AS (SELECT ts, idx, sum(y) AS total FROM panel GROUP BY 1, 2),
l AS (SELECT ts, total, {_lag_sql([1, 4, 96], 'total', '')} FROM t), z AS (SELECT sum(scale) AS total_scale FROM scales)
SELECT ts, {rd('total_scale')} AS total_scale, {", ".join(f"{rd(f'lag_{k} / total_scale')} AS lag_{k}_scaled" for k in (1, 4, 96))} FROM l, z""")
def scaled_total_lags(spark, d):
    """Lags of the total over the sum of the series' scales."""
    p = panel(spark, d)
    scale = I.total_scale(I.mean_scale(p, ["sid"])).scalar()
    lags = I.lag_features(P.totals(p), [1, 4, 96], keys=(), value="total").withColumn("total_scale", scale)
    names = [f"lag_{k}_scaled" for k in (1, 4, 96)]
    out = I.scale_columns(lags, ["lag_1", "lag_4", "lag_96"], "total_scale")
    return rounded(out.select("ts", "total_scale", *names), "total_scale", *names)


@query("masked_average", f"""WITH {P15} SELECT sid, {rd('sum(CASE WHEN v IS NOT NULL THEN v * y ELSE 0.0 END) / nullif(sum(CASE WHEN v IS NOT NULL THEN y ELSE 0 END), 0)')} AS weighted,
{rd('sum(CASE WHEN v IS NOT NULL THEN v ELSE 0.0 END) / count(*)')} AS with_zeros FROM panel GROUP BY sid""")
def masked_average(spark, d):
    """Count-weighted mean value, and the mean with unobserved steps as zeros."""
    e = events(spark, d)
    both = P.value_panel(e, "event_type", "value", minutes=STEP).withColumnRenamed("y", "v").join(
        panel(spark, d).select("sid", "ts", F.col("y").alias("n")), ["sid", "ts"])
    seen = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0.0)
    out = both.groupBy("sid").agg(
        I.masked_average(F.coalesce("v", F.lit(0.0)), seen).alias("weighted"),
        I.masked_average(F.coalesce("v", F.lit(0.0)), I.observed(F.col("v")), zeros_in_denominator=True).alias("with_zeros"))
    return rounded(out, "weighted", "with_zeros")


@query("observed_mask", f"""WITH {P15} SELECT sid, ts, CAST(v IS NOT NULL AS INTEGER) AS observed, {rd('coalesce(v, 0.0)')} AS filled,
CAST(min(CAST(v IS NOT NULL AS INTEGER)) OVER (PARTITION BY ts) AS INTEGER) AS all_observed FROM panel""")
def observed_mask(spark, d):
    p = P.value_panel(events(spark, d), "event_type", "value", minutes=STEP)
    marked = p.select("sid", "ts", I.observed(F.col("y")).alias("observed"), F.coalesce("y", F.lit(0.0)).alias("filled"))
    return rounded(marked.join(I.step_observed(marked), "ts"), "filled")


PULL = 2 / 3


@query("impute_forward", f"""WITH RECURSIVE {P15}, m AS (SELECT sid, hour(ts) AS slot, avg(v) AS mu FROM panel GROUP BY 1, 2), w AS (SELECT sid, avg(v) AS mu FROM panel GROUP BY 1),
q AS (SELECT p.sid, p.idx, p.ts, p.v, coalesce(m.mu, w.mu) AS mu FROM panel p LEFT JOIN m ON m.sid = p.sid AND m.slot = hour(p.ts) LEFT JOIN w ON w.sid = p.sid),
r AS (SELECT sid, idx, ts, CASE WHEN v IS NULL THEN mu * (1.0 - {PULL!r}::DOUBLE) ELSE v END AS f FROM q WHERE idx = 0
  UNION ALL SELECT q.sid, q.idx, q.ts, CASE WHEN q.v IS NULL THEN q.mu * (1.0 - {PULL!r}::DOUBLE) + {PULL!r}::DOUBLE * r.f ELSE q.v END FROM r JOIN q ON q.sid = r.sid AND q.idx = r.idx + 1)
SELECT sid, ts, {rd('f')} AS filled FROM r""")
def impute_forward(spark, d):
    """Mean values per step, gaps filled from the step before, which may be filled itself, and the mean of the hour."""
    p = P.value_panel(events(spark, d), "event_type", "value", minutes=STEP).withColumn("slot", F.hour("ts"))
    means = p.groupBy("sid", "slot").agg(F.avg("y").alias("mu")).join(p.groupBy("sid").agg(F.avg("y").alias("_whole")), "sid")
    ready = p.join(means, ["sid", "slot"])
    filled = I.impute_forward(ready, F.coalesce("mu", "_whole"), PULL, block=64)
    return rounded(filled.select("sid", "ts", "filled"), "filled")


@query("impute_unobserved", f"""WITH {P15}, m AS (SELECT sid, hour(ts) AS slot, avg(v) AS mu FROM panel GROUP BY 1, 2)
SELECT p.sid, p.ts, {rd('CASE WHEN v IS NOT NULL THEN v WHEN idx < 24 THEN 0.0 ELSE mu END')} AS y FROM panel p JOIN m ON p.sid = m.sid AND hour(p.ts) = m.slot""")
def impute_unobserved(spark, d):
    """Gaps take their slot's mean; the first six hours play the padding and become 0."""
    p = P.value_panel(events(spark, d), "event_type", "value", minutes=STEP).withColumn("slot", F.hour("ts"))
    means = p.groupBy("sid", "slot").agg(F.avg("y").alias("mu"))
    pad = (F.col("idx") < 24).cast("int")
    filled = I.impute(F.col("y"), I.observed(F.col("y")), pad, F.col("mu"))
    return rounded(p.join(means, ["sid", "slot"]).select("sid", "ts", filled.alias("y")), "y")


# --- windows at cut points ----------------------------------------------------------------------

CUTS = (30, 500, 2000)


def _cuts(spark, d):
    return P.event_series(events(spark, d), "event_type").withColumn("cut", F.explode(F.array(*[F.lit(c).cast("long") for c in CUTS])))


SQL_CUTS = f"cuts AS (SELECT DISTINCT sid, unnest({list(CUTS)})::BIGINT AS cut FROM panel)"


@query("past_future_windows", f"""WITH {P15}, {SQL_CUTS}, o AS (
 SELECT sid, cut, 'past' AS part, CAST(i AS INTEGER) AS pos, cut - 96 + i AS idx FROM cuts, range(96) r(i) UNION ALL
 SELECT sid, cut, 'future', CAST(i AS INTEGER), cut + 2 + i FROM cuts, range(24) r(i))
SELECT o.sid, o.cut, o.part, o.pos, CASE WHEN o.idx < 0 THEN 0.0 ELSE p.y END AS y, CAST(o.idx < 0 AS INTEGER) AS is_pad
FROM o LEFT JOIN panel p ON o.sid = p.sid AND o.idx = p.idx WHERE part = 'past' OR p.y IS NOT NULL""")
def past_future_windows(spark, d):
    """A day back and six hours on with a lead of two steps; the earliest cut needs padding."""
    return I.windows_at(_cuts(spark, d), panel(spark, d), past=96, future=24, lead=2)


@query("pad_indicator", f"""WITH {P15}, {SQL_CUTS}, o AS (SELECT sid, cut, i, cut - 96 + i AS idx FROM cuts, range(96) r(i))
SELECT o.sid, o.cut, CAST(sum(CASE WHEN o.idx < 0 THEN 1 ELSE 0 END) AS BIGINT) AS padded, sum(coalesce(p.y, -1.0)) AS past_sum,
 CAST(min(CASE WHEN p.y IS NOT NULL AND o.idx >= 0 THEN 1 ELSE 0 END) AS INTEGER) AS all_observed,
 (l.a + to_minutes(CAST((o.cut + 2) * 15 AS BIGINT))) AS forecast_start
FROM o CROSS JOIN lim l LEFT JOIN panel p ON o.sid = p.sid AND o.idx = p.idx GROUP BY o.sid, o.cut, l.a""")
def pad_indicator(spark, d):
    """Nested windows: how much is padding (-1), what is observed, when the forecast starts."""
    rows = I.windows_at(_cuts(spark, d), panel(spark, d), past=96, future=24, lead=2, dummy=-1.0)
    nested = I.nest_windows(rows)
    seen = F.zip_with("past", "past_is_pad", lambda y, pad: I.observed(y, pad))
    start = P.event_bounds(events(spark, d), minutes=STEP).select("a").scalar()
    return nested.select(
        "sid", "cut",
        F.aggregate("past_is_pad", F.lit(0).cast("long"), lambda a, v: a + v).alias("padded"),
        F.aggregate("past", F.lit(0.0), lambda a, v: a + v).alias("past_sum"),
        F.array_min(seen).alias("all_observed"),
        I.forecast_start(start, F.col("cut"), STEP, lead=2).alias("forecast_start"),
    )


@query("last_split", f"WITH {P15} SELECT sid, max(idx) + 1 - 96 AS cut FROM panel GROUP BY sid HAVING max(idx) + 1 - 96 >= 672")
def last_split(spark, d):
    return I.last_cut(I.series_lengths(panel(spark, d)), min_past=672, min_future=PER_DAY, allow_empty=False)


@query("validation_split", """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS sid, count(DISTINCT time_bucket(INTERVAL '60 minutes', ts)) AS n FROM events GROUP BY 1)
SELECT sid, n - 24 AS cut FROM r WHERE n - 24 >= 40""")
def validation_split(spark, d):
    """Series of different lengths (active hours of a user); too short ones have no cut."""
    active = P.bucket_counts(events(spark, d), "user_id", minutes=60)
    lengths = active.groupBy("sid").agg(F.count("*").alias("length"))
    return I.last_cut(lengths, min_past=40, min_future=24)


# --- cut points by weight -----------------------------------------------------------------------


def _weight_table(spark, d):
    """One row of weights shared by two copies of the steps: the real weights and an all-zero set."""
    both = F.array(F.struct(F.lit("rolling").alias("sid"), F.col("weight")), F.struct(F.lit("zero").alias("sid"), F.lit(0).cast("long").alias("weight")))
    return rolling_weight(spark, d).select("idx", F.inline(both))


SQL_CUTTABLE = f"""{P15}, {SQL_WEIGHTS}, wt AS (SELECT 'rolling' AS sid, idx, weight FROM rolled UNION ALL SELECT 'zero', idx, 0 FROM rolled),
 inside AS (SELECT * FROM wt WHERE idx >= 48 AND idx < (SELECT max(idx) + 1 FROM wt) - 96),
 mass AS (SELECT sid, idx, weight, CASE WHEN sum(abs(weight)) OVER (PARTITION BY sid) > 0 THEN CAST(abs(weight) AS DOUBLE) ELSE 1.0::DOUBLE END AS w FROM inside),
 cum AS (SELECT sid, idx, weight, w, sum(w) OVER (PARTITION BY sid ORDER BY idx) AS c, sum(w) OVER (PARTITION BY sid) AS t FROM mass),
 cuttable AS (SELECT sid, idx, weight, (c - w) / t AS p_lo, c / t AS p_hi FROM cum)"""


def _cut_table(spark, d):
    return W.cut_table(_weight_table(spark, d), min_past=48, min_future=96, length=last(spark, d) + 1, block=512)


@query("weighted_cut_table", f"WITH {SQL_CUTTABLE} SELECT sid, idx, weight, {rd('p_lo', 9)} AS p_lo, {rd('p_hi', 9)} AS p_hi FROM cuttable")
def weighted_cut_table(spark, d):
    return rounded(_cut_table(spark, d), "p_lo", "p_hi", digits=9)


@query("weighted_cut_draw", f"""WITH {SQL_CUTTABLE}, w AS (SELECT s.sid, CAST(i AS INTEGER) AS draw, {sql_uniform('cut', 's.sid', 'i')} AS u
  FROM (SELECT DISTINCT sid FROM wt) s, range(200) r(i))
SELECT w.sid, w.draw, t.idx AS cut FROM w JOIN cuttable t ON t.sid = w.sid AND w.u >= t.p_lo AND w.u < t.p_hi""")
def weighted_cut_draw(spark, d):
    series = spark.createDataFrame([("rolling",), ("zero",)], "sid string")
    return W.draw_cuts(_cut_table(spark, d), draws=200, seed="cut", series=series)


@query("uniform_cut_draw", f"""WITH {P15}, u AS (SELECT sid, idx, {sql_uniform('uni', 'sid', 'idx')} AS u FROM panel)
SELECT sid, idx AS cut FROM u, (SELECT max(idx) + 1 AS n FROM panel) WHERE idx >= 48 AND idx <= n - 96 AND u < 20.0::DOUBLE / (n - 96 - 48 + 1)""")
def uniform_cut_draw(spark, d):
    return W.uniform_cuts(panel(spark, d), expected=20, min_past=48, min_future=96, seed="uni", length=last(spark, d) + 1)


@query("series_subset", f"""WITH s AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS code FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sid FROM events)),
 n AS (SELECT CAST(count(*) AS INTEGER) AS d FROM s),
 c AS (SELECT DISTINCT CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS cut FROM events),
 a AS (SELECT cut, d, CAST(floor({sql_uniform('sub', 'cut', 'd - 3')} * (d - 2)) AS INTEGER) AS a FROM c, n),
 b0 AS (SELECT *, CAST(floor({sql_uniform('sub', 'cut', 'd - 2')} * (d - 1)) AS INTEGER) AS p FROM a),
 b AS (SELECT *, CASE WHEN p = a THEN d - 2 ELSE p END AS b FROM b0),
 e0 AS (SELECT *, CAST(floor({sql_uniform('sub', 'cut', 'd - 1')} * d) AS INTEGER) AS q FROM b),
 e AS (SELECT *, CASE WHEN q IN (a, b) THEN d - 1 ELSE q END AS e FROM e0),
 picked AS (SELECT cut, unnest([a, b, e]) AS code FROM e)
SELECT cut, sid FROM picked JOIN s ON s.code = picked.code""")
def series_subset(spark, d):
    """Three of all users for every hour with events."""
    e = events(spark, d)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    cuts = e.select(F.timestamp_diff("HOUR", start, F.col("ts")).alias("cut")).distinct()
    codes = P.series_codes(e.select(F.col("user_id").cast("string").alias("sid")))
    return W.series_subset(cuts, codes, 3, "sub")


@query("dequantise", f"WITH {P15} SELECT sid, ts, {rd('y + ' + sql_uniform('deq', 'sid', 'idx'))} AS y FROM panel")
def dequantise_counts(spark, d):
    p = panel(spark, d)
    return rounded(p.select("sid", "ts", dequantise(F.col("y"), "deq", F.col("sid"), F.col("idx")).alias("y")), "y")


@query("replicate_paths", f"WITH {P15} SELECT sid, ts, y, CAST(i AS INTEGER) AS sample_id FROM panel, range(4) r(i)")
def replicate_paths(spark, d):
    return sample_paths(panel(spark, d), 4).drop("idx")


@query("training_instances", f"""WITH {SQL_CUTTABLE}, w AS (SELECT CAST(i AS INTEGER) AS draw, {sql_uniform('cut', "'rolling'", 'i')} AS u FROM range(8) r(i)),
 cuts AS (SELECT DISTINCT t.idx AS cut FROM w JOIN cuttable t ON t.sid = 'rolling' AND w.u >= t.p_lo AND w.u < t.p_hi),
 feat AS (SELECT idx, {rd('sin(2.0 * pi() * dayofyear(ts) / 365.0)')} AS year_sin1 FROM steps),
 o AS (SELECT cut, 'past' AS part, CAST(i AS INTEGER) AS pos, cut - 144 + i AS idx FROM cuts, range(144) r(i) UNION ALL
  SELECT cut, 'future', CAST(i AS INTEGER), cut + i FROM cuts, range(96) r(i))
SELECT k.sid, o.cut, o.part, o.pos, CASE WHEN o.idx < 0 THEN 0.0 ELSE p.y END AS y, CASE WHEN o.idx < 0 THEN 0.0 ELSE f.year_sin1 END AS year_sin1,
 CAST(o.idx < 0 AS INTEGER) AS is_pad FROM o CROSS JOIN (SELECT DISTINCT sid FROM panel) k LEFT JOIN panel p ON p.sid = k.sid AND p.idx = o.idx LEFT JOIN feat f ON f.idx = o.idx""")
def training_instances(spark, d):
    """Weighted cut points shared by all series, and the windows of counts and covariates around them."""
    from tallycast.operators.calendar import annual_fourier

    cov = rounded(grid(spark, d).select("ts", annual_fourier(F.col("ts"))[0]), "year_sin1")
    table = _cut_table(spark, d).filter("sid = 'rolling'")
    drawn = W.draw_cuts(table, 8, "cut", series=spark.createDataFrame([("rolling",)], "sid string")).select("cut").distinct()
    series = P.event_series(events(spark, d), "event_type")
    shared = drawn.agg(F.collect_list("cut")).scalar()  # as many cuts as were drawn
    cuts = series.withColumn("_c", shared).select("sid", F.explode("_c").alias("cut"))
    rows = replicate_over_series(panel(spark, d), cov, ["year_sin1"])
    return I.windows_at(cuts, rows, past=144, future=96, values=("y", "year_sin1"))


# --- marginal transform -------------------------------------------------------------------------

CONDITIONING = 100
_DELTA = M.clip_margin(CONDITIONING)
SQL_RECENT = f"recent AS (SELECT sid, y, ts FROM panel, (SELECT max(idx) AS b FROM panel) WHERE idx > b - {CONDITIONING})"


@query("marginal_window", f"""WITH {P15}, {SQL_RECENT}, f AS (SELECT sid, ts, y, least(greatest(cume_dist() OVER (PARTITION BY sid ORDER BY y), {_DELTA}::DOUBLE), 1.0 - {_DELTA}::DOUBLE) AS f FROM recent)
SELECT sid, ts, y, {rd(sql_ppf('f'))} AS z FROM f""")
def marginal_window(spark, d):
    """Normal scores of the last 100 values of each series."""
    out = M.window_gaussian(panel(spark, d), CONDITIONING, last=last(spark, d))
    return rounded(out.select("sid", "ts", "y", "z"), "z")


@query("marginal_gaussian", f"""WITH {P15}, {SQL_RECENT}, v AS (SELECT sid, y, count(*) AS n FROM panel GROUP BY 1, 2),
 f0 AS (SELECT v.sid, v.y, v.n, count(*) FILTER (r.y <= v.y) / CAST(count(*) AS DOUBLE) AS s FROM v JOIN recent r ON r.sid = v.sid GROUP BY 1, 2, 3),
 f AS (SELECT sid, y, n, least(greatest(s, {_DELTA}::DOUBLE), 1.0 - {_DELTA}::DOUBLE) AS f FROM f0)
SELECT sid, ts, y, {rd(sql_ppf('f'))} AS z FROM panel JOIN f USING (sid, y)""")
def marginal_gaussian(spark, d):
    """Normal scores of the whole panel against the recent distribution."""
    p = panel(spark, d)
    out = M.to_gaussian(p, M.sorted_recent(p, CONDITIONING, last=last(spark, d)), CONDITIONING)
    return rounded(out.select("sid", "ts", "y", "z"), "z")


@query("inverse_marginal", f"""WITH {P15}, {SQL_RECENT}, o AS (SELECT sid, list_sort(list(y)) AS a FROM recent GROUP BY sid),
 z AS (SELECT sid, ts, {sql_uniform('inv', 'sid', 'idx')} * 6.0 - 3.0 AS z FROM panel), f AS (SELECT sid, ts, z, {sql_cdf('z')} AS f FROM z)
SELECT sid, ts, {rd('z')} AS z, a[CAST(least(greatest(ceil(round(f * len(a), 9)), 1), len(a)) AS INTEGER)] AS y FROM f JOIN o USING (sid)""")
def inverse_marginal(spark, d):
    """Normal values back to counts through the recent distribution."""
    from tallycast.functions.numeric import hash_uniform

    p = panel(spark, d)
    recent = M.sorted_recent(p, CONDITIONING, last=last(spark, d))
    z = p.select("sid", "ts", (hash_uniform("inv", F.col("sid"), F.col("idx")) * 6.0 - 3.0).alias("z"))
    return rounded(M.from_gaussian(z, recent).select("sid", "ts", "z", "y"), "z")

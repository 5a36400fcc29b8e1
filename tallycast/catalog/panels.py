"""Panel building, keys, slices, reshaping, calendar covariates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.catalog.registry import (
    PER_DAY, STEP, events, grid, last, panel, query, rd, rounded, sql_days, sql_panel, sql_values,
)
from tallycast.functions.timekeys import compose_text, compose_timestamp, decimal_hour, day_key, default_lags
from tallycast.operators import calendar as C
from tallycast.operators import panel as P
from tallycast.operators.covariates import replicate_over_series, stack
from tallycast.operators.instances import mean_scale, violations
from tallycast.session import scratch_path
from tallycast.sources import schemas
from tallycast.sources.readers import delimited, school_calendar, table, weather, wide_counts
from tallycast.sources.writers import write_csv, write_panel
from tallycast.streaming.scores import score_buckets

P15 = sql_panel()


@query("bucket_counts", """SELECT CAST(event_type AS VARCHAR) AS sid, time_bucket(INTERVAL '15 minutes', ts) AS ts, count(*) AS n
FROM events GROUP BY 1, 2""")
def bucket_counts(spark, d):
    return P.bucket_counts(events(spark, d), "event_type", minutes=STEP)


@query("dense_panel", f"WITH {P15} SELECT sid, ts, idx, y FROM panel")
def dense_panel(spark, d):
    return panel(spark, d)


@query("value_panel", f"WITH {P15} SELECT sid, ts, idx, {rd('v')} AS y FROM panel")
def value_panel(spark, d):
    return rounded(P.value_panel(events(spark, d), "event_type", "value", minutes=STEP), "y")


@query("wide_pivot", f"""WITH {P15} SELECT ts, {", ".join(f"sum(y) FILTER (sid = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view"))}
FROM panel GROUP BY ts""")
def wide_pivot(spark, d):
    levels = P.level_list(P.event_series(events(spark, d), "event_type"), "sid")
    return P.to_wide(panel(spark, d), levels)


@query("unpivot_long", f"""WITH w AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS quantity,
  avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1)
SELECT ts, 'quantity' AS sid, {rd('quantity')} AS y FROM w UNION ALL
SELECT ts, 'discount', {rd('discount')} FROM w UNION ALL SELECT ts, 'tax', {rd('tax')} FROM w""")
def unpivot_long(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    return rounded(P.to_long(wide, ["quantity", "discount", "tax"]), "y")


@query("orders_by_nation_daily", """WITH r AS (SELECT n.n_name AS sid, date_trunc('day', o.o_orderdate)::TIMESTAMP AS ts
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
 lim AS (SELECT min(ts) AS a, max(ts) AS b FROM r),
 g AS (SELECT unnest(generate_series(a, b, INTERVAL '1 day')) AS ts, a FROM lim),
 c AS (SELECT sid, ts, count(*) AS n FROM r GROUP BY 1, 2)
SELECT k.sid, g.ts, CAST(date_diff('day', g.a, g.ts) AS BIGINT) AS idx, CAST(coalesce(c.n, 0) AS DOUBLE) AS y
FROM (SELECT DISTINCT sid FROM r) k CROSS JOIN g LEFT JOIN c ON c.sid = k.sid AND c.ts = g.ts""")
def orders_by_nation_daily(spark, d):
    """Orders are counted per customer and day before they meet the customers, so a customer with a third
    of all orders brings one row per day to the join; nations are added up after it."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    names = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("sid"))
    counts = P.daily_counts(orders, ["o_custkey"], "o_orderdate").join(names, "o_custkey").groupBy("sid", "ts").agg(F.sum("n").alias("n"))
    return P.daily_panel(counts, counts.select("sid").distinct(), orders, "o_orderdate")


@query("csv_roundtrip", f"""SELECT event_id, event_type, {rd('value', 4)} AS value, strftime(ts, '%Y-%m-%d %H:%M') AS time
FROM events""")
def csv_roundtrip(spark, d):
    """Rows written as semicolon text and parsed back with a declared schema."""
    rows = events(spark, d).select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"))
    text = rows.select(F.to_csv(F.struct("event_id", "event_type", "value", "time"), {"sep": ";"}).alias("line"))
    parsed = text.select(F.from_csv("line", F.lit("event_id bigint, event_type string, value double, time string"), {"sep": ";"}).alias("r"))
    return rounded(parsed.select("r.*"), "value", digits=4)


@query("csv_file_scan", f"""SELECT event_id, event_type, {rd('value', 4)} AS value, strftime(ts, '%Y-%m-%d %H:%M') AS time FROM events""")
def csv_file_scan(spark, d):
    """Rows written as semicolon files with a header; four of five columns scanned back with a declared schema."""
    path = scratch_path(spark, "csv")
    rows = events(spark, d).select("event_id", "event_type", "value", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"))
    write_csv(rows, path, ";")
    schema = "event_id bigint, event_type string, value double, user_id bigint, time string"
    return rounded(delimited(spark, path, schema, ";", ["event_id", "event_type", "value", "time"]), "value", digits=4)


@query("weather_file_scan", f"""SELECT strftime(time_bucket(INTERVAL '60 minutes', ts), '%Y-%m-%d') AS date, CAST(hour(time_bucket(INTERVAL '60 minutes', ts)) AS INTEGER) AS hrr,
{rd('avg(value)')} AS temp, {rd('max(value)')} AS precip FROM events GROUP BY time_bucket(INTERVAL '60 minutes', ts)""")
def weather_file_scan(spark, d):
    """Hourly readings written with month-first dates and an index column, read back with ISO dates."""
    path = scratch_path(spark, "weather")
    hourly = events(spark, d).groupBy(P.bucket_start(F.col("ts"), 60).alias("b")).agg(F.avg("value").alias("temp"), F.max("value").alias("precip"))
    rows = hourly.select(F.lit(0).alias("row"), F.date_format("b", "M/d/yyyy").alias("date"), F.hour("b").alias("hrr"), "temp", "precip")
    write_csv(rows, path)
    return rounded(weather(spark, path, schemas.WEATHER_HOURLY), "temp", "precip")


@query("wide_counts_scan", f"WITH {P15} SELECT ts, sid, y FROM panel")
def wide_counts_scan(spark, d):
    """A wide count file with text times as its index, read as a long panel."""
    path, names = scratch_path(spark, "wide"), ["click", "error", "purchase", "signup", "view"]
    wide = P.to_wide(panel(spark, d), names).select(F.date_format("ts", "MM/dd/yyyy HH:mm").alias("row"), *[F.when(F.col(n) > 0, F.col(n)).alias(n) for n in names])
    write_csv(wide, path)
    return wide_counts(spark, path, schemas.wide_counts(names), names, "MM/dd/yyyy HH:mm")


@query("calendar_file_scan", """SELECT event_type AS zone, strftime(min(ts), '%Y') || '-' || strftime(max(ts), '%Y') AS school_year, strftime(min(ts), '%Y-%m-%d') AS date_from, strftime(max(ts), '%Y-%m-%d') AS date_to
FROM events GROUP BY event_type, user_id""")
def calendar_file_scan(spark, d):
    """Periods in a semicolon file with times behind the dates; the dates count."""
    path = scratch_path(spark, "calendar")
    spans = events(spark, d).groupBy("event_type", "user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    years = F.concat_ws("-", F.year("a").cast("string"), F.year("b").cast("string"))
    rows = spans.select(F.col("event_type").alias("zone"), F.lit("-").alias("population"), years.alias("school_year"), text("a").alias("date_from"), text("b").alias("date_to"))
    write_csv(rows, path, ";")
    found = school_calendar(spark, path, schemas.SCHOOL_CALENDAR)
    return found.select("zone", "school_year", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("date_from", "date_to")])


@query("bucket_scores", f"""WITH b AS (SELECT CAST(event_type AS VARCHAR) AS sid, time_bucket(INTERVAL '15 minutes', ts) AS ts, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2)
SELECT sid, ts, y, count(*) OVER w AS seen, {rd('avg(y) OVER w')} AS mean, {rd('(y - avg(y) OVER w) / CASE WHEN stddev_samp(y) OVER w > 1e-12 THEN stddev_samp(y) OVER w END')} AS z
FROM b WINDOW w AS (PARTITION BY sid, hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def bucket_scores(spark, d):
    """Each bucket against the earlier ones of its series and hour: the batch form of the stream's scores."""
    return rounded(score_buckets(P.bucket_counts(events(spark, d), "event_type", minutes=STEP), "n"), "mean", "z")


@query("panel_file_scan", f"WITH {P15} SELECT sid, ts, idx, y FROM panel WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def panel_file_scan(spark, d):
    """A panel written by day; the scan of two days reads their folders only."""
    path = scratch_path(spark, "panel")
    write_panel(panel(spark, d), path)
    return spark.read.parquet(path).filter("day >= DATE'2024-01-10' AND day < DATE'2024-01-12'").select("sid", "ts", "idx", "y")


@query("compose_ts", r"""WITH k AS (SELECT DISTINCT time_bucket(INTERVAL '30 minutes', ts) AS b FROM events)
SELECT strftime(b, '%Y-%m-%d') AS date,
  CASE WHEN hour(b) = 0 THEN 24 ELSE hour(b) END + minute(b) / 60.0::DOUBLE AS hr,
  strftime(b, '%Y-%m-%d %H:%M') AS text, b AS ts FROM k""")
def compose_ts(spark, d):
    """Date text and decimal hour (midnight = 24) back to a timestamp."""
    steps = events(spark, d).select(P.bucket_start(F.col("ts"), 30).alias("b")).distinct()
    keyed = steps.select(day_key(F.col("b")).alias("date"), decimal_hour(F.col("b")).alias("hr"))
    return keyed.select("date", "hr", compose_text(F.col("date"), F.col("hr")).alias("text"),
                        compose_timestamp(F.col("date"), F.col("hr")).alias("ts"))


@query("decimal_hour_key", f"""WITH k AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS b, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(b, '%Y-%m-%d') AS date,
  CAST(round_even(CASE WHEN hour(b) = 0 THEN 24 ELSE hour(b) END + minute(b) / 60.0::DOUBLE, 1) AS DOUBLE) AS hr,
  CAST(hour(b) AS INTEGER) AS hrr, n FROM k""")
def decimal_hour_key(spark, d):
    counts = events(spark, d).groupBy(P.bucket_start(F.col("ts"), STEP).alias("ts")).agg(F.count("*").alias("n"))
    return C.time_keys(counts).select("date", "hr", "hrr", "n")


TRAIN_END, TEST_START, TEST_END = "2024-01-24 23:45:00", "2024-01-25 00:00:00", "2024-01-30 23:45:00"


@query("range_slice", f"""WITH {P15} SELECT part, sid, count(*) AS n, sum(y) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT 'train' AS part, * FROM panel WHERE ts <= TIMESTAMP '{TRAIN_END}' UNION ALL
  SELECT 'test', * FROM panel WHERE ts >= TIMESTAMP '{TEST_START}' AND ts <= TIMESTAMP '{TEST_END}' UNION ALL
  SELECT 'history', * FROM panel WHERE ts < TIMESTAMP '{TEST_START}') GROUP BY part, sid""")
def range_slice(spark, d):
    p = panel(spark, d)
    train, test = P.train_test(p, TRAIN_END, TEST_START, TEST_END)
    parts = {"train": train, "test": test, "history": P.history_before(p, TEST_START)}
    out = None
    for name, part in parts.items():
        rows = part.groupBy("sid").agg(
            F.count("*").alias("n"), F.sum("y").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
        ).withColumn("part", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("context_tail", f"""WITH {P15}, m AS (SELECT max(idx) AS b FROM panel),
k AS (SELECT unnest([1, 2, 3]) AS days)
SELECT CAST(k.days AS INTEGER) AS days, sid, count(*) AS n, sum(y) AS total, min(ts) AS first_ts FROM panel, m, k
WHERE idx > b - {PER_DAY} * k.days GROUP BY ALL""")
def context_tail(spark, d):
    """Last one, two and three horizons of each series, from a single tail."""
    far = P.tail(panel(spark, d), 3 * PER_DAY, last=last(spark, d)).withColumn("_end", last(spark, d))
    depth = F.floor((F.col("_end") - F.col("idx")) / PER_DAY).cast("int") + 1
    spread = far.withColumn("days", F.explode(F.sequence(depth, F.lit(3))))
    return spread.groupBy("days", "sid").agg(F.count("*").alias("n"), F.sum("y").alias("total"), F.min("ts").alias("first_ts"))


@query("cross_series_total", f"WITH {P15} SELECT ts, idx, sum(y) AS total FROM panel GROUP BY ts, idx")
def cross_series_total(spark, d):
    return P.totals(panel(spark, d))


@query("nonzero_total_mean", f"""WITH {P15}, t AS (SELECT ts, sum(y) AS total FROM panel GROUP BY ts)
SELECT {rd('sum(total) / count(*) FILTER (total <> 0) + 1.0')} AS vt FROM t""")
def nonzero_total_mean(spark, d):
    return rounded(P.nonzero_total_mean(panel(spark, d)), "vt")


@query("series_codes", """SELECT CAST(user_id AS VARCHAR) AS sid, CAST(dense_rank() OVER (ORDER BY CAST(user_id AS VARCHAR)) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT user_id FROM events)""")
def series_codes(spark, d):
    return P.series_codes(events(spark, d).select(F.col("user_id").cast("string").alias("sid")))


@query("dataset_stats", f"""WITH {sql_panel(60, 'user_id')} SELECT sid, count(*) AS length, min(ts) AS first_ts, max(ts) AS last_ts,
count(v) AS observed, {rd('sum(v)')} AS total, {rd('avg(v)')} AS mean_target FROM panel GROUP BY sid""")
def dataset_stats(spark, d):
    """Hourly value panel of every user: many series, mostly unobserved."""
    return rounded(P.dataset_stats(P.value_panel(events(spark, d), "user_id", "value", minutes=60)), "total", "mean_target")


@query("dataset_cardinality", f"""WITH {P15} SELECT count(DISTINCT sid) AS series, count(DISTINCT idx) AS steps,
CAST(5 AS BIGINT) AS default_lag_count FROM panel""")
def dataset_cardinality(spark, d):
    """Numbers of series and steps, from the series list and the grid's bounds instead of the grid."""
    series = P.event_series(events(spark, d), "event_type")
    return series.agg(F.count("*").alias("series")).select(
        "series", (last(spark, d) + 1).alias("steps"), F.lit(len(default_lags("min"))).cast("long").alias("default_lag_count"))


@query("field_select", f"""WITH {P15} SELECT sid AS item_id, ts AS start, {rd('v')} AS target, v IS NOT NULL AS has_value,
{rd('coalesce(v, 0.0)')} AS feat_static_real FROM panel""")
def field_select(spark, d):
    """Select, rename, drop, set and set-if-missing fields, on values that are missing at some steps."""
    p = P.value_panel(events(spark, d), "event_type", "value", minutes=STEP).withColumn("feat_static_real", F.col("y"))
    out = (
        p.drop("idx").withColumnsRenamed({"sid": "item_id", "ts": "start", "y": "target"})
        .withColumn("feat_static_real", F.coalesce("feat_static_real", F.lit(0.0))).withColumn("has_value", F.col("target").isNotNull())
    )
    return rounded(out, "target", "feat_static_real")


@query("check_violations", f"""WITH {sql_panel(60, 'user_id')}, f AS (SELECT sid, min(idx) FILTER (v IS NOT NULL) AS a FROM panel GROUP BY 1),
 s AS (SELECT p.sid, count(*) AS length, count(v) AS seen, min(v - 1.0) AS low, greatest(coalesce(avg(abs(v - 1.0)), 0.0), 1e-10) AS scale
  FROM panel p JOIN f ON f.sid = p.sid AND p.idx >= f.a GROUP BY 1)
SELECT sid, 'history' AS rule FROM s WHERE length < 690 + 24 UNION ALL
SELECT sid, 'scale' FROM s WHERE NOT scale > 0 UNION ALL SELECT sid, 'observed' FROM s WHERE seen = 0 UNION ALL
SELECT sid, 'support' FROM s WHERE low < 0""")
def check_violations(spark, d):
    """Checks of users from their first event on, on values less 1: some have a short history, some a negative value."""
    p = P.value_panel(events(spark, d), "user_id", "value", minutes=60)
    first = p.filter("y IS NOT NULL").groupBy("sid").agg(F.min("idx").alias("_a"))
    since = p.join(first, "sid").filter("idx >= _a").withColumn("y", F.col("y") - 1.0).drop("_a")
    return violations(since, mean_scale(since, ["sid"]), max_lag=690, horizon=24)


# --- calendar -----------------------------------------------------------------------------------


@query("interval_expand", """WITH s AS (SELECT event_type, user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1, 2)
SELECT event_type, CAST(d AS TIMESTAMP) AS day, count(*) AS n FROM (SELECT event_type, unnest(generate_series(a, b, INTERVAL '1 day')) AS d FROM s)
GROUP BY 1, 2""")
def interval_expand(spark, d):
    """Activity spans of users as closed intervals, expanded to days."""
    spans = events(spark, d).groupBy("event_type", "user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = C.expand_days(spans, "a", "b").withColumn("day", F.col("day").cast("timestamp_ntz"))
    return days.groupBy("event_type", "day").agg(F.count("*").alias("n"))


# Illustrative calendar for the driver's order dates; real calendars are inputs.
BREAKS = [
    ("Paris", "-", "2017-2018", "1995-12-20", "1996-01-03"),
    ("Paris", "-", "2018-2019", "1997-02-10", "1997-02-24"),
    ("Paris", "Eleves", "2018-2019", "1997-02-20", "1997-03-02"),
    ("Paris", "Enseignants", "2019-2020", "1998-07-01", "1998-08-30"),
    ("Lyon", "-", "2019-2020", "1999-04-01", "1999-04-15"),
    ("Paris", "-", "2020-2021", "2000-12-18", "2001-01-02"),
]
PUBLIC_DAYS = [("1995-05-01", "may"), ("1996-07-14", "july"), ("1998-05-01", "may"), ("2000-12-25", "christmas")]


@query("holiday_flag_join", f"""WITH {sql_days()},
b AS (SELECT * FROM {sql_values(BREAKS, 'zone, population, school_year, date_from, date_to')}
  WHERE zone = 'Paris' AND population <> 'Enseignants' AND CAST(left(school_year, 4) AS INTEGER) >= 2018),
h AS (SELECT DISTINCT CAST(unnest(generate_series(CAST(date_from AS DATE), CAST(date_to AS DATE), INTERVAL '1 day')) AS DATE) AS day FROM b),
f AS (SELECT CAST(day AS DATE) AS day FROM {sql_values(PUBLIC_DAYS, 'day, name')})
SELECT sid, ts, y, CAST(h.day IS NOT NULL AS INTEGER) AS hol, CAST(f.day IS NOT NULL AS INTEGER) AS fer
FROM daily LEFT JOIN h ON CAST(ts AS DATE) = h.day LEFT JOIN f ON CAST(ts AS DATE) = f.day""")
def holiday_flag_join(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "sid")
    counts = P.daily_counts(orders, ["sid"], "o_orderdate")
    daily = P.daily_panel(counts, P.event_series(orders, "sid"), orders, "o_orderdate")
    calendar = spark.createDataFrame(BREAKS, "zone string, population string, school_year string, date_from string, date_to string")
    public = spark.createDataFrame(PUBLIC_DAYS, "date string, name string").select(F.to_date("date").alias("day"))
    breaks = C.school_breaks(calendar, "Paris", "Enseignants", 2018)
    days = C.expand_days(breaks.withColumns({c: F.to_date(c) for c in ("date_from", "date_to")}), "date_from", "date_to")
    flagged = C.flag_days(daily.withColumn("day", F.to_date("ts")), days, "day", "hol")
    return C.flag_days(flagged, public, "day", "fer").select("sid", "ts", "y", "hol", "fer")


@query("onehot_weekday", f"""WITH {sql_panel(60)} SELECT ts, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(isodow(ts) >= 6 AS INTEGER) AS weekend,
{", ".join(f"CAST(isodow(ts) = {k + 1} AS INTEGER) AS wd{k}" for k in range(7))} FROM steps""")
def onehot_weekday(spark, d):
    g = grid(spark, d, 60)
    return g.select("ts", F.weekday("ts").alias("weekday"), C.weekend(F.col("ts")), *C.weekday_onehot(F.col("ts")))


def _sql_fourier(x: str, period: int, prefix: str) -> str:
    parts = [f"{rd(f'{fn}(2.0 * {k} * pi() * {x} / {period}.0)')} AS {prefix}_{fn}{k}" for fn in ("sin", "cos") for k in range(1, 5)]
    return ", ".join(parts)


FOURIER = [f"{fn}{k}" for fn in ("sin", "cos") for k in range(1, 5)]


@query("fourier_year", f"""WITH {sql_days()} SELECT ts, {_sql_fourier('dayofyear(ts)', 365, 'year')} FROM days""")
def fourier_year(spark, d):
    orders = table(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    days = P.time_grid(orders, 24 * 60)
    return rounded(days.select("ts", *C.annual_fourier(F.col("ts"))), *[f"year_{n}" for n in FOURIER])


@query("fourier_month", f"""WITH {P15} SELECT ts, {_sql_fourier('dayofyear(ts)', 31, 'year')} FROM steps""")
def fourier_month(spark, d):
    """The short-span setting: day of year over a period of 31."""
    return rounded(grid(spark, d).select("ts", *C.annual_fourier(F.col("ts"), 31)), *[f"year_{n}" for n in FOURIER])


def _sql_day_position() -> str:
    return "((CASE WHEN hour(ts) = 0 THEN 24 ELSE hour(ts) END + minute(ts) / 60.0::DOUBLE) * 2.0 - 1.0)"


@query("fourier_day", f"""WITH {P15} SELECT ts, {rd(_sql_day_position())} AS pos, {_sql_fourier(_sql_day_position(), 48, 'day')} FROM steps""")
def fourier_day(spark, d):
    from tallycast.functions.timekeys import day_position

    g = grid(spark, d).select("ts", day_position(F.col("ts")).alias("pos"), *C.daily_fourier(F.col("ts")))
    return rounded(g, "pos", *[f"day_{n}" for n in FOURIER])


def _sql_attributes(pairs: list[tuple[str, str]], source: str) -> str:
    cols = []
    for name, expr in pairs:
        angle = f"{expr} * 2.0 * pi() / (m_{name} + 1)"
        cols += [f"{rd(f'cos({angle})')} AS {name}_cos", f"{rd(f'sin({angle})')} AS {name}_sin"]
    tops = ", ".join(f"max({expr}) AS m_{name}" for name, expr in pairs)
    return f"SELECT ts, {', '.join(cols)} FROM {source}, (SELECT {tops} FROM {source}) m"


@query("fourier_attrs", f"WITH {P15} " + _sql_attributes([("minute", "minute(ts)"), ("hour", "hour(ts)"), ("dayofweek", "(isodow(ts) - 1)")], "steps"))
def fourier_attrs(spark, d):
    out = C.fourier_date_attributes(grid(spark, d).select("ts"), "min")
    return rounded(out, *[c for c in out.columns if c != "ts"])


@query("fourier_attrs_weekly", f"WITH {sql_days()} " + _sql_attributes([("daysinmonth", "day(last_day(ts))"), ("weekofyear", "weekofyear(ts)")], "days"))
def fourier_attrs_weekly(spark, d):
    orders = table(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    out = C.fourier_date_attributes(P.time_grid(orders, 24 * 60).select("ts"), "W")
    return rounded(out, *[c for c in out.columns if c != "ts"])


@query("stack_features", f"""WITH {P15} SELECT sid, ts, y, CAST(4 AS INTEGER) AS width, {rd("sin(2.0 * pi() * dayofyear(ts) / 365.0) + hour(ts) / 24.0::DOUBLE + (isodow(ts) - 1) + idx / 1000.0::DOUBLE")} AS feature_sum
FROM panel""")
def stack_features(spark, d):
    """Covariates of the step stacked into a vector and met by every series; those known a day beyond the target fall away."""
    later = grid(spark, d).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "idx": F.col("idx") + PER_DAY})
    cov = grid(spark, d).unionByName(later.filter(F.col("idx") > last(spark, d))).select(
        "ts", C.annual_fourier(F.col("ts"))[0].alias("f1"), (F.hour("ts") / 24.0).alias("f2"), F.weekday("ts").alias("f3"),
        (F.col("idx") / 1000.0).alias("f4"),
    )
    joined = replicate_over_series(panel(spark, d), cov.select("ts", stack(["f1", "f2", "f3", "f4"])), ["features"])
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return rounded(joined.select("sid", "ts", "y", F.size("features").alias("width"), total.alias("feature_sum")), "feature_sum")

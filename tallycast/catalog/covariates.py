"""Event, works, weather and service covariates, and importance weights."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tallycast.catalog.registry import PER_DAY, SQL_K, events, grid, props_key, query, rd, rounded, sql_panel, sql_values
from tallycast.operators import covariates as V
from tallycast.operators import panel as P
from tallycast.operators.calendar import time_keys
from tallycast.operators.weights import rolling_past_weight
from tallycast.plans import features as T

P15, P30 = sql_panel(), sql_panel(30)
HALF_HOUR = 30

SQL_KEYS = """strftime(ts, '%Y-%m-%d') AS date,
  CAST(round_even(CASE WHEN hour(ts) = 0 THEN 24 ELSE hour(ts) END + minute(ts) / 60.0::DOUBLE, 1) AS DOUBLE) AS hr"""


def _keyed_events(spark, d):
    """Events with the (date, hr) key of their half-hour and the number in their properties."""
    e = events(spark, d).select(
        P.bucket_start(F.col("ts"), HALF_HOUR).alias("ts"), "event_type", "user_id", "value", props_key().alias("k"))
    return time_keys(e)


SQL_KEYED = f"""keyed AS (SELECT ts, {SQL_KEYS}, event_type, user_id, value, k FROM
  (SELECT time_bucket(INTERVAL '30 minutes', ts) AS ts, event_type, user_id, value, {SQL_K} AS k FROM events))"""


# --- events at a venue ----------------------------------------------------------------------------

COUNTERS = ("con_before", "con_after", "event_before", "event_after")


def _arena(spark, d):
    """Counters per (date, hr): events with a high number count as venue activity."""
    high = F.col("k") >= 80
    kinds = dict(zip(COUNTERS, ("view", "click", "signup", "purchase")))
    return _keyed_events(spark, d).groupBy("date", "hr").agg(
        *[F.count_if(high & (F.col("event_type") == t)).alias(c) for c, t in kinds.items()])


SQL_ARENA = "arena AS (SELECT date, hr, " + ", ".join(
    f"count(*) FILTER (k >= 80 AND event_type = '{t}') AS {c}" for c, t in zip(COUNTERS, ("view", "click", "signup", "purchase"))
) + " FROM keyed GROUP BY 1, 2)"
SQL_TIMES = f"times AS (SELECT ts, idx, {SQL_KEYS} FROM steps)"


@query("event_join", f"""WITH {P30}, {SQL_KEYED}, {SQL_ARENA}, {SQL_TIMES}
SELECT t.ts, {", ".join(f"CAST(nullif(a.{c}, 0) AS DOUBLE) AS {c}, CAST(nullif(a.{c}, 0) IS NOT NULL AS INTEGER) AS has_{c}" for c in COUNTERS)}
FROM times t LEFT JOIN arena a ON t.date = a.date AND t.hr = a.hr""")
def event_join(spark, d):
    """Half-hour steps met by venue counters on (date, decimal hour); 0 means no event."""
    joined = V.attach(time_keys(grid(spark, d, HALF_HOUR)), _arena(spark, d), ["date", "hr"], COUNTERS)
    nulled = joined.select("ts", *[V.zero_to_null(F.col(c)).cast("double").alias(c) for c in COUNTERS])
    return nulled.select("*", *[V.present(F.col(c)).alias(f"has_{c}") for c in COUNTERS])


@query("event_weight", f"""WITH {P30}, {SQL_KEYED}, {SQL_ARENA}, {SQL_TIMES}
SELECT t.ts, {", ".join(f"CASE WHEN coalesce(a.{c}, 0) <> 0 THEN {w}::DOUBLE ELSE 0.0::DOUBLE END AS w_{c}" for c, w in zip(COUNTERS, (20000, 20000, 10000, 10000)))},
{", ".join(f"CASE WHEN coalesce(a.{c}, 0) <> 0 THEN {w}::DOUBLE ELSE 0.0::DOUBLE END AS weak_{c}" for c, w in zip(COUNTERS, (2000, 2000, 1000, 1000)))}
FROM times t LEFT JOIN arena a ON t.date = a.date AND t.hr = a.hr""")
def event_weight(spark, d):
    joined = V.attach(time_keys(grid(spark, d, HALF_HOUR)), _arena(spark, d), ["date", "hr"], COUNTERS)
    out = []
    for prefix, profile in (("w", "forts"), ("weak", "faibles")):
        p = V.WEIGHT_PROFILES[profile]
        for c, w in zip(COUNTERS, (p.concert, p.concert, p.event, p.event)):
            out.append(V.constant_weight(F.col(c), w).alias(f"{prefix}_{c}"))
    return joined.select("ts", *out)


@query("onehot_levels", f"""WITH {P30}, {SQL_KEYED}, {SQL_ARENA}, {SQL_TIMES},
long AS ({" UNION ALL ".join(f"SELECT t.ts, '{c}' AS c, coalesce(a.{c}, 0) AS v FROM times t LEFT JOIN arena a ON t.date = a.date AND t.hr = a.hr" for c in COUNTERS)}),
levels AS (SELECT DISTINCT c, v FROM long), later AS (SELECT c, v FROM levels l WHERE v > (SELECT min(v) FROM levels m WHERE m.c = l.c))
SELECT ts, later.c || '_' || CAST(later.v AS VARCHAR) AS indicator, CAST(long.v = later.v AS INTEGER) AS flag FROM long JOIN later ON later.c = long.c""")
def onehot_levels(spark, d):
    """Counters as 0/1 columns of all levels that occur, the smallest dropped; laid out long, as their number depends on the data."""
    joined = V.attach(time_keys(grid(spark, d, HALF_HOUR)), _arena(spark, d), ["date", "hr"], COUNTERS, fill=0)
    wide = V.onehot(joined.select("ts", *COUNTERS), COUNTERS)
    return wide.unpivot("ts", [c for c in wide.columns if c != "ts"], "indicator", "flag")


@query("onehot_discovered", """SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N,
CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R FROM lineitem""")
def onehot_discovered(spark, d):
    """Levels found in the data, first dropped."""
    from tallycast.sources.readers import table

    return V.onehot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_returnflag"])


# --- weather ------------------------------------------------------------------------------------


def _weather(spark, d):
    """Hourly readings: mean and largest measured value of the error events."""
    e = events(spark, d).filter("event_type = 'error'").select(P.bucket_start(F.col("ts"), 60).alias("ts"), "value")
    hourly = e.groupBy("ts").agg((F.avg("value") - 50.0).alias("temp"), F.max("value").alias("precip"))
    return time_keys(hourly).select("date", "hrr", "temp", "precip")


SQL_WEATHER = """weather AS (SELECT strftime(h, '%Y-%m-%d') AS date, hour(h) AS hrr, avg(value) - 50.0 AS temp, max(value) AS precip
  FROM (SELECT time_bucket(INTERVAL '60 minutes', ts) AS h, value FROM events WHERE event_type = 'error') GROUP BY h),
joined AS (SELECT s.ts, s.idx, coalesce(w.temp, 0.0) AS temp, coalesce(w.precip, 0.0) AS precip FROM steps s
  LEFT JOIN weather w ON strftime(s.ts, '%Y-%m-%d') = w.date AND hour(s.ts) = w.hrr)"""


def _weather_steps(spark, d):
    """Each hourly row serves the quarter hours of its hour; missing readings are 0."""
    return V.attach(time_keys(grid(spark, d)), _weather(spark, d), ["date", "hrr"], ["temp", "precip"], fill=0.0)


@query("weather_join", f"WITH {P15}, {SQL_WEATHER} SELECT ts, {rd('temp')} AS temp, {rd('precip')} AS precip FROM joined")
def weather_join(spark, d):
    return rounded(_weather_steps(spark, d).select("ts", "temp", "precip"), "temp", "precip")


@query("max_normalise", f"""WITH {P15}, {SQL_WEATHER} SELECT ts, {rd('temp / nullif(m_t, 0)')} AS temp, {rd('precip / nullif(m_p, 0)')} AS precip
FROM joined, (SELECT max(temp) AS m_t, max(precip) AS m_p FROM joined)""")
def max_normalise(spark, d):
    out = V.max_normalise(_weather_steps(spark, d).select("ts", "temp", "precip"), ["temp", "precip"])
    return rounded(out, "temp", "precip")


@query("abs_weight", f"WITH {P15}, {SQL_WEATHER} SELECT ts, {rd('abs(temp)')} AS w_temp, {rd('abs(precip)')} AS w_precip FROM joined")
def abs_weight(spark, d):
    out = _weather_steps(spark, d).select("ts", F.abs("temp").alias("w_temp"), F.abs("precip").alias("w_precip"))
    return rounded(out, "w_temp", "w_precip")


# --- works and service --------------------------------------------------------------------------

# Illustrative mapping: a zone under works closes one or more branches.
ZONE_BRANCH = [(f"Z{z}", f"B{b}") for z in range(4) for b in range(8)] + [("Z4", "B2"), ("Z4", "B6"), ("Z5", "B3"), ("Z6", "B5"), ("Z6", "B7"), ("Z7", "B2")]
BRANCHES = [f"B{b}" for b in range(8)]
ZONES = [f"Z{z}" for z in range(8)]


def _works(spark, d):
    """Works reports: error events with a very high number, by zone."""
    e = _keyed_events(spark, d).filter("event_type = 'error' AND k >= 90")
    return e.select("date", "hr", F.concat(F.lit("Z"), (F.col("k") % 8).cast("string")).alias("zone"))


def _service(spark, d):
    """Service levels around 1: purchase values in tens, by branch; several rows per key are possible."""
    e = _keyed_events(spark, d).filter("event_type = 'purchase'")
    return e.select("date", "hr", F.concat(F.lit("B"), (F.col("user_id") % 8).cast("string")).alias("branch"), (F.col("value") / 10.0).alias("value"))


SQL_WORKS = f"""{SQL_KEYED},
works AS (SELECT date, hr, 'Z' || CAST(k % 8 AS VARCHAR) AS zone FROM keyed WHERE event_type = 'error' AND k >= 90)"""
SQL_SERVICE = f"""{SQL_WORKS},
service AS (SELECT date, hr, 'B' || CAST(user_id % 8 AS VARCHAR) AS branch, value / 10.0::DOUBLE AS value FROM keyed WHERE event_type = 'purchase'),
mask AS (SELECT DISTINCT date, hr, branch FROM works w LEFT JOIN {sql_values(ZONE_BRANCH, 'zone, branch')} m ON w.zone = m.zone),
level AS (SELECT s.date, s.hr, s.branch, max(CASE WHEN m.branch IS NOT NULL THEN 1.0::DOUBLE ELSE s.value END) AS value
  FROM service s LEFT JOIN mask m ON s.date = m.date AND s.hr = m.hr AND s.branch = m.branch GROUP BY 1, 2, 3)"""


@query("works_pivot", f"""WITH {P30}, {SQL_WORKS}, {SQL_TIMES}, wide AS (SELECT date, hr, {", ".join(f"max(1) FILTER (zone = '{z}') AS {z}" for z in ZONES)} FROM works GROUP BY 1, 2)
SELECT t.ts, {", ".join(f"CAST(coalesce(w.{z}, 0) AS DOUBLE) AS {z}" for z in ZONES)} FROM times t LEFT JOIN wide w ON t.date = w.date AND t.hr = w.hr""")
def works_pivot(spark, d):
    """A 0/1 column per zone: pivot of a constant, absent cells 0."""
    wide = V.pivot_mean(_works(spark, d).withColumn("value", F.lit(1)), ["date", "hr"], "zone", "value", ZONES)
    return V.attach(time_keys(grid(spark, d, HALF_HOUR)), wide, ["date", "hr"], ZONES, fill=0.0).select("ts", *ZONES)


@query("inverse_freq_weight", f"""WITH {P30}, {SQL_WORKS}, {SQL_TIMES}, wide AS (SELECT date, hr, {", ".join(f"max(1) FILTER (zone = '{z}') AS {z}" for z in ZONES)} FROM works GROUP BY 1, 2),
j AS (SELECT t.ts, {", ".join(f"coalesce(w.{z}, 0) AS {z}" for z in ZONES)} FROM times t LEFT JOIN wide w ON t.date = w.date AND t.hr = w.hr),
m AS (SELECT {", ".join(f"avg(CASE WHEN {z} <> 0 THEN 1.0 ELSE 0.0 END) AS m_{z}" for z in ZONES)} FROM j)
SELECT ts, {", ".join(f"{rd(f'CASE WHEN {z} <> 0 THEN 1.0 / nullif(m_{z}, 0) ELSE 0.0 END')} AS w_{z}" for z in ZONES)} FROM j, m""")
def inverse_freq_weight(spark, d):
    out = V.inverse_frequency(works_pivot(spark, d), ZONES)
    names = [f"w_{z}" for z in ZONES]
    return rounded(out.select("ts", *names), *names)


@query("works_mask_join", f"WITH {SQL_SERVICE} SELECT date, hr, branch, value FROM level")
def works_mask_join(spark, d):
    """Works hide service trouble on the branches they close; else the largest reported level counts."""
    mask = V.branch_mask(_works(spark, d), spark.createDataFrame(ZONE_BRANCH, "zone string, branch string"))
    return V.masked_service(_service(spark, d), mask)


@query("service_max_pivot", f"""WITH {P30}, {SQL_SERVICE}, {SQL_TIMES}, wide AS (SELECT date, hr, {", ".join(f"avg(value) FILTER (branch = '{b}') AS {b}" for b in BRANCHES)} FROM level GROUP BY 1, 2)
SELECT t.ts, {", ".join(f"coalesce(w.{b}, 1.0) AS {b}" for b in BRANCHES)} FROM times t LEFT JOIN wide w ON t.date = w.date AND t.hr = w.hr""")
def service_max_pivot(spark, d):
    """Largest level per branch as columns on the time steps; no report means normal service, 1."""
    wide = V.pivot_mean(works_mask_join(spark, d), ["date", "hr"], "branch", "value", BRANCHES)
    return V.attach(time_keys(grid(spark, d, HALF_HOUR)), wide, ["date", "hr"], BRANCHES, fill=1.0).select("ts", *BRANCHES)


@query("excess_weight", f"""WITH {P30}, {SQL_SERVICE}, {SQL_TIMES}, wide AS (SELECT date, hr, {", ".join(f"avg(value) FILTER (branch = '{b}') AS {b}" for b in BRANCHES)} FROM level GROUP BY 1, 2)
SELECT t.ts, {", ".join(f"{rd(f'(coalesce(w.{b}, 1.0) - 1.0) * 100')} AS w_{b}" for b in BRANCHES)} FROM times t LEFT JOIN wide w ON t.date = w.date AND t.hr = w.hr""")
def excess_weight(spark, d):
    wide = service_max_pivot(spark, d)
    out = wide.select("ts", *[V.excess_weight(F.col(b), V.WEIGHT_PROFILES["forts"].service).alias(f"w_{b}") for b in BRANCHES])
    return rounded(out, *[f"w_{b}" for b in BRANCHES])


OFF_DAYS = ["2024-01-03", "2024-01-11"]
OFF_RANGES = [("2024-01-15", "2024-01-17"), ("2024-01-25", "2024-01-26")]


@query("exclusion_override", f"""WITH {SQL_KEYED} SELECT date, hr, count(*) AS n, {rd('''sum(CASE WHEN date IN ('2024-01-03', '2024-01-11')
 OR date BETWEEN '2024-01-15' AND '2024-01-17' OR date BETWEEN '2024-01-25' AND '2024-01-26' THEN 1.0 ELSE value END)''')} AS value FROM keyed GROUP BY 1, 2""")
def exclusion_override(spark, d):
    """Values inside excluded days and ranges count as normal."""
    k = _keyed_events(spark, d)
    v = V.override_in_periods(F.col("date"), F.col("value"), OFF_DAYS, OFF_RANGES)
    return rounded(k.groupBy("date", "hr").agg(F.count("*").alias("n"), F.sum(v).alias("value")), "value")


# --- rolling weight -----------------------------------------------------------------------------


def weight_steps(spark, d):
    """Two weight columns per quarter hour, in eighths so that sums are exact: weather size and event load."""
    steps = _weather_steps(spark, d)
    load = P.bucket_counts(events(spark, d).filter("event_type = 'purchase'"), "event_type").select("ts", "n")
    joined = V.attach(steps, load, ["ts"], ["n"], fill=0)
    eighths = F.floor(F.abs("temp") * 8) / 8.0
    return joined.select("ts", "idx", eighths.alias("w1"), (F.col("n") * 2.5).alias("w2"))


SQL_WEIGHTS = f"""{SQL_WEATHER},
wsteps AS (SELECT j.ts, j.idx, floor(abs(j.temp) * 8) / 8.0::DOUBLE AS w1, coalesce(c.n, 0) * 2.5::DOUBLE AS w2 FROM joined j
  LEFT JOIN (SELECT ts, n FROM cnt WHERE sid = 'purchase') c ON c.ts = j.ts),
rolled AS (SELECT ts, idx, CAST(CASE WHEN idx >= {PER_DAY} AND idx < count(*) OVER () - {PER_DAY} THEN
  round_even(sum(w1 + w2) OVER (ORDER BY idx ROWS BETWEEN {PER_DAY} PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS BIGINT) AS weight FROM wsteps)"""


@query("rolling_weight", f"WITH {P15}, {SQL_WEIGHTS} SELECT ts, idx, weight FROM rolled")
def rolling_weight(spark, d):
    """Past-window weight of every step, computed in blocks far shorter than the series."""
    return rolling_past_weight(weight_steps(spark, d), ["w1", "w2"], PER_DAY, block=1024).select("ts", "idx", "weight")


# --- whole feature tables -----------------------------------------------------------------------


def _sql_fourier(x: str, period: int, prefix: str) -> str:
    return ", ".join(f"{rd(f'{fn}(2.0 * {k} * pi() * {x} / {period}.0)')} AS {prefix}_{fn}{k}" for fn in ("sin", "cos") for k in range(1, 5))


def _sql_calendar(annual: int, day: int) -> str:
    position = "((CASE WHEN hour(ts) = 0 THEN 24 ELSE hour(ts) END + minute(ts) / 60.0::DOUBLE) * 2.0 - 1.0)"
    onehots = ", ".join(f"CAST(isodow(ts) = {k + 1} AS INTEGER) AS wd{k}" for k in range(7))
    return f"{_sql_fourier('dayofyear(ts)', annual, 'year')}, {_sql_fourier(position, day, 'day')}, {onehots}"


@query("city_features", f"""WITH {P15}, {SQL_WEATHER}, m AS (SELECT max(temp) AS m_t, max(precip) AS m_p FROM joined)
SELECT ts, idx, {_sql_calendar(31, 96)}, {rd('temp / nullif(m_t, 0)')} AS temp, {rd('precip / nullif(m_p, 0)')} AS precip,
{rd('abs(temp)')} AS w_temp, {rd('abs(precip)')} AS w_precip FROM joined, m""")
def city_features(spark, d):
    """The quarter-hourly covariate and weight table in one plan, with the short-span periods."""
    out = T.city_features(grid(spark, d), _weather(spark, d), annual_period=31, day_period=96)
    return rounded(out, *[c for c in out.columns if c not in ("ts", "idx") and not c.startswith("wd")])


BREAK_DAYS = [("2024-01-01", "2024-01-07"), ("2024-01-05", "2024-01-09"), ("2024-01-27", "2024-01-28")]
HOLY_DAYS = [("2024-01-01",), ("2024-01-18",)]


def _station(spark, d) -> T.StationInputs:
    arena = _arena(spark, d)
    half_hourly = _keyed_events(spark, d).filter("event_type = 'error'").groupBy("date", "hr").agg(
        (F.avg("value") - 50.0).alias("temperature"), F.max("value").alias("precipitations3h"))
    return T.StationInputs(
        breaks=spark.createDataFrame(BREAK_DAYS, "date_from string, date_to string").select(F.to_date("date_from").alias("date_from"), F.to_date("date_to").alias("date_to")),
        public_days=spark.createDataFrame(HOLY_DAYS, "day string").select(F.to_date("day").alias("day")),
        arena=arena,
        works=_works(spark, d), zone_branch=spark.createDataFrame(ZONE_BRANCH, "zone string, branch string"), service=_service(spark, d),
        weather=half_hourly, counters=COUNTERS, zones=ZONES, branches=BRANCHES, off_days=OFF_DAYS, off_ranges=OFF_RANGES,
        concerts=COUNTERS[:2],
    )


def _sql_station() -> str:
    zones = ", ".join(f"max(1) FILTER (zone = '{z}') AS {z}" for z in ZONES)
    branches = ", ".join(f"avg(value) FILTER (branch = '{b}') AS {b}" for b in BRANCHES)
    excluded = "date IN ('2024-01-03', '2024-01-11') OR date BETWEEN '2024-01-15' AND '2024-01-17' OR date BETWEEN '2024-01-25' AND '2024-01-26'"
    service = SQL_SERVICE.replace("level AS (SELECT s.date", "level0 AS (SELECT s.date")
    counters = ", ".join(f"coalesce(a.{c}, 0) AS {c}" for c in COUNTERS)
    sources = f"""{P30}, {service}, {SQL_ARENA}, {SQL_TIMES},
 served AS (SELECT date, hr, branch, CASE WHEN {excluded} THEN 1.0 ELSE value END AS value FROM service),
 level AS (SELECT s.date, s.hr, s.branch, max(CASE WHEN m.branch IS NOT NULL THEN 1.0::DOUBLE ELSE s.value END) AS value
  FROM served s LEFT JOIN mask m ON s.date = m.date AND s.hr = m.hr AND s.branch = m.branch GROUP BY 1, 2, 3),
 zw AS (SELECT date, hr, {zones} FROM works GROUP BY 1, 2), bw AS (SELECT date, hr, {branches} FROM level GROUP BY 1, 2),
 met AS (SELECT date, hr, avg(value) - 50.0 AS temperature, max(value) AS precipitations3h FROM keyed WHERE event_type = 'error' GROUP BY 1, 2),
 j AS (SELECT t.ts, t.idx, {counters}, {", ".join(f"coalesce(z.{z}, 0) AS {z}" for z in ZONES)}, {", ".join(f"coalesce(b.{b}, 1.0) AS {b}" for b in BRANCHES)},
   coalesce(w.temperature, 0.0) AS temperature, coalesce(w.precipitations3h, 0.0) AS precipitations3h,
   CAST(CAST(t.ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-09' OR CAST(t.ts AS DATE) BETWEEN DATE '2024-01-27' AND DATE '2024-01-28' AS INTEGER) AS hol,
   CAST(CAST(t.ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-18') AS INTEGER) AS fer
  FROM times t LEFT JOIN arena a ON t.date = a.date AND t.hr = a.hr LEFT JOIN zw z ON t.date = z.date AND t.hr = z.hr
  LEFT JOIN bw b ON t.date = b.date AND t.hr = b.hr LEFT JOIN met w ON t.date = w.date AND t.hr = w.hr),
 m AS (SELECT max(temperature) AS m_t, max(precipitations3h) AS m_p, {", ".join(f"avg(CASE WHEN {z} <> 0 THEN 1.0 ELSE 0.0 END) AS m_{z}" for z in ZONES)},
   {", ".join(f"min({c}) AS lo_{c}, count(DISTINCT {c}) AS n_{c}" for c in COUNTERS)} FROM j)"""
    columns = [
        f"ts, idx, {_sql_calendar(365, 48)}, hol, fer",
        ", ".join(f"CASE WHEN {c} <> 0 THEN {w}::DOUBLE ELSE 0.0::DOUBLE END AS w_{c}" for c, w in zip(COUNTERS, (20000, 20000, 10000, 10000))),
        "concat_ws(',', " + ", ".join(f"CASE WHEN {c} > lo_{c} THEN '{c}_' || CAST({c} AS VARCHAR) END" for c in COUNTERS) + ") AS levels",
        "CAST(" + " + ".join(f"n_{c} - 1" for c in COUNTERS) + " AS INTEGER) AS n_levels",
        ", ".join(f"CAST({z} AS DOUBLE) AS {z}, {rd(f'CASE WHEN {z} <> 0 THEN 1.0 / nullif(m_{z}, 0) ELSE 0.0 END')} AS w_{z}" for z in ZONES),
        f"{rd('temperature / nullif(m_t, 0)')} AS temperature, {rd('precipitations3h / nullif(m_p, 0)')} AS precipitations3h",
        f"{rd('abs(temperature)')} AS w_temperature, {rd('abs(precipitations3h)')} AS w_precipitations3h",
        ", ".join(f"{rd(b)} AS {b}, {rd(f'({b} - 1.0) * 100')} AS w_{b}" for b in BRANCHES),
    ]
    return f"WITH {sources} SELECT {', '.join(columns)} FROM j, m"


def _with_levels(features, columns):
    """The indicator columns of ``columns`` as one text of those that are 1, and their number: how many there are depends on the data."""
    names = [n for c in columns for n in features.columns if n.startswith(f"{c}_")]
    hot = F.concat_ws(",", *[F.when(F.col(n) == 1, F.lit(n)) for n in names])
    return features.withColumns({"levels": hot, "n_levels": F.lit(len(names))}).drop(*names)


@query("station_features", _sql_station())
def station_features(spark, d):
    """The half-hourly covariate and weight table: calendar, holidays, venue, works, weather, service."""
    out = _with_levels(T.station_features(grid(spark, d, HALF_HOUR), _station(spark, d)), COUNTERS)
    exact = ("ts", "idx", "hol", "fer", "levels", "n_levels")
    return rounded(out, *[c for c in out.columns if c not in exact and not c.startswith("wd")])


@query("station_service_levels", f"""WITH {P30}, {SQL_SERVICE.replace("value / 10.0::DOUBLE AS value", "max(round(value / 10.0::DOUBLE)) AS value").replace("event_type = 'purchase')", "event_type = 'purchase' GROUP BY ALL)")},
{SQL_TIMES}, bw AS (SELECT date, hr, {", ".join(f"max(value) FILTER (branch = '{b}') AS {b}" for b in BRANCHES)} FROM level GROUP BY 1, 2),
j AS (SELECT t.ts, {", ".join(f"coalesce({b}, 1.0) AS {b}" for b in BRANCHES)} FROM times t LEFT JOIN bw ON t.date = bw.date AND t.hr = bw.hr),
m AS (SELECT {", ".join(f"min({b}) AS lo_{b}, count(DISTINCT {b}) AS n_{b}" for b in BRANCHES)} FROM j)
SELECT ts, concat_ws(',', {", ".join(f"CASE WHEN {b} > lo_{b} THEN '{b}_' || CAST(CAST({b} AS INTEGER) AS VARCHAR) || '_0' END" for b in BRANCHES)}) AS levels,
CAST({" + ".join(f"n_{b} - 1" for b in BRANCHES)} AS INTEGER) AS n_levels, {", ".join(f"({b} - 1.0) * 100 AS w_{b}" for b in BRANCHES)} FROM j, m""")
def station_service_levels(spark, d):
    """Service levels in whole numbers as indicator columns per branch, of the levels that occur, within the whole table."""
    inputs = _station(spark, d)
    whole = inputs.service.groupBy("date", "hr", "branch").agg(F.max(F.round("value")).alias("value"))
    chosen = replace(inputs, service=whole, service_levels=None, off_days=(), off_ranges=())
    out = _with_levels(T.station_features(grid(spark, d, HALF_HOUR), chosen), BRANCHES)
    return out.select("ts", "levels", "n_levels", *[f"w_{b}" for b in BRANCHES])

"""Registry of named queries and shared building blocks of both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.functions import numeric as N
from tallycast.operators.panel import event_bounds, event_last_index, event_panel, time_grid
from tallycast.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STEP = 15
PER_DAY = 96


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can express it, the statement it must agree with."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6, many: bool = False) -> DataFrame:
    """Round the given columns for comparison; adding 0.0 turns -0.0 into 0.0.

    Spark rounds a double by its decimal digits, in a microsecond.  With ``many``, for double columns of very many rows,
    only values near a tie or beyond 1e9 units go that way; elsewhere the nearest unit is the same number.
    """

    def one(name: str) -> Column:
        exact, units = F.round(name, digits), F.col(name) * 10.0**digits
        if not many:
            return exact
        clear = (F.abs(units) < 1e9) & (F.abs(units - F.rint(units)) < 0.499)
        return F.when(clear, F.rint(units) / 10.0**digits).otherwise(exact)

    chosen = set(columns)
    return df.select(*[(one(c) + 0.0).alias(c) if c in chosen else F.col(c) for c in df.columns])


def rd(expression: str, digits: int = 6) -> str:
    """The SQL side of :func:`rounded`."""
    return f"(round({expression}, {digits}) + 0.0)"


# --- Spark side ---------------------------------------------------------------------------------


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def panel(spark: SparkSession, folder: str, minutes: int = STEP) -> DataFrame:
    return event_panel(events(spark, folder), "event_type", minutes=minutes)


def last(spark: SparkSession, folder: str, minutes: int = STEP) -> Column:
    return event_last_index(events(spark, folder), minutes=minutes)


def grid(spark: SparkSession, folder: str, minutes: int = STEP) -> DataFrame:
    """``(ts, idx)``, one row per step."""
    return time_grid(event_bounds(events(spark, folder), minutes=minutes), minutes)


def props_key() -> Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("int")


# --- SQL side -----------------------------------------------------------------------------------

SQL_K = r"CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER)"


def sql_panel(minutes: int = STEP, sid: str = "event_type") -> str:
    """CTEs ``lim``, ``cnt``, ``steps`` and ``panel`` (sid, ts, idx, y)."""
    return f"""lim AS (SELECT time_bucket(INTERVAL '{minutes} minutes', min(ts)) AS a,
    time_bucket(INTERVAL '{minutes} minutes', max(ts)) AS b FROM events),
  cnt AS (SELECT CAST({sid} AS VARCHAR) AS sid, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, count(*) AS n,
    avg(value) AS v FROM events GROUP BY 1, 2),
  steps AS (SELECT s.ts, CAST(date_diff('minute', s.a, s.ts) // {minutes} AS BIGINT) AS idx
    FROM (SELECT a, unnest(generate_series(a, b, INTERVAL '{minutes} minutes')) AS ts FROM lim) s),
  panel AS (SELECT k.sid, g.ts, g.idx, CAST(coalesce(c.n, 0) AS DOUBLE) AS y, c.v
    FROM (SELECT DISTINCT CAST({sid} AS VARCHAR) AS sid FROM events) k CROSS JOIN steps g
    LEFT JOIN cnt c ON c.sid = k.sid AND c.ts = g.ts)"""


def sql_days() -> str:
    """CTEs for the daily order panel by priority: ``dlim``, ``dcnt``, ``days`` and ``daily``."""
    return """dlim AS (SELECT date_trunc('day', min(o_orderdate))::TIMESTAMP AS a, date_trunc('day', max(o_orderdate))::TIMESTAMP AS b FROM orders),
  dcnt AS (SELECT o_orderpriority AS sid, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, count(*) AS n FROM orders GROUP BY 1, 2),
  days AS (SELECT d.ts, CAST(date_diff('day', d.a, d.ts) AS BIGINT) AS idx
    FROM (SELECT a, unnest(generate_series(a, b, INTERVAL '1 day')) AS ts FROM dlim) d),
  daily AS (SELECT k.sid, g.ts, g.idx, CAST(coalesce(c.n, 0) AS DOUBLE) AS y
    FROM (SELECT DISTINCT o_orderpriority AS sid FROM orders) k CROSS JOIN days g
    LEFT JOIN dcnt c ON c.sid = k.sid AND c.ts = g.ts)"""


def sql_horner(coefficients, x: str) -> str:
    text = repr(float(coefficients[0])) + "::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + ({float(c)!r})::DOUBLE)"
    return text


def sql_ppf(p: str) -> str:
    """Inverse normal distribution function of the column ``p`` (same published coefficients)."""
    r = f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))"
    s = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    centre = f"({p} - 0.5) * {sql_horner(N.PPF_CENTRE_NUM[::-1], r)} / {sql_horner(N.PPF_CENTRE_DEN[::-1], r)}"
    near = f"{sql_horner(N.PPF_NEAR_NUM[::-1], f'({s} - 1.6)')} / {sql_horner(N.PPF_NEAR_DEN[::-1], f'({s} - 1.6)')}"
    far = f"{sql_horner(N.PPF_FAR_NUM[::-1], f'({s} - 5.0)')} / {sql_horner(N.PPF_FAR_DEN[::-1], f'({s} - 5.0)')}"
    return (
        f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN {centre} "
        f"ELSE sign({p} - 0.5) * (CASE WHEN {s} <= 5.0 THEN {near} ELSE {far} END) END)"
    )


def sql_cdf(x: str) -> str:
    """Normal distribution function of the column ``x`` for |x| < 7."""
    a = f"abs({x})"
    tail = f"exp(-{a} * {a} / 2.0) * {sql_horner(N.CDF_NUM, a)} / {sql_horner(N.CDF_DEN, a)}"
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def sql_uniform(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {2**52}::DOUBLE)"


def sql_values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) t({columns}))"

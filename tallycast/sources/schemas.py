"""Declared schemas of the input files; nothing is inferred and nothing is addressed by position."""

from __future__ import annotations

from collections.abc import Sequence

# Tables the driver provides; declared, so that opening one needs no look at its footers.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}

PANEL = "sid string, ts timestamp_ntz, y double"
WEATHER_HOURLY = "row int, date string, hrr int, temp double, precip double"
WEATHER_HALF_HOURLY = "date string, hr double, temperature double, precipitations3h double"
SCHOOL_CALENDAR = "zone string, population string, school_year string, date_from string, date_to string"
PUBLIC_HOLIDAYS = "date string, name string"
ARENA = "date string, hr double, con_before int, con_after int, event_before int, event_after int"
WORKS = "date string, hr double, zone string"
SERVICE = "date string, hr double, branch string, value double"
WEIGHT = "ts timestamp_ntz, weight double"
METRICS = "metrics string, values double"
RUNS = "model string, rep int, params string"


def wide_counts(series: Sequence[str], keyed_by_hour: bool = False) -> str:
    """Wide count file: an index (text time, or a row number with ``date`` and ``hr``) and a column per series."""
    head = ["row string"] + (["date string", "hr double"] if keyed_by_hour else [])
    return ", ".join(head + [f"`{s}` double" for s in series])

"""Run named queries beside their SQL in DuckDB and report differences.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(v):
    if v is None or v is pd.NaT:
        return ""
    if isinstance(v, float):
        return "" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _key(v.item())
    return str(v)


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_key(v) for v in row) for row in frame.itertuples(index=False, name=None))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def compare(spark, con, name: str, folder: str, fn, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got = fn(spark, folder).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if kinds(got) != kinds(want):
        diff = {c: (kinds(got)[c], kinds(want)[c]) for c in got.columns if kinds(got)[c] != kinds(want)[c]}
        if any(a + b not in ("iO", "OO") for a, b in diff.values()):
            return f"types differ {diff}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    from tallycast.catalog import ORACLES, QUERIES
    from tallycast.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session(8), duck(args.sf)
    failed = 0
    for name in args.names or QUERIES:
        t = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, name, args.sf, QUERIES[name], ORACLES[name])
                status = "ok" if problem is None else f"DIFF {problem}"
            else:
                status = f"rows {len(QUERIES[name](spark, args.sf).toPandas())} (no SQL)"
        except Exception as e:  # report and go on with the other queries
            status = "FAIL " + str(e).strip().replace("\n", " ")[:600]
        failed += status.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.time() - t:6.2f}s {status}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())

"""Every named query against its SQL in DuckDB, and plan rules that hold for all of them."""

import pathlib
import re

import pytest
from compare import compare, duck

from tallycast.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER, QUERIES[name], ORACLES[name]) is None


RANDOM = ["nb_share_paths", "gauss_lowrank_paths", "poisson_regression"]


@pytest.mark.parametrize("name", RANDOM)
def test_query_without_sql_repeats_itself(spark, name):
    first = QUERIES[name](spark, FOLDER).toPandas()
    again = QUERIES[name](spark, FOLDER).toPandas()
    assert len(first) > 0
    keys = [c for c in first.columns if first[c].dtype.kind != "f"]
    merged = first.merge(again, on=keys, suffixes=("", "_again"))
    assert len(merged) == len(first)
    for c in set(first.columns) - set(keys):
        assert (merged[c] - merged[f"{c}_again"]).abs().max() < 1e-6


PLANNED = ["lag_features", "rolling_weight", "scaled_total_lags", "weighted_cut_draw", "past_future_windows", "max_normalise",
           "item_metrics", "scenario_eval", "param_grid", "joint_loss", "works_mask_join", "series_subset"]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_product_and_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


@pytest.mark.parametrize("name", ["bucket_counts", "numeric_functions", "unpivot_long"])
def test_scans_read_only_needed_columns(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert len(read.split(",")) <= 4
    assert "props" not in read

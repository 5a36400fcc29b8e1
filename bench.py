"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS choose data and cores; BENCH_QUERIES (comma separated) narrows the list.
"""

from __future__ import annotations

import json
import os
import time

from tallycast.catalog import QUERIES
from tallycast.session import local_session

HEADLINE = (
    "bucket_counts dense_panel value_panel wide_pivot orders_by_nation_daily holiday_flag_join fourier_day "
    "event_join weather_join service_max_pivot rolling_weight lag_features scaled_lags past_future_windows "
    "weighted_cut_draw marginal_gaussian series_correlation nb_moments joint_loss anomaly_scores gauss_paths "
    "nb_share_paths gauss_lowrank_paths dm_split sample_quantiles item_metrics metrics_long scenario_eval param_grid"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus)
    spark.read.parquet(f"{folder}/events.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(folder)),
    }))


if __name__ == "__main__":
    main()

"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS the number of
local cores. Every query runs to completion into a sink that discards its rows;
sessions start before the clock, and one untimed query warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "dataset_assembly",
    "grid_time_lookup",
    "hourly_lookup",
    "asof_backward_lookup",
    "horizon_label_join",
    "nearest_station",
    "lag_features",
    "normalize_by_kind",
    "band_stats_approx",
    "band_stats_by_label",
    "describe_columns",
    "exact_quantiles",
    "histogram_by_label",
    "master_histogram",
    "rebin_histogram",
    "correlation_matrix",
    "sliding_training_rows",
    "ratio_merge",
    "sample_n",
    "dilate_mask",
    "region_pools",
    "area_mean_resample",
    "nearest_cloud_cell",
    "nearest_regrid",
    "morans_i",
    "mutual_information",
    "point_biserial_features",
    "confusion_by_horizon",
    "pr_auc_fine",
    "roc_auc_fine",
    "regression_metrics",
    "threshold_sweep",
)


def main() -> None:
    from cellclock.plans.registry import load
    from cellclock.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    queries, _ = load()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

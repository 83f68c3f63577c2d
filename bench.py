"""Benchmark of the registered queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES (comma separated
names, or "all") select what runs. Each query is run in full into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gateflow.queries import QUERIES
from gateflow.session import build_session

HEADLINE = [
    "naive_forecast", "slot_flow", "slot_flow_paytype", "dense_grid", "distinct_devices_grains",
    "top_device_max_and_mode", "device_load", "resample_30min", "window_boundary_counts", "business_day_lags",
    "prev_day_join", "neighbour_slots", "last5_days", "expanding_stats", "expanding_prev_day", "trailing_stats",
    "anchor_training_set", "group_stats", "baseline_stats", "feat_stats", "night_profile", "column_profile",
    "value_frequencies", "quasi_constant", "feature_correlation", "dataset_equality", "neighbour_list", "dim_enrich",
    "regular_riders", "next_swipe", "od_trips", "blend", "postprocess", "profile_scaling", "triple_smoothing",
    "week_over_week", "distinct_devices_bitmaps", "balanced_folds", "streaming_slot_flow", "gbt_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["slot_flow"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not a query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberframe.catalog import QUERIES  # noqa: E402
from emberframe.session import build_session  # noqa: E402

HEADLINE = (
    "window_summary", "window_pairs", "trial_summary", "rolling_median5", "gap_clusters", "stable_gate",
    "cycle_count", "average_rank", "bin_interpolate", "frame_intervals", "metric_percentiles", "split_quantiles",
    "asof_pair", "interval_join", "baseline_noise", "hot_mask_features", "classifier_features", "delta_features",
    "zbuffer_nearest", "components_8", "lag_scan_pooled", "time_control", "affine_fit", "threshold_rule",
    "nearest_centroid", "signflip_clusters", "capture_audit", "replay_hold_gate", "content_manifest",
)
REPEATS = 3


def measure(spark, name: str, root: str) -> float:
    """Median seconds of three full runs after one warm-up; every row is produced."""
    times = []
    for attempt in range(REPEATS + 1):
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        if attempt:
            times.append(time.perf_counter() - start)
    return statistics.median(times)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("emberframe-bench", int(os.environ.get("BENCH_CPUS", "8")))
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        seconds[name] = round(measure(spark, name, root), 4)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 4)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

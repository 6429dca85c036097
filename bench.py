"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import time

from jobcast.checks import QUERIES
from jobcast.session import local_session

HEADLINE = (
    "scan_parquet_trace", "preprocess_fugaku", "preprocess_m100", "to_swf", "label_encode",
    "assign_windows_tumbling", "assign_windows_sliding", "nearest_center", "split_exact", "balanced_resample",
    "balance_weights", "underpred_bias", "apply_bias", "window_metrics", "median_error_by_range",
    "error_histogram", "kde_density", "boxplot_stats", "silhouette_exact", "kmeans_group_jobs",
    "evaluate_results", "group_mean_experiment", "experiment_baseline", "stream_window_stats",
    "label_encode_growing", "predict_per_cluster", "experiment_grouped",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["count_jobs"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    took = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

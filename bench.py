"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dataset_profile", "temporal_split", "stratified_kfold", "temporal_kfold", "behavior_features",
    "burst_windows", "split_feature_sets", "asof_avg_rating", "rolling_burst_ratio", "category_entropy",
    "auc_roc", "roc_curve", "mean_roc_curve", "stratum_metrics", "classification_metrics", "risk_topk_by_group",
    "text_lengths", "tokenize_words", "build_vocabulary", "tfidf", "text_embedding", "mlp_score",
    "shapley_linear", "shapley_sampling", "describe_by_label", "feature_correlation", "feature_density",
    "monthly_volume", "cross_validate", "logreg_balanced", "linear_svm_calibrated", "random_forest", "mlp_focal_train",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from candora.catalog import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    # start the JVM's and the Python workers' first-use work outside the timings
    QUERIES["text_embedding"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

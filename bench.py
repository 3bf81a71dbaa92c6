"""Time the headline queries: warm no-op writes, median of two, one JSON line.

With BENCH_TRAIN=1 the two trainings are timed as well, once each.
"""

import json
import os
import statistics
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "parse_log",
    "parse_stats",
    "label_requests",
    "label_mix",
    "repair_labels_typed",
    "audit_patterns",
    "rule_first_match",
    "rule_match_oldnew",
    "rule_coverage",
    "rule_compare",
    "payload_coverage",
    "feature_table",
    "feature_table_serve",
    "win_unique_url",
    "split_stratified",
    "balanced_sample",
    "join_labels",
    "ban_interval_join",
    "layered_verdict",
    "threshold_sweep",
    "auc",
    "fnr_by_class",
    "fp_tn_means",
    "class_means",
    "score_distribution",
    "fp_breakdown",
    "class_report",
    "top_fn_per_class",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
TRAININGS = ["train_binary", "train_multiclass"] if os.environ.get("BENCH_TRAIN") else []


def main() -> None:
    from logsieve.plans.queries import QUERIES
    from logsieve.session import build_session

    spark = build_session(
        "logsieve-bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        # 100,000 rows: let small shuffles keep all cores busy
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
    )
    spark.sparkContext.setLogLevel("OFF")
    timings: dict[str, float] = {}
    for name in os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else HEADLINE:
        samples = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(samples[1:]), 3)
    for name in TRAININGS:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm median",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

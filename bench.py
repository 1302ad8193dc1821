"""Benchmark: run the headline registered queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and print one
JSON line ``{"metric", "value", "unit", "queries", "sf"}``.

Each query is executed in full with the ``noop`` sink (every row computed, nothing collected to the driver),
``$BENCH_RUNS`` times (default 2); the reported time is the fastest run, so one-off JVM class loading and
expression code generation of a new query shape are not counted as query work.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A1_routing_metrics", "A2_quality_metrics", "A3_metrics_report", "A5_routing_distribution", "A7_cost_by_decision",
    "A9_histogram_quality", "A10_box_stats_latency", "A11_latency_stats", "A12_distribution_by_group",
    "A13_threshold_sweep_quality", "A15_score_cost_correlation", "A16_kpi_summary",
    "F2_token_usage", "F3_adequacy_label", "F11_encode_pair", "F12_pool_mean", "F16_assemble_messages",
    "P1_generate_prompts", "P3_adequacy_dataset", "X1_combine_datasets", "D1_prefix_split", "D2_random_split_exact",
    "D5_collate", "P8_validate_requests", "R3_mf_win_rate", "R4_sw_win_rate", "R8_cascade", "R9_preroute_vs_evaluator",
    "A17_weighted_bce", "A21_binary_metrics_batched", "ST1_assemble_chunks", "ST2_window_metrics",
    "S8_profile_table", "J1_pair_responses",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from escalade.plans.catalog import all_queries
    from escalade.session import get_spark

    parts = os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2)))
    spark = get_spark("escalade-bench", cpus, {"spark.sql.shuffle.partitions": parts})
    qs = all_queries()
    names = [n for n in HEADLINE if n in qs]
    # warm-up (JIT, first-scan metadata): not timed
    qs["A1_routing_metrics"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = max(1, int(os.environ.get("BENCH_RUNS", "2")))
    times = {}
    for n in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()

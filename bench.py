"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ledgerlint.plans.catalog import CATALOG
from ledgerlint.sources.tables import stage_tables

HEADLINE = [
    "profile_missing", "profile_shared_key_lineitem", "rule_summary", "rule_duplicate_lineitem",
    "similarity_ratio", "similar_addresses", "fuzzy_edges", "fuzzy_claims", "fuzzy_claims_names", "layer_comparison",
    "latest_decision", "review_queue", "queue_kpis", "decision_propagation", "review_reasons",
    "seeded_eval", "forest_scores", "effort_metrics", "effort_metrics_global", "full_pipeline",
]

WARM_UP = ["review_queue", "full_pipeline"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()  # start Python workers, load and compile classes, untimed
    def run(name: str) -> None:
        with stage_tables(spark):
            CATALOG[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in WARM_UP:
        run(name)
    warm_up = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "warm_up_sec": warm_up, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

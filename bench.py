"""Time the headline queries on ``$BENCH_SF_DIR`` and print one JSON line.

Every query is executed in full (noop sink), once to warm up and once timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from answerloom import get_session
from answerloom.plans.catalog import QUERIES

HEADLINE = [
    "curate_statistics", "w1_deduplicate", "w2_split_stratified", "w3_split_random", "a1_dataset_stats",
    "r1_parse_basic", "r2_parse_strict", "r11_facts_on_documents", "r14_r16_sample_checks", "a4_check_rates",
    "r19_public_addresses", "a6_accuracy_report", "j1_r7_keyword_scores", "a12_quality_report", "q1_gates",
    "k1_flatten", "k2_index_terms", "k3_j9_topic_matches", "g11_design_chains", "g14_u1_assembled_samples",
    "p5_validate_requests", "r30_task_prompts", "t1_metric_windows", "t1_percentiles", "w5_j11_threshold_alarms",
    "w6_duration_alarms",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")  # one machine: what all executors share
    spark = get_session(
        app="bench", master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            # Building columns is most of a short query; skip recording their call sites.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, second run, total", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to its last row with a no-op sink: once to warm up, then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A1_snapshot_scan",
    "B5_select_analyzers",
    "C4_match_extraction",
    "C5_java_complexity",
    "C7_complexity_matches",
    "C8_log_levels",
    "C13_user_analyzer",
    "A2_version_diff",
    "D1_before_after",
    "D3_exact_renames",
    "D3_similar_renames",
    "D4_projects_left_join",
    "D7_drilldown",
    "E3_stats_ungrouped",
    "E6_group_tree",
    "E8_distribution",
    "E12_extreme_row",
    "F1_top_n",
    "F2_top_n_grouped",
    "G2_sibling_rank",
    "I2_stacked",
]


def main() -> None:
    from suite.all_queries import QUERIES
    from treegauge.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Audit of the executed plans: scans, shuffles of content, and joins that must not occur.

    python -m suite.plans [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import re
import sys

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def final_plan(df) -> str:
    """Text of the plan as it ran."""
    query = df._jdf.queryExecution()
    query.executedPlan().executeCollect()
    text = query.executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def audit(df) -> dict:
    """Counts of what matters in a plan."""
    text = final_plan(df)
    return {
        "scans": len(re.findall(r"FileScan", text)),
        "exchanges": len(re.findall(r"[-:] Exchange|\+- Exchange", text)),
        "reused": len(re.findall(r"ReusedExchange", text)),
        "forbidden": [f for f in FORBIDDEN if f in text],
    }


def main(argv: list[str]) -> None:
    from suite.all_queries import QUERIES
    from treegauge.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        print(f"{name:30s}", audit(fn(spark, sf_dir)), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])

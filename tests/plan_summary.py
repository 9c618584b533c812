"""Summarise the physical plan of every registered report (operators that matter at scale).

Usage: ``python tests/plan_summary.py [sf_dir] > PLANS.md``. Counts come from the final adaptive
plan after one execution (noop sink), so broadcast decisions taken at run time are included.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "shuffles": r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition|\bExchange RoundRobin",
    "broadcasts": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "windows": r"\bWindow \[",
    "sort_aggs": r"SortAggregate",
    "python": r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
    "single_partition": r"SinglePartition",
}


def main(argv):
    from minpair.session import build_session
    import __spark_entry__ as e
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    print(f"# Physical plans at {sf_dir}\n")
    print("Counts per report in the final adaptive plan (noop-sink execution). `single` counts "
          "SinglePartition exchanges (all remaining rows in one task).\n")
    print("| report | shuffles | broadcasts | SMJ | BHJ | BNLJ | windows | sort aggs | python | single |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(e.queries().items()):
        if name in ("m07_linear_baseline_report",):
            continue
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        c = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        print(f"| {name} | {c['shuffles']} | {c['broadcasts']} | {c['smj']} | {c['bhj']} | {c['bnlj']} | "
              f"{c['windows']} | {c['sort_aggs']} | {c['python']} | {c['single_partition']} |", flush=True)


if __name__ == "__main__":
    main(sys.argv)

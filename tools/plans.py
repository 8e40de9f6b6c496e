"""Summarise the final (adaptive) physical plan of registered queries:
operator counts and, per parquet scan, the columns read and the filters
pushed. Usage: python tools/plans.py [--sf DIR] [names...]"""

from __future__ import annotations

import argparse
import os
import re
import sys
import tempfile
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
        "BroadcastNestedLoopJoin", "CartesianProduct", "MapInArrow", "FlatMapCoGroupsInPandas",
        "ArrowEvalPython", "Window", "WindowGroupLimit", "HashAggregate", "ObjectHashAggregate",
        "SortAggregate", "TakeOrderedAndProject", "InMemoryTableScan", "ReusedExchange", "Generate", "Expand")


def final_section(plan: str) -> str:
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return plan


def summarise(plan: str):
    ops = Counter()
    scans = []
    for line in plan.splitlines():
        m = re.match(r"^[\s:+\-*()0-9|]*([A-Z][A-Za-z]+)", line)
        if m and m.group(1) in KEEP:
            ops[m.group(1)] += 1
        if "FileScan parquet" in line:
            table = re.search(r"/([a-z_]+)\.parquet", line)
            cols = re.search(r"FileScan parquet \[([^\]]*)\]", line)
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            scans.append((table.group(1) if table else "?",
                          re.sub(r"#\d+L?", "", cols.group(1)) if cols else "",
                          re.sub(r"#\d+L?", "", pushed.group(1)) if pushed else ""))
    return ops, sorted(set(scans))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from evidentia.session import build_session
    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="evidentia-plans-")})
    import evidentia.queries as Q
    for name in a.names or list(Q.QUERIES):
        df = Q.QUERIES[name](spark, a.sf)
        df.collect()
        ops, scans = summarise(final_section(df._jdf.queryExecution().executedPlan().toString()))
        print(f"### {name}\n")
        print("operators: " + ", ".join(f"{k} {v}" for k, v in sorted(ops.items())) + "\n")
        for t, c, p in scans:
            print(f"- scan `{t}` reads [{c}]" + (f", pushed [{p}]" if p else ""))
        print()


if __name__ == "__main__":
    main()

"""Summarise the physical plan of every registered query into PLANS.md.

usage: python scripts/plan_report.py [sf_dir] > PLANS.md

For each query: parquet scans per table, shuffle exchanges, join strategies,
pushed filters on date columns, and whether any Python evaluation node or
all-pairs join appears. Plans are the AQE initial plans (before execution).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(df) -> dict:
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    tree = text.split("\n\n")[0]
    scans = {}
    for t in re.findall(r"Location: InMemoryFileIndex \[file:[^\]]*/(\w+)\.parquet\]", text):
        scans[t] = scans.get(t, 0) + 1
    pushed = set()
    for f in re.findall(r"PushedFilters: \[([^\]]*)\]", text):
        for m in re.findall(r"(?:GreaterThan|LessThan)(?:OrEqual)?\((\w+),", f):
            pushed.add(m)
    return {
        "scans": scans,
        "exchanges": tree.count("Exchange") - tree.count("BroadcastExchange"),
        "broadcast": tree.count("BroadcastExchange"),
        "smj": tree.count("SortMergeJoin"),
        "bhj": tree.count("BroadcastHashJoin"),
        "range_pushdown": sorted(pushed),
        "bad": [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython") if n in text],
    }


def main(argv) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from rollcall import queries
    from rollcall.session import local_session

    spark = local_session(8, shuffle_partitions=8)
    print("# Physical plans of the registered queries of the award, report and photo operators\n")
    print(f"Generated by `scripts/plan_report.py` on `{sf_dir}` (AQE initial plans; AQE may turn")
    print("sort-merge joins into broadcast joins at run time and reuses identical exchanges).\n")
    print("| query | parquet scans | shuffles | broadcasts | SMJ | BHJ | range filters pushed on | all-pairs / Python |")
    print("|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(queries.REGISTRY.items()):
        s = summarise(fn(spark, sf_dir))
        scans = ", ".join(f"{k}x{v}" for k, v in sorted(s["scans"].items()))
        print(
            f"| {name} | {scans} | {s['exchanges']} | {s['broadcast']} | {s['smj']} | {s['bhj']} | "
            f"{', '.join(s['range_pushdown']) or '-'} | {', '.join(s['bad']) or 'none'} |"
        )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)

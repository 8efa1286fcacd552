"""Summarise the physical plans of the registered queries (after execution,
so AQE's final choices are shown): exchanges, joins, scans, codegen.

Usage: python tools/plans.py [sf_dir] [name ...]  -> markdown on stdout
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberspark.plans.catalogue import QUERIES  # noqa: E402
from emberspark.session import build_session  # noqa: E402

JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def summary(plan: str) -> dict:
    """Counts over the *executed* stages of a final adaptive plan."""
    kinds = re.findall(r"ShuffleQueryStage \d+.*\n\s*\+- (?:ReusedExchange \[[^\]]*\], )?Exchange (\w+)", plan)
    return {
        "shuffles": plan.count("ShuffleQueryStage"),
        "kinds": sorted(set(kinds)),
        "reused": plan.count("ReusedExchange") + plan.count("ReusedSubquery"),
        "joins": sorted({j for j in JOINS if j in plan}),
        "broadcasts": plan.count("BroadcastQueryStage"),
        "pushed": sorted(set(m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if m)),
        "python": any(n in plan for n in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")),
        "windows": len(re.findall(r"\bWindow \[", plan)),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    print("| query | shuffle stages (kinds) | reused | joins | broadcast stages | windows | python | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for n in names:
        df = QUERIES[n](spark, sf_dir)
        df.collect()  # execute this Dataset so the final adaptive plan is shown
        ep = df._jdf.queryExecution().executedPlan()
        plan = (ep.finalPhysicalPlan() if ep.nodeName() == "AdaptiveSparkPlan" else ep).toString()
        s = summary(plan)
        pushed = "; ".join(p[:80] for p in s["pushed"]) or "-"
        print(f"| {n} | {s['shuffles']} ({', '.join(s['kinds']) or '-'}) | {s['reused']} | {', '.join(s['joins']) or '-'} | "
              f"{s['broadcasts']} | {s['windows']} | {'yes' if s['python'] else 'no'} | {pushed} |")
    spark.stop()


if __name__ == "__main__":
    main()

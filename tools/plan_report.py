"""Summarise the physical plan of every core query (after AQE ran; of a query
that writes tables on its way, the plan of its last step):
shuffles, broadcasts, sorts, windows, scans with their pushed filters and
read schemas. Usage: python tools/plan_report.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans import catalog  # noqa: E402
from quire.session import get_session  # noqa: E402


def count(plan: str, pattern: str) -> int:
    return len(re.findall(pattern, plan))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    print("| query | shuffles | broadcasts | sorts | windows | codegen stages | scans (columns read, pushed filters) |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in catalog.QUERIES.items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = count(plan, r"\bExchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)")
        shuffles += count(plan, r"ShuffleQueryStage")
        scans = []
        for m in re.finditer(r"FileScan (\w+) \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan):
            cols = len([c for c in m.group(2).split(",") if c.strip()])
            pushed = m.group(3).strip() or "-"
            scans.append(f"{m.group(1)} {cols} cols, filters: {pushed[:60]}")
        print(f"| {name} | {shuffles} | {count(plan, 'BroadcastExchange') + count(plan, 'BroadcastQueryStage')} "
              f"| {count(plan, r'[^a-zA-Z]Sort \[')} | {count(plan, r'Window \[')} "
              f"| {len(set(re.findall(r'\*\((\d+)\)', plan)))} | {'; '.join(scans) or '-'} |")
    spark.stop()


if __name__ == "__main__":
    main()

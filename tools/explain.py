"""Print the formatted physical plan of a registered query, or just its
scans (ReadSchema / PushedFilters) and exchanges.

Usage: python tools/explain.py <key> [sf_dir] [--full] [--no-aqe]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    key, sf_dir = args[0], (args[1] if len(args) > 1 else "/root/testdata/sf0.01")
    from stockflow.plans.catalog import QUERIES
    from stockflow.session import build_session
    spark = build_session("local[8]", 8)
    if "--no-aqe" in sys.argv:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    df = QUERIES[key](spark, sf_dir)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    if "--full" in sys.argv:
        print(plan)
        return
    for line in plan.splitlines():
        if re.match(r"^\(\d+\) (Scan|Exchange|BroadcastExchange|Window|SortMergeJoin|BroadcastHashJoin)", line) \
                or line.startswith(("ReadSchema", "PushedFilters", "Arguments: hashpartitioning")):
            print(line)


if __name__ == "__main__":
    main()

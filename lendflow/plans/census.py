"""Plan census: the physical-plan shape of every registered query.

    python -m lendflow.plans.census /root/testdata/sf0.01 > docs/PLAN_CENSUS.md

Counts shuffles, join strategies, windows, partial aggregates and Python nodes in the static
plan (AQE off, so the planner's own choices show; AQE re-plans at runtime from real sizes).
"""

from __future__ import annotations

import re
import sys

NODES = (
    ("shuffles", r"(?<!Reused)Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)"),
    ("reused", r"ReusedExchange"),
    ("broadcasts", r"BroadcastExchange"),
    ("bhj", r"BroadcastHashJoin"),
    ("smj", r"SortMergeJoin"),
    ("shj", r"ShuffledHashJoin"),
    ("nested_loop", r"BroadcastNestedLoopJoin|CartesianProduct"),
    ("partial_agg", r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_"),
    ("partial_sort_agg", r"SortAggregate\(key=\[[^\]]*\], functions=\[partial_"),
    ("window", r"\bWindow \["),
    ("group_limit", r"WindowGroupLimit"),
    ("python", r"ArrowEvalPython|BatchEvalPython|FlatMapCoGroupsInPandas|FlatMapGroupsInPandas|MapInPandas"),
)


def physical_plan(df) -> str:
    """``explain()`` text of the static physical plan (AQE switched off while planning)."""
    import contextlib
    import io
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return buf.getvalue()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def census(plan: str) -> dict:
    out = {name: len(re.findall(pat, plan)) for name, pat in NODES}
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    out["scanned_columns"] = sum(len(s.split(",")) for s in schemas)
    return out


def main(argv) -> None:
    from lendflow.plans.queries import queries
    from lendflow.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    cols = [n for n, _ in NODES] + ["scanned_columns"]
    print("# Plan census\n")
    print(f"Static physical plans (AQE off) of every registered query on `{sf_dir}`; generated by "
          "`python -m lendflow.plans.census`.  At this size the planner broadcasts the small driver "
          "tables from file statistics; at scale the same joins plan as sort-merge joins unless a side is "
          "proven small, and AQE re-plans from runtime sizes.  `nested_loop` counts broadcast "
          "nested-loop joins and cartesian products (none expected).\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---:" for _ in cols) + " |")
    for name, fn in queries().items():
        c = census(physical_plan(fn(spark, sf_dir)))
        print(f"| {name} | " + " | ".join(str(c[k]) for k in cols) + " |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

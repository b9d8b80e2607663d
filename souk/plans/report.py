"""Physical-plan summary of every operator, as it would plan on large data.

    python -m souk.plans.report /root/testdata/sf0.01 > PLANS.md

Automatic broadcasts are switched off (large tables never qualify), so the
plan shows the shuffle joins a cluster would run; explicit broadcasts of
proven-small frames (nation, one-row aggregates) remain. For each operator:
exchanges by kind, join strategies, and the columns each scan reads.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

from souk.operators.common import person_orders
from souk.plans.registry import OPERATORS, run
from souk.session import build_session
from souk.sources.tpch import from_tpch

LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.maxMetadataStringLength": "10000",
}


def summarize(plan: str) -> dict[str, str]:
    exchanges = Counter(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|"
                                   r"RoundRobinPartitioning)", plan))
    joins = Counter(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|"
                               r"BroadcastNestedLoopJoin|CartesianProduct)", plan))
    join_types = Counter(re.findall(r"Join \[[^\]]*\], \[[^\]]*\], (\w+)", plan))
    scans = sorted(set(re.findall(r"ReadSchema: struct<(.*?)>(?:,|\s|$)", plan)))
    return {
        "exchanges": ", ".join(f"{k} {v}" for k, v in sorted(exchanges.items())) or "none",
        "joins": ", ".join(f"{k} {v}" for k, v in sorted(joins.items())) or "none",
        "join types": ", ".join(f"{k} {v}" for k, v in sorted(join_types.items())) or "-",
        "windows": str(len(re.findall(r"\bWindow \[", plan))),
        "expand": "yes" if "Expand [" in plan else "no",
        "scans": "; ".join(re.sub(r":(decimal\(\d+,\d+\)|[a-z_]+)", "", s) or "(row count only)"
                           for s in scans) or "checkpointed frame",
    }


def main(sf_dir: str) -> None:
    spark = build_session(extra=LARGE)
    t = from_tpch(spark, sf_dir)
    print("# PLANS — physical plan per operator (large-data planning)\n")
    print(__doc__.split("\n\n", 2)[2].strip() + "\n")
    print("| key | exchanges | joins | join types | windows | expand | columns read |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    # The frame that cust_rfm*, dash_rfm_segments and cust_top_ranked write before they go on.
    frames = {"person_orders (written)": lambda: person_orders(t)}
    for key, make in {**frames, **{k: (lambda k=k: run(k, t, as_of="2001-10-01")) for k in OPERATORS}}.items():
        s = summarize(make()._jdf.queryExecution().executedPlan().toString())
        print(f"| `{key}` | {s['exchanges']} | {s['joins']} | {s['join types']} | {s['windows']} "
              f"| {s['expand']} | {s['scans']} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")

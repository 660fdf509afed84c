"""Write PLANS.md: the physical plan of every exam query (compact form).

Usage: python tools/dump_plans.py [sf_dir]
For each key: the operator tree, then the scan and exchange details that
matter for scale (ReadSchema, PushedFilters, partitioning, window limits).
Queries that write (store, streams) are shown by the plan of their read-back.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KEEP = re.compile(r"^(ReadSchema|PushedFilters|PartitionFilters|Arguments: (hashpartitioning|rangepartitioning|SinglePartition)"
                  r"|Arguments: \[.*\], \[.*\], row_number\(\), \d+, (Partial|Final)|Functions \[\d+\]: \[partial_)")


def compact(plan: str) -> str:
    tree, details, current = [], [], None
    in_tree = True
    for line in plan.splitlines():
        if line.startswith("== Physical Plan =="):
            continue
        if in_tree:
            if line.strip() == "":
                in_tree = False
                continue
            tree.append(line)
            continue
        m = re.match(r"^\((\d+)\) (.+)$", line)
        if m:
            current = f"({m.group(1)}) {m.group(2).strip()}"
            continue
        if KEEP.match(line.strip()):
            details.append(f"{current}: {line.strip()}"[:240])
    return "\n".join(tree + [""] + details)


def main() -> None:
    from examlytics.session import get_spark
    from examlytics.plans import catalog
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    out = ["# Physical plans", "",
           f"Generated by `python tools/dump_plans.py {sf_dir}` (local[8], AQE on; the initial plan, before",
           "runtime re-optimisation). Per query: the operator tree, then scan columns / pushed filters,",
           "shuffle partitioning, partial aggregates and partial window limits.", ""]
    for key, fn in catalog.QUERIES.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf_dir).explain("formatted")
        out += [f"## {key}", "", "```", compact(buf.getvalue()), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()

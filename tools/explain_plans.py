"""Summarise the executed plans of the reports into docs/PLANS.md.

Usage: python tools/explain_plans.py [sf_dir]
For each report: exchanges, join strategies, aggregates and every scan's pushed
filters and read schema, taken from the final adaptive plan after one run.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.demo.queries import QUERIES  # noqa: E402
from ledgerline.session import local_session  # noqa: E402

REPORTS = ["net_invoiced", "sales_order", "served_invoice", "customer_master", "net_sellout", "price_list_nonvan",
           "uncategorized_skus", "returns_pivot", "deduct_orders", "latest_customer_row"]


def summarise(name: str, plan: str) -> list[str]:
    final = plan.split("== Initial Plan ==")[0]
    count = lambda pat: len(re.findall(pat, final))
    lines = [f"### {name}", "",
             f"- shuffle exchanges: {count(r'Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)')}"
             f", broadcast exchanges: {count(r'BroadcastExchange')}",
             f"- joins: BroadcastHashJoin {count(r'BroadcastHashJoin')}, SortMergeJoin {count(r'SortMergeJoin')}, "
             f"ShuffledHashJoin {count(r'ShuffledHashJoin')}",
             f"- aggregates: HashAggregate {count(r'HashAggregate')}, SortAggregate {count(r'SortAggregate')}",
             f"- Python operators: {count(r'(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)')}",
             "", "Scans:", ""]
    for scan in re.findall(r"FileScan parquet[^\n]*", final):
        table = re.search(r"Location: [^\[]*\[[^\]]*/([a-z_]+\.parquet|materialised/\w{6})", scan)
        pushed = re.search(r"PushedFilters: (\[[^\]]*\])", scan)
        schema = re.search(r"ReadSchema: (struct<[^>]*>)", scan)
        lines.append(f"- `{table.group(1).replace('.parquet', '') if table else '?'}` pushed {pushed.group(1) if pushed else '[]'}; "
                     f"reads {schema.group(1) if schema else '?'}")
    return lines + [""]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    out = ["# Executed plans", "",
           f"Final adaptive plans after one run at `{sf_dir}` on local[*] (generated by `tools/explain_plans.py`).", ""]
    for name in REPORTS:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        df.collect() if name != "net_invoiced" else df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        out += summarise(name, plan)
    os.makedirs("docs", exist_ok=True)
    with open("docs/PLANS.md", "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()

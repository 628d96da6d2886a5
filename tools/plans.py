"""Write the physical plan trees of key queries to docs/PLANS.md.

Plans are the AQE final plans (each query is executed through its own
Dataset, then explained), trimmed to the operator tree plus the scan lines
that show pruning (ReadSchema) and pushdown (PushedFilters)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEY = ["d1_rate_by_item_group", "d3_mean_by_year", "d4_summary", "d5_value_counts", "d2_rate_top5_long", "d6_mode_by_region", "b15_topk_bucket",
       "c1_target_encode", "i4_stratified_split", "d12_itemsets", "d13_rules", "d19_auc",
       "e2_roc", "i10_kmodes_assign", "i21_score_requests", "d12_basket_itemsets", "i3_customer_codes", "i18_rank_open"]


def tree(df) -> str:
    """Plan text with cached-relation subtrees collapsed (the shared cases
    plan is listed once at the top)."""
    qe = df._jdf.queryExecution()
    out, skip_depth = [], None
    for line in qe.executedPlan().toString().split("\n"):
        if not line.strip():
            continue
        if "== Initial Plan ==" in line:
            break
        depth = len(line) - len(line.lstrip(" :|+-"))
        if skip_depth is not None:
            if depth > skip_depth:
                continue
            skip_depth = None
        if "InMemoryRelation" in line:
            out.append(line[:depth] + "InMemoryRelation [cached cases table, see top]")
            skip_depth = depth
            continue
        out.append(line if len(line) < 240 else line[:237] + "...")
    return "\n".join(out)


def main():
    sf = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.1")
    from casebook.session import get_session
    from casebook.sources.cases import tpch_cases
    from casebook.plans.queries import QUERIES
    spark = get_session(master="local[8]", shuffle_partitions=16)
    out = ["# Physical plans of key queries", "",
           f"Generated by `tools/plans.py` on `{sf}` (local[8], AQE on; final plans after "
           "execution).  At this scale most inputs are under the broadcast threshold, so "
           "the planner broadcasts them; at 100 TB the same size checks pick shuffle joins.",
           ""]
    base = tpch_cases(spark, sf)
    out += ["## cases (shared input)", "", "```",
            base._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            .split("\n\n")[0], "```", ""]
    for name in KEY:
        df = QUERIES[name](spark, sf)
        df.collect()          # runs on this Dataset's own plan -> AQE final plan
        out += [f"## {name}", "", "```", tree(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from arqueo.session import local_session
from checks.queries import bound

HEADLINES = (
    "fx_summary", "fx_portfolio_totals", "fx_daily_totals", "fx_balance_spans", "fx_movements",
    "payables_aging", "payables_risk_totals", "payables_top_suppliers", "payables_group_totals",
    "payables_payment_file", "payables_open_bills", "cash_payables_by_week", "cash_flow_four_weeks",
    "cash_weekly_close", "statement_items", "statement_ratios", "document_last_number",
    "executive_top_invoices", "executive_summary", "loan_pricing", "scenario_spreads", "scenario_cash_cycle",
)


def run(names: tuple[str, ...]) -> dict[str, float]:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    for name in ("fx_summary", "statement_items"):  # untimed: class loading and first compilation of the JVM
        bound(name)(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        bound(name)(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


if __name__ == "__main__":
    seconds = run(tuple(sys.argv[1:]) or HEADLINES)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))

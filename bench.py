"""Time the headline queries; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on
``local[BENCH_CPUS]``. Every result is written to Spark's ``noop`` sink, so all
rows are computed and none is collected. Each query runs ``BENCH_RUNS`` times
(default 3) and its best time counts, as the first run pays for code generation.
``BENCH_ALL=1`` times every registered query instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import time

from plumbline.catalogue import QUERIES
from plumbline.catalogue.registry import Tables
from plumbline.functions.quantiles import exact_percentiles
from plumbline.model import ColumnRule
from plumbline.plans.validate import rule_report
from plumbline.session import local_session

LINE_RULES = [
    ColumnRule("l_orderkey", type="int", not_null=True, range=(0, 10_000_000_000)),
    ColumnRule("l_quantity", type="float", null_rate=0.01, range=(1, 49)),
    ColumnRule("l_extendedprice", type="float", range=(0, 90_000)),
    ColumnRule("l_discount", range=(0, 0.09)),
    ColumnRule("l_returnflag", allowed=["A", "N"]),
    ColumnRule("l_linestatus", matches="^[OF]$"),
    ColumnRule("l_shipdate", type="timestamp", not_null=True),
]
HEADLINE = (
    "rule_unique", "agg_dup_composite", "rule_outliers_iqr", "rule_outliers_zscore", "rule_distribution_raw", "join_orphans",
    "join_orphan_count", "join_orphans_multi", "join_reconcile", "join_group_limit", "agg_group_distinct", "agg_avg_lag",
    "validate_check", "validate_sample", "suite_run", "alert_events", "stream_window_rules", "stream_sustained_alerts",
)


def fused_rules(spark, root):
    return rule_report(Tables(spark, root).lineitem, LINE_RULES)


def one_job_per_rule(spark, root):
    """The comparison: the same rules, a pass over the table for each."""
    out = None
    for rule in LINE_RULES:
        part = rule_report(Tables(spark, root).lineitem, [rule])
        part.write.format("noop").mode("overwrite").save()
        out = part
    return out


def iqr_prices(spark, root):
    return rule_report(Tables(spark, root).lineitem, [ColumnRule("l_extendedprice", outliers="iqr")])


def percentile_narrowing(spark, root):
    exact_percentiles(Tables(spark, root).lineitem, ["l_extendedprice"], [0.25, 0.75])
    return None




EXTRA = {
    "fused_rules_lineitem": fused_rules, "one_job_per_rule_lineitem": one_job_per_rule, "iqr_l_extendedprice": iqr_prices,
    "percentile_by_narrowing": percentile_narrowing,
}


def timed(spark, run, root, times):
    best = float("inf")
    for _ in range(times):
        start = time.perf_counter()
        df = run(spark, root)
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    times = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "plumbline-bench")
    timed(spark, QUERIES["validate_check"], root, 1)
    chosen = QUERIES if os.environ.get("BENCH_ALL") else {**EXTRA, **{n: QUERIES[n] for n in HEADLINE}}
    seconds = {name: timed(spark, run, root, times) for name, run in chosen.items()}
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": root.rsplit("sf", 1)[-1], "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

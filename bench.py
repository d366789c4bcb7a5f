"""Benchmark of the headline queries: one JSON line on standard output.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. Every query is
built and its rows are produced in full; the time includes planning.
"""

from __future__ import annotations

import json
import os
import time

from panelwise.catalog import QUERIES
from panelwise.session import build_session

HEADLINE = [
    "a1_panel_rollup",
    "j1_three_way_join",
    "a2_entity_profile",
    "i13_focus_summary",
    "t4_priority_queue",
    "a9_quantiles_bucketed",
    "w5_pareto_customers",
    "a7_spearman",
    "m1_trend_forecast",
    "m5_forecast_run_short_series",
    "m6_order_search",
    "m9_cusum_break",
    "m8_granger",
    "m10_order_selection",
    "m16_isolation_forest",
    "m17_tail_score_customers",
    "m24_panel_features",
    "m27_simplex_weights",
    "m31_placebo",
    "q1_ks_distance",
    "q3_psi_quantile",
    "q7_monitor",
    "a19_dedupe",
    "r1_clean_job",
    "v4_unique",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start executors
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "lineitem_rows": lines,
                "rollup_rows_per_sec": round(lines / times["a1_panel_rollup"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

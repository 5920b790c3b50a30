"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.  The
figures compared against are for a table already in memory, so the tables are
loaded and kept first; the loading time is reported as ``load``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import QUERIES  # noqa: E402
from tidemark.catalog.registry import table  # noqa: E402
from tidemark.session import build_session  # noqa: E402

TABLES = ["lineitem", "orders", "events", "part", "customer", "documents"]

HEADLINE = [
    "filter_then_aggregate",
    "filter_accounting",
    "narrowed_table",
    "count_analysis",
    "overview",
    "describe_numeric",
    "describe_categorical",
    "numeric_profile",
    "histogram",
    "column_profile",
    "quality_scores",
    "duplicate_documents",
    "robust_statistics",
    "pearson",
    "spearman",
    "kendall_line_items",
    "chi_square",
    "anova",
    "levene",
    "kruskal",
    "mann_whitney_pairs",
    "group_comparison",
    "bootstrap_median_intervals",
    "association_report",
    "kmeans_profile",
    "dbscan_profile",
    "outlier_summary",
    "outliers_isolation_forest",
    "outliers_elliptic_envelope",
    "rule_summary",
    "series_anomalies",
    "series_forest_anomalies",
    "trend_analysis",
    "seasonal_test",
    "numeric_drivers",
    "category_drivers",
    "bottlenecks",
    "event_forward_fill",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"}
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    for name in TABLES:
        table(spark, folder, name).persist().count()
    load = round(time.perf_counter() - start, 3)
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "load": load,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

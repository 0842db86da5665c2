"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hexlytics.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Layer builds first; they leave the stored tables the other queries read.
HEADLINE = [
    "raw_yearly_files", "bronze_incidents", "silver_features", "cell_levels",
    "daily_counts_levels", "gold_daily_cells", "gold_monthly_cells", "gold_rolling_r9",
    "drill_mapping", "period_summary_r8", "cell_context_r8", "hotspots_by_type_r8",
    "hotspots_drilled_r8", "kpis_focus_r9", "area_labels_r9", "offense_mix", "hourly_profile",
    "normality_by_user", "levene_median", "mann_whitney", "spearman", "kendall",
    "fdr_benjamini_hochberg", "hotspot_regions_r7", "incident_clusters", "rows_per_year",
]


def main() -> None:
    from workload import QUERIES, stored as ST

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        # The default of 64 MB would leave the small test tables to one task.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    for layer in ("raw_rows", "bronze_path", "silver_path", "gold_path", "drill_path"):
        timed(f"store_{layer.split('_')[0]}", lambda: getattr(ST, layer)(spark, SF_DIR))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())

    rows = ST.bronze_rows(spark, SF_DIR).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1], "incidents": rows,
        "cell_assignments_per_sec": round(rows / seconds["cell_levels"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

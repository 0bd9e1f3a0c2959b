"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tablewash.session import build_session
from tablewash.workloads import all_queries

HEADLINE = (
    "cell_strip", "cell_currency", "cell_to_float", "cell_to_datetime", "cell_standardize_ids", "norm_zscore",
    "fill_mean", "fill_median", "fill_mode", "fill_forward", "fill_forward_grouped", "fill_sequential",
    "join_lookup_fill", "join_enforce_fk", "agg_fk_integrity", "dedup_rows", "dedup_documents",
    "outlier_iqr", "outlier_lineitem", "outlier_iqr_multi",
    "prof_nulls", "prof_lineitem", "prof_cardinality", "detect_issue_report", "diff_cells",
    "qual_overall", "qual_text_documents", "valid_report", "log_reward", "log_final_score",
    "recipe_easy", "recipe_hard", "recipe_linked_orders", "auto_clean_hard",
)

#: Seconds after which a query is not run again.
LONG = 8


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus if cpus.isdigit() else 8), "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    todo = all_queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm-up
    times = {}
    for name in HEADLINE:
        runs = []
        # A first run warms up; then the median of three, of fewer where one takes long.
        while len(runs) < 4 and (len(runs) < 2 or sum(runs) < LONG):
            start = time.time()
            todo[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

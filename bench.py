"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from recordmill import build_session
from recordmill.plans.queries import QUERIES

HEADLINE = (
    "a5_export_text", "a7_labelled_lines", "b1_extract_links", "b5_extract_publish_time", "b7_explode_cells",
    "b11_parse_horizontal_multi", "b15_extract_basis", "b16_extract_content", "b20_expand_multi_record", "b21_join_list_detail",
    "c3_record_cap", "c5_filter_month", "c8_take_while_recent", "d2_clean_text", "d_clean_records", "d7_decision_number",
    "e1_process_category", "e4_canonicalize", "e8_renumber", "e9_dedup_business_key", "e11_merge_new",
    "e12_upsert_master", "e13_upsert_counts", "f2_master_stats", "f3_quality_report", "f5_kpis", "f7_daily_trend",
    "g1_incremental_ingest", "g3_daily_trend_stream", "run_pages_to_ledger",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "recordmill-bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["f1_summary_by_category"](spark, sf_dir).collect()  # start the workers
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

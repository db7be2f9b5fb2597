"""Time the headline queries once each and print one JSON line.

Environment: BENCH_SF_DIR (folder of tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import time

from maskwell.plans import catalog
from maskwell.session import build_session

HEADLINE = (
    "scan_documents", "detect_documents", "pii_type_counts", "redact_documents",
    "token_documents", "scan_mixed", "mask_conversations", "mask_customers", "csv_lines",
    "page_units", "threats_documents", "threats_pages", "quarantine_split", "file_hashes",
    "dashboard_overview", "pii_by_type", "pii_heatmap", "filetype_share", "risk_levels",
    "upload_timeline", "files_enriched", "file_search", "bulk_export", "failed_logins",
    "user_action_counts", "audit_top", "siem_events", "inactivity_timeouts", "sessions",
    "files_current", "cascade_delete", "word_boxes", "sanitize_uploads", "stream_scan",
    "stream_failed_logins", "stream_sessions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["scan_documents"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

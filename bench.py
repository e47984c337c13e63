"""Times the headline queries on the tables in $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINES = (
    "ledger_stats", "ledger_daily", "job_latest_state", "alert_hourly", "text_lines", "ocr_quality", "repeated_lines_ratio10", "edge_heading_scores", "doc_type_scores", "header_footer_positions",
    "heading_levels", "reading_order", "aligned_tables", "block_cell_assignment", "html_elements", "findings_structure", "compliance_score", "document_end_to_end",
)


def main() -> None:
    from inkstone.plans import catalog
    from inkstone.plans.session import get_session

    cores, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", cores=cores, partitions=int(cores), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()  # noqa: E731  runs the whole plan
    sink(spark.range(1000))
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        began = time.perf_counter()
        sink(catalog.QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

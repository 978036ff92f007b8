"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofspark import catalog  # noqa: E402
from proofspark.session import local_session  # noqa: E402

HEADLINE = [
    "chunk_documents", "chunk_long_paragraphs", "rule_candidates", "resolved_occurrences", "protected_fragments", "issues_by_class",
    "report_summary", "line_segments", "locate_spans", "candidate_payloads", "normalized_responses", "candidate_requests", "chunk_reuse",
    "evaluation", "contested_evaluation", "issue_evaluation", "markdown_reports", "history_pages", "next_unreviewed", "recovered_leases",
    "expired_inputs", "deletion_plans", "login_pressure", "progress_log", "usage_rollup", "ops_alerts", "streamed_ops", "streamed_progress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = catalog.collect("QUERIES")
    wanted = sys.argv[1:] or HEADLINE
    spark.range(1).count()
    times = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    chars = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).selectExpr("sum(length(text)) AS n").first()["n"]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "document_chars": chars,
    }))


if __name__ == "__main__":
    main()

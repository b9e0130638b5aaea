"""Wall time of the headline queries, cold start excluded; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2: best of two).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skillgrid.session import build_session  # noqa: E402
from suite.registry import QUERIES  # noqa: E402

HEADLINE = [
    "latest_posting", "posting_upsert", "demand_rollup", "demand_cube", "demand_relaxed", "gap_missing", "gap_score",
    "category_gaps", "recommend_postings", "recommend_all_postings", "recommend_results", "market_status", "filter_options", "top_titles_region",
    "text_skill_mentions", "text_skill_list", "text_many_terms", "resume_chunks_max", "clean_text", "listing_cards", "payload_normalise",
    "ingest_tagged", "batch_clean", "vector_topk", "ensemble_tags", "stream_batch_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="16g", spark__python__sql__dataFrameDebugging__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["market_status"](spark, folder).collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            # All columns of all rows are worked out; nothing is sent to the driver.
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)$", folder)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(found.group(1)) if found else folder}))


if __name__ == "__main__":
    main()

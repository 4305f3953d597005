"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma-separated names) narrow a run.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from pagewright.plans import catalogue
from pagewright.session import tuned

HEADLINE = [
    "meaningful_pages", "chunk_pages", "sentence_split", "translation_windows", "language_profile", "detect_language",
    "keywords_topk", "keywords_per_source", "tfidf_keywords", "extractive_summary", "html_pages", "upload_dedup",
    "summary_requests", "run_inference_stub", "cache_lookup", "document_result", "report_rows", "progress_events",
    "job_state", "job_state_stream", "history_fold", "history_delete", "speed_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
    spark = tuned(builder.config("spark.sql.shuffle.partitions", cpus)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    sf = sf_dir.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default the sf0.1 tables) and ``BENCH_CPUS`` (default 8).
Names on the command line pick single queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from workload.queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = (
    "top_companies", "match_statistics", "recent_matches", "top10_per_resume", "ranked_matches",
    "new_jobs_insert", "new_matches_insert", "match_status_latest", "job_cards_nav",
    "job_detail_keys", "resume_skills", "keyword_sets", "resume_education", "keyword_jaccard",
    "tfidf_pairs", "semantic_pairs", "match_scores", "best_matches", "match_scores_text_only",
    "digest", "stream_ingest", "job_cards_classes", "job_details_nested", "skills_match", "tfidf_pairs_capped",
    "match_full_records", "match_run_second", "stream_match",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(2 * CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["match_statistics"](spark, FOLDER).collect()  # start-up is not part of a query
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total time of the headline queries",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": FOLDER.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from recallgrid.plans.catalog import QUERIES  # noqa: E402
from recallgrid.sources.storage import scratch  # noqa: E402

HEADLINE = [
    "accuracy_by_topic",
    "learner_totals",
    "learner_state",
    "answer_history",
    "topic_mastery_by_attempt",
    "topic_mastery_by_question",
    "exam_progress",
    "exam_progress_complete",
    "hardest_questions",
    "text_deduplicated",
    "repeated_ids",
    "topic_merge",
    "classified_responses",
    "confidence_histogram",
    "import_findings",
    "images_rewritten",
    "quiz_page_questions",
    "bank_upsert",
    "next_unanswered",
    "next_topic_first",
    "exam_paper_challenging",
    "exam_paper_balanced",
    "next_adaptive",
    "bank_import",
    "bank_from_pages",
    "cards_updated",
    "learner_state_stream",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            with scratch(spark):
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        # The first run warms up.
        seconds[name] = round(statistics.median(times[1:]), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

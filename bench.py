"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Before timing, the first query runs once on the smallest tables beside them, so
that the start of the engine is not counted as work of that query.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "preprocessed_light", "preprocessed_heavy", "clean_light", "tokens_no_stopwords",
    "resolve_location", "month_ids", "sample_exact", "fold_assignment",
    "sentiment_counts", "sentiment_means", "sentiment_bias_test",
    "term_stats", "top_ngrams", "topic_terms", "topic_model", "score_sentiment", "write_read_partitioned",
    "csv_by_header",
]


def main() -> None:
    from posttide.session import build_session
    registered = importlib.import_module("__spark_entry__").queries()
    optional = sorted((n for n in registered if n.startswith("op") and n[2].isdigit()), key=lambda n: int(n[2:].split("_")[0]))

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "20g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    warm_up = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_up):
        registered[HEADLINE[0]](spark, warm_up).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or [*HEADLINE, *optional, *(["pipeline"] if "pipeline" in registered else [])]
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()

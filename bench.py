"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is run to a no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text", "preprocess_text", "text_statistics", "char_class_counts", "readability", "keyword_counts", "coin_flags",
    "production_features", "polarity_score", "valence_score", "ensemble_label", "threshold_classifier", "lexicon_join",
    "subreddit_label_profile", "subreddit_stats", "quality_summary", "latest_predictions", "dedup_keep_first", "stratified_split",
    "tfidf", "metrics_udaf", "label_qa_report", "hourly_metrics", "latency_percentiles", "rolling_latency", "rate_limit_audit",
    "psi", "ks_two_sample", "augment_minority_ratio", "stream_hourly_metrics", "baseline_classifier",
]


def main() -> None:
    from sentiloom.plans import catalog  # noqa: F401
    from sentiloom.plans.registry import CATALOG
    from sentiloom.session import build_session, clear_scratch

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false", spark__sentiloom__dealTexts=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the executors
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

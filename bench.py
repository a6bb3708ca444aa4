"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a
comma-separated choice of queries (``all`` for every registered one).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from reviewlens.catalog import ENTRIES
from reviewlens.session import build_session

HEADLINE = (
    "clean_entities_job", "clean_reviews_job", "dedup_keep_first", "dup_rows", "enrich_left", "group_mean_on_row",
    "describe_many", "distinct_per_group", "hist_equal_width", "monthly_trend", "language_vote", "normalize_substring",
    "remove_words", "word_freq", "concat_by_group", "tfidf_smooth", "corpus_documents", "similar_docs",
    "recommend_keyword_per_source", "recommend_keyword_pooled", "recommend_index", "vector_topk", "string_index",
    "als_predict", "als_recommend_all", "hybrid_score", "strengths_weaknesses", "word_cloud_entity",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(ENTRIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session("reviewlens-bench", f"local[{cpus}]", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's readers and code generator before the clock does.
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES (comma
separated names) choose what runs. Each query is run to completion into a sink that reads all
rows; the figure is the better of two runs.
"""

import json
import os
import time

from codeloom.plans import load
from codeloom.session import clear_runs, local_session

HEADLINE = (
    "lang_detect language_distribution strip_comments preprocess_pages line_explode prefix_context "
    "keyword_relevance keyword_match style_score py_syntax py_imports py_functions node_at_position "
    "analyse_corpus issue_counts suggest_fixes security_report completion_score import_usage "
    "issue_hotspots score_distribution bigram_counts bigram_scores bigram_rank_topn topk_topp "
    "next_token_candidates log_softmax hash_embedding knn_l2 rag_prompt session_gate_asof "
    "token_interval_join login_issue permission_check register_unique profile_merge profile_vector "
    "personal_rerank throttle_delay debounce rate_limit cache_split telemetry_sliding ingest_pylint "
    "ingest_bandit serve_completions stream_rate_limit stream_debounce inline_completions append_snippets "
    "two_token_candidates retrieve_snippets stream_suggest_on_change stream_throttle throttle_default "
    "rate_limit_hourly token_permission_check token_ranges relevant_pairs rule_table_fixes user_table_jobs "
    "stream_session_gate stream_profile stream_ingest long_completions"
).split()


def timed(plan, spark, folder):
    start = time.perf_counter()
    plan(spark, folder).write.format("noop").mode("overwrite").save()
    taken = time.perf_counter() - start
    clear_runs(spark)
    return taken


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    plans = load()[0]
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in names:
        seconds[name] = round(min(timed(plans[name], spark, folder) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()

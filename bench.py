"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data set (default sf0.1), BENCH_CPUS the local cores (default 8). Every
query is run once to warm up on the smallest data set of the same folder, then once measured;
all its rows are computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "score_mailbox", "score_urls", "score_files", "score_headers", "content_features", "all_features",
    "content_manipulation", "rule_scan_text", "join_lexicon", "stats_overall_30d", "report_user_risk",
    "report_attack_vectors", "report_threat_trends", "report_daily_doc", "top_threat_senders", "agg_ioc_verdict",
    "behaviour_anomaly", "graph_stats", "win_context_anomaly", "join_similar_threats", "rate_limit_batch",
    "ioc_ttl_batch", "sink_upsert_analysis", "ml_metrics", "ml_roc_auc", "stream_tumbling_levels",
]


def main() -> None:
    import catalog
    from datasets.views import view
    from mailquarry.session import local_session

    catalog.load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="12g", name="bench")
    wanted = sys.argv[1:] or HEADLINE
    smallest = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    warm_dir = smallest if os.path.isdir(smallest) else sf_dir

    def run(key: str, where: str) -> float:
        started = time.perf_counter()
        catalog.QUERIES[key](spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times = {}
    for key in wanted:
        run(key, warm_dir)
        times[key] = round(run(key, sf_dir), 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir),
    }
    if "score_mailbox" in times:
        mails = view(spark, sf_dir, "v_emails").count()
        result["mails"] = mails
        result["mails_per_second"] = round(mails / times["score_mailbox"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()

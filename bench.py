"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores, BENCH_QUERIES
(comma-separated, or "all") the queries. Every query is run to its last row with
the no-op sink, once to warm up and once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from evalspark import catalog
from evalspark.session import local_session

HEADLINE = (
    "scorecard", "exec_match", "exec_match_multiset", "exec_match_pair", "diff_summary", "diff_sample",
    "optimization_score", "review_candidates", "efficiency_median", "failures_top3", "cohens_kappa",
    "overall_agreement", "disagreements", "judge_budget", "judge_usage", "judge_verdicts", "result_csv_head",
    "run_fingerprint", "changed_components", "dedup_runs", "pair_cases", "corpus_violations", "read_golden",
    "read_only_lint", "report_lines", "q_last_quarter", "q_top100", "q_never_ordered", "q_safe_ratio", "q_sum_if",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    catalog.load()
    names = list(catalog.QUERIES) if chosen == "all" else (chosen.split(",") if chosen else list(HEADLINE))
    spark = local_session(cpus, "evalspark-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
        print(f"{name:28s} {seconds[name]:.3f}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()

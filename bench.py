"""Headline-query bench: one JSON line with per-query wall seconds.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set). Each query runs to
completion through the no-op sink (full execution, nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reqscope.plans import catalog  # noqa: E402
from reqscope.session import local_session  # noqa: E402

HEADLINE = [
    "eda_summary",
    "length_histogram",
    "top_reasons",
    "run_results",
    "reason_performance",
    "summary",
    "paper_summary",
    "paired_t_tests",
    "wilcoxon_tests",
    "split_intra",
    "corpus_term_df",
    "nb_run_results",
    "ml_nb_run_results",
    "csv_round_trip",
    "stream_run_results",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="reqscope-bench")
    # warm-up (JIT, class loading) on the smallest tables, not timed
    small = "/root/testdata/sf0.001"
    if os.path.exists(small):
        catalog.QUERIES["eda_summary"](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

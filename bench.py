"""Benchmark: run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 3; each query's time is the median of the repetitions).
Each query is run to completion with the ``noop`` sink (full execution, no
result sent to the driver). Times are wall-clock seconds per query, measured
in steady state: every headline query first runs once on the smallest data
set next to BENCH_SF_DIR (sf0.001 when present), so JIT compilation and
Python worker start-up are not charged to the first query that needs them.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scriptorium.plans import queries as Q  # noqa: E402
from scriptorium.session import get_spark  # noqa: E402

HEADLINE = [
    "q01_scan_articles",
    "q04_clean_text",
    "q02_load_corpus",
    "q11_encode_hashing",
    "q13_retrieve_top_k",
    "q14_supporting_docs",
    "q16_rerank_top_k",
    "q17_retrieve_and_rerank",
    "q19_render_prompt",
    "q21_pivot_answers",
    "q22_get_or_create",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app_name="scriptorium-bench", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": "16g"})
    names = sys.argv[1:] or HEADLINE
    # Warm the JVM and Python workers once per query, outside the timings.
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:
        Q.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "3")))
    samples = {name: [] for name in names}
    for _ in range(repeats):
        for name in names:
            t0 = time.perf_counter()
            Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples[name].append(time.perf_counter() - t0)
    times = {name: round(statistics.median(v), 3) for name, v in samples.items()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

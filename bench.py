"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs twice;
"queries" has the second, warm run, "first_run" the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metaeval.plans.queries import QUERIES  # noqa: E402
from metaeval.session import local_session  # noqa: E402

HEADLINE = (
    "spearman_all", "spearman_by_system", "spearman_pooled", "cascade_grid", "corr_report",
    "pred_parse", "score_scan_positional", "align_left", "split_union_ordered", "prompt_build",
    "vocab_build", "token_encode", "batch_pad", "sequence_assemble", "batch_score_stub",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # start-up of the session and the readers is not part of any query
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    cold, times = {}, {}
    for found in (cold, times):
        for name in wanted:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            found[name] = round(time.perf_counter() - start, 3)
            print(name, found[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "first_run": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   data folder, default /root/testdata/sf0.1
BENCH_CPUS     local cores, default all
BENCH_RUNS     timed runs per query after one warm-up, default 3; the median counts
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from changeflow import build_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "current_state",
    "state_by_anti_join",
    "orders_current_state",
    "orders_merged_state",
    "orders_patched_state",
    "compacted_state",
    "routed_counts",
    "routed_changes",
    "ddl_routed",
    "decoded_changes",
    "event_positions",
    "sync_event_records",
    "event_stats",
    "event_stats_by_type",
    "latency_stats",
    "error_stats",
    "target_stats",
    "target_listing",
    "current_position",
    "events_filtered",
    "events_page",
    "events_deep_page",
    "last_events",
    "throughput_per_second",
    "throughput_series",
    "deduplicated_events",
    "events_hourly",
    "latency_hourly",
    "health",
    "metrics_24h",
    "saved_events",
)
# one run each: they start a stream, or write and rewrite whole tables
ONCE = ("streamed_state", "events_after_cleanup")


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    memory = os.environ.get("BENCH_MEMORY", "8g")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory}
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **conf)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 4)
    for name in ONCE:
        seconds[name] = round(run(spark, name, sf_dir), 4)
    spark.stop()
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

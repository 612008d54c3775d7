"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR chooses the tables (default sf0.1), BENCH_CPUS the number of local cores. Queries are run once to warm up and
then timed; those with a baseline are timed three times and give the median. ``collate_336`` labels the whole grid of 336
durations before it samples; it takes long and is timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from askahead.catalog import QUERIES
from askahead.catalog.base import order_labels
from askahead.plans.labels import collate_labels
from askahead.session import local_session

WITH_BASELINE = [
    "label_table",
    "duration_grid",
    "asof_next_event",
    "collate_sampled",
    "occurrence_range_join",
    "auroc_per_code",
]
ONCE = [
    "scan_events",
    "candidate_times",
    "censor_flag",
    "label_table_clicks",
    "asof_history_bound",
    "collate",
    "collate_sampled_parts",
    "eval_task_tables",
    "eval_tasks_from_log",
    "external_task_tables",
    "auroc_two_head",
    "log_loss",
    "composite_agg",
    "history_sequence",
    "model_input",
    "predict_table",
    "sample_codes_repeated",
    "code_slug",
]
LONG = {"collate_336": lambda spark, sf: collate_labels(order_labels(spark, sf, list(range(30, 366))), 20, 1)}


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")

    def once(query) -> float:
        started = time.perf_counter()
        # The noop sink computes every row and column without bringing any to the driver.
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times: dict[str, float] = {}
    for name in names:
        if name in LONG:
            times[name] = round(once(LONG[name]), 3)
            continue
        once(QUERIES[name])
        runs = 3 if name in WITH_BASELINE else 1
        times[name] = round(statistics.median(once(QUERIES[name]) for _ in range(runs)), 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or [*WITH_BASELINE, *ONCE, *LONG])

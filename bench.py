"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed
runs after a warm-up; further arguments choose the queries. Every result is
computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from dispatchmart.catalog.queries import QUERIES
from dispatchmart.session import build_session

HEADLINE = [
    "street_suffix_abbrev",
    "cross_street_removal",
    "cut_after_suffix",
    "ordinal_digit_runs",
    "location_feed",
    "free_text_feed",
    "split_field_feed",
    "standard_pickups",
    "time_to_shift",
    "geocode_gazetteer",
    "split_head_rest",
    "except_distinct",
    "not_in_insert",
    "surrogate_keys",
    "scd2_unchanged",
    "scd2_dimension",
    "fact_with_keys",
    "term_counts",
    "top_term_tag",
    "count_vectors",
    "lexicon_sentiment",
    "message_facts",
    "stream_capture",
    "stream_scored",
    "full_refresh",
    "load_error_budget",
]


def run(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    line = {
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

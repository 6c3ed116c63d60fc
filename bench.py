"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and the cores.
Every query runs twice in one session. ``queries`` has the faster run, so that JVM warm-up does not count; ``first``
has the first one.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import suite  # noqa: E402
from rinseframe.operators import insight, profile, scout  # noqa: E402
from suite.views import table  # noqa: E402

HEADLINE = [
    "validate", "violation_cells", "report_details", "recipe_full", "audit_trail", "drop_duplicates", "duplicate_rows",
    "fill_mean", "fill_median", "fill_mode", "fill_knn", "fill_iterative_chained", "fuzzy_merge", "scout_all",
    "column_summary", "five_number", "describe", "top_values", "zscore_long", "text_title", "text_punct",
]


def _scout_lineitem(spark, folder):
    return scout.scout(table(spark, folder, "lineitem"))


def _profile_lineitem(spark, folder):
    return profile.describe(table(spark, folder, "lineitem"))


def _correlate_lineitem(spark, folder):
    return insight.correlation(table(spark, folder, "lineitem"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rinseframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: suite.QUERIES[name] for name in HEADLINE}
    runs |= {
        "scout_lineitem": _scout_lineitem, "profile_lineitem": _profile_lineitem, "correlate_lineitem": _correlate_lineitem,
    }
    times, firsts = {}, {}
    for name, fn in runs.items():
        best = None
        for _ in range(2):
            start = time.perf_counter()
            fn(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            firsts.setdefault(name, round(took, 3))
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "first": firsts,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

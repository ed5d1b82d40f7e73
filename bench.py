"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.
Each query is planned and run twice from its files, nothing is kept in between. ``queries`` and ``value``
are the first runs, which also compile the generated code; ``second_run`` are the ones after them. Learners
and streams run once, as compiling is a small part of them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.catalog import registry

HEADLINES = (
    "feature_row",
    "window_features",
    "flow_table",
    "flow_duration",
    "inter_arrival",
    "count_windows",
    "length_percentiles",
    "entropy_columns",
    "direction_ratio",
    "top5_ratios",
    "value_freq",
    "entropy",
    "bin_equal_width",
    "live_windows",
    "stratified_split",
    "roc_auc",
    "scan_csv_roundtrip",
    "capture_decode",
    "prob_density",
)
ONCE = ("rf_predictions", "score_batch", "window_analysis", "stream_flow_rates", "stream_count_windows")


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Every row and column is computed; nothing is kept."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    # Start the JVM's and the Python worker's machinery outside the timings.
    run(spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1))))
    first, seconds = {}, {}
    for name in HEADLINES:
        for times in (first, seconds):
            start = time.perf_counter()
            run(registry.QUERIES[name](spark, sf_dir))
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {first[name]} s, then {seconds[name]} s", file=sys.stderr, flush=True)
    for name in ONCE:
        start = time.perf_counter()
        run(registry.QUERIES[name](spark, sf_dir))
        first[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {first[name]} s", file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(first.values()), 3),
        "unit": "sec",
        "queries": first,
        "second_run": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, the median counts (default 3, after one warm-up)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("tabloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workloads():
    from tabloom.operators import balance, examples, features, forest, metrics, profile, split
    from workload import inputs
    from workload.preparing import labelled
    from workload.registry import table

    def write(df):
        """Compute every row and column of a result without storing it."""
        df.write.format("noop").mode("overwrite").save()

    def profile_lineitem(spark, sf):
        for part in profile.profile(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).values():
            write(part)

    def examples_split(spark, sf):
        spec = inputs.PrepSpec(
            target="l_linestatus", features=("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"),
            instruction="Predict the line status.", keep=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        )
        ex = examples.build_examples(table(spark, sf, "lineitem"), spec)
        write(split.stratified_split(ex, "output", spec.keep))

    def ensemble(spark, sf):
        found = features.select_features(
            inputs.wide_embeddings(spark, sf), "label", key=["vec_id"], exclude=["vec_id"],
            methods=("correlation", "mutual_info"),
        )
        write(features.rankings_table(found.rankings, found.ranked))

    def evaluation(spark, sf):
        for part in metrics.evaluate(inputs.predictions(spark, sf), inputs.STATUS).values():
            write(part)

    return {
        "profile": profile_lineitem,
        "examples_stratified_split": examples_split,
        "oversample": lambda s, sf: write(balance.oversample(labelled(s, sf), "quality", ["doc_id"])),
        "undersample": lambda s, sf: write(balance.undersample(labelled(s, sf), "quality", ["doc_id"])),
        "evaluate": evaluation,
        "ensemble_ranking": ensemble,
        "forest_importance": lambda s, sf: write(
            forest.rank_forest(inputs.wide_embeddings(s, sf), inputs.WIDE, "label", key=["vec_id"])
        ),
    }


def main() -> None:
    spark = session()
    timings: dict[str, float] = {}
    for name, run in workloads().items():
        run(spark, SF_DIR)
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run(spark, SF_DIR)
            times.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(times), 3)
    found = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "total of median warm run times",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "A1_accumulate", "N4_downstream_link", "N11_outlet_recursion", "N12_sequence", "N14_from_lines", "P12_pair_additive", "R1_route_indirect", "R2_gather_up", "R7_location_pairs",
    "J3_catchment", "J4_nearest", "J7_overlay", "M14_numbering", "R9_reach_graph", "E4_flow_by_period", "A5_coarsen", "A12_resample7d", "V2_reach_from_segments_log",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from thalweg.plans import registry

    spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand").count().collect()  # start-up isn't timed
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from weft import queries as core

NAMES = ["j30_triangles_by_vertex", "j16_triangle_count", "j31_four_clique_by_vertex", "p_path3", "j01_multiway_chain", "j01_star", "j01_snowflake_eight_tables", "j01_cyclic", "j03_salted", "a04_checksum", "w02_inclusive_scan", "a12_rle", "p09_lower_bound", "q01", "q03", "q05", "q08", "q09", "q13", "q18", "q21"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    core.QUERIES["q06"](spark, sf).collect()  # starts the session's threads and code generation
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds of all headline queries, once each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

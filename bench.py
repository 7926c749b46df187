"""Runs headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line: seconds by query and their sum.

Each query runs once to warm up on the smallest tables, then once, timed, with its result written to Spark's noop sink."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

NAMES = (
    "p04_overlap_similarity w06_span_credit u08_corpus_shared p06_self_repeats t03_tokens a08_sentence_length_stats w01_mattr io07_html_text w15_stratified_sample a24_auroc s01_fixed_window s05_daily_quota p12_paraphrases t29_language p01_report"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = here + os.pathsep + os.environ.get("PYTHONPATH", "")
    from pyspark.sql import SparkSession

    from inkwell import catalogue

    parts = str(2 * int(cpus)) if cpus.isdigit() else "16"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", parts).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    seconds: dict[str, float] = {}
    for name in NAMES:
        query = catalogue.QUERIES[name]
        if os.path.isdir(small):
            query(spark, small).write.format("noop").mode("overwrite").save()
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

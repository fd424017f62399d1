"""Bulk work on a bucket at $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each figure is the median of three runs after one that warms up; results are counted or written to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larder import queries as q
from larder.functions import codec

D = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    base = q.loaded(spark, D)
    layered = q.with_deletes(spark, D)
    n = base.frame("orders").count()
    new = q.constant("o_orderkey", "X", spark, D, "o_orderkey % 5 = 0")
    some = q.customer_keys(spark, D).withColumn("value", codec.utf8(F.lit("U")))
    third = q.constant("o_orderkey", "", spark, D, "o_orderkey % 3 = 0").select("key")
    fresh = lambda: q.loaded(spark, D)
    none = lambda: None
    # what comes before the timer, and what is timed
    work = {
        "bulk_load": (none, lambda _: q.loaded(spark, D)),
        "scan": (none, lambda _: sink(base.frame("orders"))),
        "scan_ordered": (none, lambda _: sink(base.reader("orders").ordered())),
        "scan_over_deletes": (none, lambda _: sink(layered.frame("orders"))),
        "point_get": (none, lambda _: base.view("orders", lambda t: t.get(b"000000000042"))),
        "batch_get": (none, lambda _: sink(base.reader("orders").get_all(some.select("key")))),
        "overwrite_fifth": (fresh, lambda s: s.exec("orders", lambda t: t.put_all(new))),
        "update_batch": (fresh, lambda s: s.exec("orders", lambda t: t.update_all(some))),
        "delete_third": (fresh, lambda s: s.exec("orders", lambda t: t.delete_all(third))),
        "compact_after_deletes": (lambda: q.with_deletes(spark, D), lambda s: s.compact(1 << 62)),
        "load_and_ordered_log": (none, lambda _: q.txn_ordered_fold(spark, D)),
        "drop_bucket": (fresh, lambda s: s.drop("orders")),
    }
    took = {}
    for name, (before, fn) in work.items():
        fn(before())
        runs = []
        for _ in range(3):
            store = before()
            t = time.perf_counter()
            fn(store)
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "bulk_bucket_operations_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": D.rpartition("sf")[2], "keys": n}))


if __name__ == "__main__":
    main()

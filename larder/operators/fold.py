"""An ordered log of operations, folded over a bucket's state in one job.

A log has ord, op (put, update, del or get), key and val. Existence before each operation follows from the last put or del of its key,
or else from the bucket; update never changes it. From that follow errors, which updates take effect, what gets return and each key's last state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Kind
from ..functions.checks import key_error

OPS = ("put", "update", "del", "get")


def folded(log: DataFrame, current: DataFrame) -> DataFrame:
    """The log with: error (a code or null), existed, effective, and got (of a get: the value at that moment)."""
    log = log.select(F.col("ord").cast("long").alias("ord"), F.col("op"), F.col("key").cast("binary").alias("key"), F.col("val").cast("binary").alias("val"))
    # the bucket's rows of touched keys only
    touched = log.join(current.select("key", F.col("value").alias("_old")), "key", "left")
    before = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("op") == "put", True).when(F.col("op") == "del", False)
    step = touched.withColumn("existed", F.coalesce(F.last(state, ignorenulls=True).over(before), F.col("_old").isNotNull()))
    wrote = F.when((F.col("op") == "put") | ((F.col("op") == "update") & F.col("existed")), F.struct(F.col("val").alias("v"))).when(F.col("op") == "del", F.struct(F.lit(None).cast("binary").alias("v")))
    step = step.withColumn("_wrote", wrote)
    last = F.last("_wrote", ignorenulls=True).over(before)
    step = step.withColumn("got", F.when(F.col("op") == "get", F.when(last.isNotNull(), last["v"]).otherwise(F.col("_old"))))
    needs_value = F.when(F.col("op").isin("put", "update") & F.col("val").isNull(), int(Kind.INVALID))
    known = F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), int(Kind.INVALID))
    absent = F.when(F.col("op").isin("del", "get") & ~F.col("existed"), int(Kind.NOT_FOUND))
    step = step.withColumn("error", F.coalesce(known, key_error(F.col("key")), needs_value, absent))
    effective = (F.col("op").isin("put", "del") | ((F.col("op") == "update") & F.col("existed"))) & F.col("error").isNull()
    return step.withColumn("effective", F.coalesce(effective, F.lit(False))).select("ord", "op", "key", "val", "error", "existed", "effective", "got")


def final_rows(steps: DataFrame) -> DataFrame:
    """A delta (key, value, tomb) of the effective operations' last states."""
    last = steps.where("effective").groupBy("key").agg(F.max_by(F.struct("op", "val"), "ord").alias("r"))
    return last.select("key", F.when(F.col("r.op") != "del", F.col("r.val")).alias("value"), (F.col("r.op") == "del").alias("tomb"))

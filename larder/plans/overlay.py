"""The plan that reads a bucket: its base without the keys of newer segments, and the newest live row of each of those.

Key filters on the result reach every scan, for Spark infers them through the anti-join and the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Kind, StoreError
from ..sources.files import HadoopFiles, LocalFiles
from ..sources.manifest import Segment

ROWS = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
DELTA = T.StructType([*ROWS.fields, T.StructField("tomb", T.BooleanType(), False)])


def rows_of(spark: SparkSession, files: LocalFiles | HadoopFiles, segment: Segment) -> DataFrame:
    """key, value (null for deletions) and tomb of a segment."""
    if segment.kind == "base":
        return spark.read.schema(ROWS).parquet(files.url(segment.path)).withColumn("tomb", F.lit(False))
    return spark.read.schema(DELTA).parquet(files.url(segment.path))


def check_files(files: LocalFiles | HadoopFiles, segment: Segment) -> None:
    """Spark reads what a folder holds, so files that went missing must be noticed here."""
    sizes = files.sizes(segment.path)
    if len(sizes) != segment.files or sum(sizes.values()) != segment.bytes:
        raise StoreError(Kind.CORRUPTION, f"files of {segment.path}")


def newest_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """One row (key, value, tomb) a key, from the last frame that has it. Each frame has a key at most once."""
    if len(frames) == 1:
        return frames[0]
    tagged = [f.select("key", F.struct(F.lit(i).alias("i"), "value", "tomb").alias("r")) for i, f in enumerate(frames)]
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy("key").agg(F.max_by("r", F.col("r.i")).alias("r")).select("key", "r.value", "r.tomb")


def overlay(
    spark: SparkSession, files: LocalFiles | HadoopFiles, segments: Sequence[Segment], low: bytes | None = None, high: bytes | None = None, newer: Sequence[DataFrame] = ()
) -> DataFrame:
    """key and value of a bucket; segments that can't hold keys from low to high are not read; newer: delta frames on top."""
    near = [s for s in segments if s.may_hold(low, high)]
    for s in near:
        check_files(files, s)
    base = [s for s in near if s.kind == "base"]
    deltas = [*[rows_of(spark, files, s) for s in near if s.kind == "delta"], *newer]
    old = spark.read.schema(ROWS).parquet(files.url(base[0].path)) if base else None
    if deltas:
        new = newest_rows(deltas)
        live = new.where("NOT tomb").select("key", "value")
        out = live if old is None else old.join(new.select("key"), "key", "left_anti").unionByName(live)
    else:
        out = spark.createDataFrame([], ROWS) if old is None else old
    if low is not None and low == high:
        return out.where(F.col("key") == F.lit(low))
    if low is not None:
        out = out.where(F.col("key") >= F.lit(low))
    return out if high is None else out.where(F.col("key") <= F.lit(high))
